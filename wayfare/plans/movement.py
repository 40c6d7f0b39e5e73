"""Movement index: how far agents go, relative to the way between home and work, by area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.geo import grid_distance, grid_to_coord, home_work_distance, movement_index
from wayfare.operators.filters import known_home_and_work
from wayfare.operators.ordered import with_place
from wayfare.operators.percentile import weighted_summary
from wayfare.sources.writers import write_bucketed

MIN_HOME_WORK_M = 1000
#: Copies that are made at once, and areas of a list.
REPEAT_BLOCK, LIST_UNITS = 1_024, 1_000
INDEX_LEVELS = ("sa2", "gcc", "state", "nation")
AREA_LEVELS = ("sa1", "sa2")


def weight_number(weight: Column | str = "weight") -> Column:
    """Whole part of a weight text, null when it is no number."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return w.try_cast("double").try_cast("int")


def repeat_by_weight(weights: DataFrame) -> DataFrame:
    """Each agent as many times as its weight says; zero, negative and unreadable weights give no row.

    The jobs never do this: they carry the weight as a factor.
    """
    positive = weights.select("agent_id", weight_number().alias("_w")).where("_w > 0")
    blocks = positive.select("agent_id", "_w", F.explode(F.sequence(F.lit(0), F.floor((F.col("_w") - 1) / REPEAT_BLOCK).cast("int"))).alias("_block"))
    # Blocks are dealt anew, so that the copies of one large weight are made by many tasks.
    dealt = blocks.repartition("agent_id", "_block")
    inside = F.least(F.lit(REPEAT_BLOCK), F.col("_w") - F.col("_block") * REPEAT_BLOCK)
    return dealt.select(F.explode(F.array_repeat("agent_id", inside)).alias("agent_id"))


def visited_units(visits: DataFrame, tile: float = 0.1, size: int = LIST_UNITS) -> DataFrame:
    """Visited areas per agent and tile (squares of ``tile`` degrees) as sorted lists, repeats kept and nulls left out.

    A list has at most ``size`` areas; longer ones go on in further rows, in order of ``part``. Areas whose id holds no coordinates share the
    tile without numbers.
    """
    known = visits.select("agent_id", "geo_unit_id").where(F.col("geo_unit_id").isNotNull())
    tiles = {f"tile_{c}": F.floor(grid_to_coord("geo_unit_id", c) / F.lit(tile)).cast("long") for c in ("lon", "lat")}
    placed = with_place(known.withColumns(tiles), ["agent_id", *tiles], ["geo_unit_id"])
    gathered = placed.groupBy("agent_id", *tiles, F.floor(F.col("position") / size).alias("part"))
    return gathered.agg(F.array_sort(F.collect_list("geo_unit_id")).alias("geo_units"))


def radius_from_home(visits: DataFrame, homes: DataFrame) -> DataFrame:
    """Largest distance between an agent's visited areas and its home, per (agent, home).

    Repeated visits collapse before the join, mostly on the map side; what is left of the busiest agent is the
    number of areas there are.
    """
    places = visits.select("agent_id", "geo_unit_id").where(F.col("geo_unit_id").isNotNull()).distinct()
    homes = homes.select("agent_id", "home").distinct()
    return (
        places.join(homes, "agent_id")
        .groupBy("agent_id", "home")
        .agg(F.max(grid_distance("geo_unit_id", "home")).alias("max_dis"))
    )


def agent_index(
    visits: DataFrame, homework: DataFrame, hierarchy: DataFrame, levels: Sequence[str], min_distance: float = MIN_HOME_WORK_M
) -> DataFrame:
    """Movement index of each agent, home and work with the areas the home belongs to; ``copies`` counts equal rows of ``homework``.

    Both tables are read once and collapse before they meet: visits to distinct places, homes to distinct pairs.
    """
    pairs = known_home_and_work(homework).groupBy("agent_id", "home", "work").agg(F.count(F.lit(1)).alias("copies"))
    known = pairs.withColumn("hw_dist", home_work_distance("home", "work")).where(F.col("hw_dist") >= min_distance)
    places = visits.select("agent_id", "geo_unit_id").where(F.col("geo_unit_id").isNotNull()).distinct()
    farthest = F.max(grid_distance("geo_unit_id", "home")).alias("max_dis")
    reach = places.join(known, "agent_id").groupBy("agent_id", "home", "work", "hw_dist", "copies").agg(farthest)
    dimension = hierarchy.select(F.col("geo_hierarchy_base_id").alias("home"), *levels)
    return (
        reach.join(dimension, "home")
        .withColumn("index", movement_index("max_dis", "hw_dist"))
        .where(F.col("index").isNotNull())
        .select("agent_id", "home", "work", "max_dis", "hw_dist", "index", "copies", *levels)
    )


def weighted_index(index: DataFrame, weights: DataFrame) -> DataFrame:
    """The index with each agent's weight ``w``, times its copies; agents without a positive weight go."""
    known = weights.select("agent_id", weight_number().alias("_w")).where(F.col("_w") > 0)
    return index.join(known, "agent_id").withColumn("w", F.col("_w") * F.col("copies")).drop("_w")


def by_level(weighted: DataFrame, levels: Sequence[str], date: str) -> DataFrame:
    """Weighted count, mean and exact median of the index at every level, in one pass.

    ``nation`` is the level without an area.
    """
    sets = [
        F.struct(
            F.lit(level).alias("level"),
            (F.lit(None) if level == "nation" else F.col(level)).cast("string").alias("area"),
        )
        for level in levels
    ]
    spread = weighted.select("index", "w", F.explode(F.array(*sets)).alias("_s")).select("_s.level", "_s.area", "index", "w")
    summed = weighted_summary(spread, ["level", "area"], "index", "w")
    return summed.select(
        "level",
        "area",
        F.lit(date).alias("date"),
        "mean",
        F.col("percentile").alias("median"),
        F.col("total").alias("weighted_agent_num"),
    )


def movement_by_area(
    visits: DataFrame, homework: DataFrame, hierarchy: DataFrame, weights: DataFrame, date: str
) -> DataFrame:
    """Mean and median index by sa1 and by sa2."""
    index = agent_index(visits, homework, hierarchy, AREA_LEVELS)
    return by_level(weighted_index(index, weights), AREA_LEVELS, date).drop("weighted_agent_num")


def movement_index_by_level(
    visits: DataFrame, homework: DataFrame, hierarchy: DataFrame, weights: DataFrame, date: str
) -> DataFrame:
    """Mean, median and weighted agent number by sa2, gcc, state and for the nation."""
    index = agent_index(visits, homework, hierarchy, [level for level in INDEX_LEVELS if level != "nation"])
    return by_level(weighted_index(index, weights), INDEX_LEVELS, date)


def write_levels(result: DataFrame, path: str) -> None:
    """One folder per level, in a single pass over the result."""
    result.write.mode("error").partitionBy("level").parquet(path)


def store_by_agent(visits: DataFrame, homework: DataFrame, weights: DataFrame, names: Sequence[str], buckets: int = 200, folder: str | None = None) -> None:
    """Keep a day's distinct visits, the homes and the weights as tables divided by agent, under three ``names``.

    ``agent_index`` and ``weighted_index`` over these tables (``spark.table``) join and group without an exchange. Visits are distinct, so the
    busiest agent has as many rows as there are areas.
    """
    places = visits.select("agent_id", "geo_unit_id").where(F.col("geo_unit_id").isNotNull()).distinct()
    for name, rows in zip(names, (places, homework.select("agent_id", "home", "work"), weights.select("agent_id", "weight"))):
        write_bucketed(rows, name, buckets=buckets, path=f"{folder}/{name}" if folder else None)
