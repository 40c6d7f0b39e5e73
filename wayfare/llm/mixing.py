"""Mixing sources to target weights as a curriculum that varies over training time.

Every source has a weight schedule over training time 0..1, linear between knots. Its integral is the source's cumulative
demand for words; scaled to the source's target it says how many of its words are wanted by each time. A document that
starts at word ``c`` of its source's supply is therefore due at the time at which demand reaches ``c``: the inverse of the
integral. Documents, repeats included, are range-sorted by that time.

Supply order is by the MD5 of the id. Offsets are running sums in two steps, over buckets of that order and then inside
each bucket, so that a source with a third of all documents is spread over many tasks. The number of buckets
follows the number of documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.llm.tables import hold, prefixed, text_of, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Relative weight at times 0, 0.5 and 1 of the first, second and third source, repeating.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
ADDED = ["size", "source_size", "target", "taken", "positions"]
#: Documents a bucket of the supply order aims at.
BUCKET_ROWS = 5_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space: the places where one begins."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """``source``, ``source_size`` (one row per source) with ``place`` (0, 1, ... by code point), ``weight`` and ``target``.

    Targets share ``share`` times all sizes by weight. One that would pass ``cap`` times its source's size stops there and
    the excess is shared anew by weight until none is above. That ends where targets are ``least(cap * size, level * weight)``;
    in the order of ``cap * size / weight`` the capped sources come first, so the level follows from running sums.
    """
    order = Window.orderBy("source")
    placed = sizes.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    placed = placed.withColumn("full", (F.col("budget") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * F.col("weight_left"))
    free = ~F.col("full")
    level = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))) / F.sum(F.when(free, F.col("weight"))).over(everything)
    return placed.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight"))).select("source", "source_size", "place", "weight", "target")


def _integral(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Pieces of a schedule: time and width, weight and slope, share of the whole integral before it."""
    if [t for t, _ in knots] != sorted({t for t, _ in knots}) or knots[0][0] != 0 or knots[-1][0] != 1 or min(w for _, w in knots) <= 0:
        raise ValueError("a schedule needs rising times from 0 to 1 and positive weights")
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, t1 - t0, w0, (w1 - w0) / (t1 - t0), area))
        area += (w0 + w1) / 2 * (t1 - t0)
    return [(t, width, w, slope, before) for t, width, w, slope, before in pieces] + [(1.0, 0.0, 1.0, 0.0, area)]


def due_time(demand: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the integral of the schedule reaches the share ``demand`` (0..1) of its whole."""
    *pieces, (_, _, _, _, area) = _integral(knots)
    wanted = demand * F.lit(area)
    out = F.lit(1.0)
    for t, width, w, slope, before in reversed(pieces):
        end = before + (w + slope * width / 2) * width
        rest = wanted - F.lit(before)
        inside = rest / F.lit(w) if slope == 0 else F.lit(2.0) * rest / (F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * rest, F.lit(0.0))))
        out = F.when(wanted <= F.lit(end), F.least(F.lit(t) + inside, F.lit(t + width))).otherwise(out)
    return out


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = 1.5, cap: int = 2, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, carry: list[str] | None = None,
) -> DataFrame:
    """Rows with ``size`` (words), ``source_size``, ``target`` (of the source), ``taken`` and ``positions`` (times at which the row is due).

    A source's supply is its documents in the order of their ids' MD5, as often as the target asks: all of them for each whole pass,
    and in the last pass those whose middle lies before the target. So the words taken miss the target by half a document at most,
    and no document is taken more than ``cap`` times. Reruns agree. Existing columns of the five names are replaced;
    ``carry`` names the columns of the result besides them (default: all).

    * A null or empty text has size 0; it is taken as often as its place in the order says, adding nothing.
    * Null sources are one source, the last. Null ids come first in their source's order. Ties (equal ids) are ordered by the
      text's hash; rows equal in both are interchangeable.
    * With no words at all every target is 0. An empty table gives no rows.
    """
    docs = prefixed(docs, ADDED)
    names = {k: unused(docs, f"mix_{k}") for k in ("key", "bucket", "source", "tie", "start", "offset", "place")}
    carried = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    # Not written in between: counting the words of a text twice costs less than storing all texts once more.
    sized = docs.select(
        *carried,
        word_count(text_of(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")).alias(names["key"]),
        F.xxhash64(text_of(text_col)).alias(names["tie"]),
        F.coalesce(F.concat(F.lit("0"), F.col(f"`{source_col}`").cast("string")), F.lit("1")).alias(names["source"]),
    )
    source, key, bucket, start, place = (names[k] for k in ("source", "key", "bucket", "start", "place"))
    buckets = 1 << max(4, (sized.count() // BUCKET_ROWS).bit_length())  # the count comes from the files' footers
    hexes = max(2, (buckets.bit_length() + 3) // 4)
    sized = sized.withColumn(bucket, F.substring(key, 1, hexes))
    sums = sized.groupBy(source, bucket).agg(F.sum("size").alias("bucket_size"))
    sums = hold(sums, "bucket-sizes")
    totals = sums.groupBy(F.col(source).alias("source")).agg(F.sum("bucket_size").alias("source_size"))
    targets = hold(source_targets(totals, share, cap, weights), "targets")
    running = Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(source, bucket, F.coalesce(F.sum("bucket_size").over(running), F.lit(0)).alias(start))
    starts = hold(
        starts.join(targets.withColumnRenamed("source", source), source).select(source, bucket, start, "source_size", "target", F.col("place").alias(place)),
        "starts",
    )
    inside = Window.partitionBy(source, bucket).orderBy(key, names["tie"], "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn(names["offset"], F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, [source, bucket])
    offset = F.col(start) + F.col(names["offset"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    times = (whole + F.when(offset + F.col("size") / 2 < rest, 1).otherwise(0)).cast("int")

    def due(turn: Column) -> Column:
        demand = F.when(F.col("target") > 0, (offset + turn * F.col("source_size")) / F.col("target")).otherwise(0.0)
        out = due_time(demand, schedules[-1])
        for i, knots in list(enumerate(schedules))[-2::-1]:
            out = F.when(F.col(place) % len(schedules) == i, due_time(demand, knots)).otherwise(out)
        return out

    positions = F.filter(F.transform(F.sequence(F.lit(0), F.lit(int(cap))), lambda k: F.when(k < times, due(k))), lambda x: x.isNotNull())
    return placed.select(
        *carried, "size", "source_size", "target", (F.col("size") * times).alias("taken"), positions.alias("positions")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training sequence: rows of ``docs``, repeats included, with ``position``, range-sorted by it. Options as ``plan_mix``."""
    docs = prefixed(docs, ["position"])
    planned = plan_mix(docs, **options)
    kept = [F.col(f"`{c}`") for c in planned.columns if c not in ADDED]
    return planned.select(*kept, F.explode("positions").alias("position")).orderBy("position")


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    planned = plan_mix(spark.read.parquet(f"{folder}/documents.parquet"), carry=["doc_id"])
    first = F.round(F.get("positions", F.lit(0)), 9)
    planned = planned.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return planned.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


#: The schedules above as their integral's inverse, by the remainder of the source's place.
SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(coalesce(doc_id::varchar, '')) as k
  from documents),
per_source as (select source, sum(size)::bigint as source_size from sized group by source),
placed as (
  select *, [3.0, 1.0, 2.0][1 + place % 3]::double as weight, source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as budget
  from (select *, row_number() over (order by source is null, encode(source)) - 1 as place from per_source)),
sums as (
  select *, coalesce(sum(cap) over before, 0) as cap_before, sum(weight) over () - coalesce(sum(weight) over before, 0) as weight_left
  from placed window before as (order by cap / weight, place rows between unbounded preceding and 1 preceding)),
full_ones as (select *, (budget - cap_before) * weight >= cap * weight_left as is_full from sums),
targets as (
  select *, case when is_full then cap else
    (budget - coalesce(sum(case when is_full then cap end) over (), 0)) / sum(case when not is_full then weight end) over () * weight end as target
  from full_ones),
starts as (
  select d.doc_id, d.size, t.source_size, t.target, t.place,
    coalesce(sum(d.size) over (partition by d.source order by d.k, d.size rows between unbounded preceding and 1 preceding), 0) as start
  from sized d join targets t on d.source is not distinct from t.source),
counted as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from starts),
taken as (
  select *, whole + case when start + size / 2 < target - whole * source_size then 1 else 0 end as times,
    case when target > 0 then start / target else 0 end as u from counted)
select doc_id, size::bigint as size, source_size, target, (size * times)::bigint as taken,
  case when times > 0 then round(case place % 3
    when 0 then case when u <= 0.625 then 2 * u / (1.5 + sqrt(2.25 - 2 * u)) else 0.5 + 2 * (u - 0.625) / (1 + sqrt(greatest(1 - 2 * (u - 0.625), 0))) end
    when 1 then case when u <= 0.375 then 2 * u / (0.5 + sqrt(0.25 + 2 * u)) else 0.5 + 2 * (u - 0.375) / (1 + sqrt(1 + 2 * (u - 0.375))) end
    else u end, 9) end as first_position
from taken
"""
