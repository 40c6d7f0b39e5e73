"""Embedding near-duplicates by an exact metric range join.

On unit vectors a cosine of at least ``t`` is a distance of at most ``r = sqrt(2 - 2 t)``. Pivots partition the vectors of a label:
each belongs to the cell of its nearest pivot. By the triangle inequality a vector within ``r`` of another cell's member is at
most ``2 r`` farther from that cell's pivot than from its own, so it is copied to the cells within that margin and to no
others; of those, the ones whose dividing plane is more than ``r`` away are left out too. Every link then
shows in the cell of each of its two vectors, and cells join independently.

Equal vectors collapse first and are counted; only those that may be equal are shuffled for it. Cells are as large as a task can hold, so that there are few and
little is copied between them; a task cuts its cell again in the same way, where a copy is a number and not a vector. Cells that have grown too large are cut into blocks,
one task's group for each pair of blocks. A group gives back one row for each vector with a link: how many it found, and one vector it is connected with.
Pairs never leave a group. Vectors whose components are all 32-bit numbers are kept and sent as such.

Pivots come from a bounded sample: at most ``PIVOTS`` for each of the ``LABELS`` largest labels, chosen by hash. They decide how much is copied, not
what is found. They are broadcast: 4,096 vectors at most. Other labels are a single cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from wayfare.llm.components import components
from wayfare.llm.exact_dedup import maybe_in
from wayfare.llm.simhash import spanning
from wayfare.llm.tables import hold, prefixed, unused

PIVOTS, LABELS = 64, 64
#: Vectors a cell aims at; vectors of a block, and components it has at most; vectors that are compared at once, and that a cell within a task aims at.
CELL_ROWS, BLOCK_ROWS, BLOCK_VALUES, AT_ONCE = 100_000, 1 << 18, 1 << 24, 2_048
ADDED = ["n_links", "component_id", "kept"]
#: Rounding that the bounds allow for, and the margin in which a cosine is computed anew from the given numbers.
SLACK, CLOSE = 1e-7, 1e-9
#: Tells the second hash of a vector from the first.
ID_SALT = 0x5EED


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ y.T, 0))


def home_and_copies(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each unit vector, and which cells it is copied to (its own included)."""
    far = _distances(unit, pivots)
    home = far.argmin(axis=1)
    near = far[np.arange(len(unit)), home][:, None]
    margin = far - near <= 2 * radius + SLACK
    plane = far**2 - near**2 <= 2 * radius * _distances(pivots, pivots)[home] + SLACK
    to = margin & plane
    to[np.arange(len(unit)), home] = True
    return home, to


def _matrix(narrow: pa.Array, wide: pa.Array) -> np.ndarray:
    """Vectors of equally many components as rows, of which each is in one of two columns; 32-bit numbers if all are."""
    if not narrow.null_count:
        return narrow.flatten().to_numpy().reshape(len(narrow), -1)
    if not wide.null_count:
        return wide.flatten().to_numpy().reshape(len(wide), -1)
    some = wide.is_valid().to_numpy(zero_copy_only=False)
    first, second = narrow.drop_null().flatten().to_numpy(), wide.drop_null().flatten().to_numpy()
    out = np.empty((len(wide), len(second) // int(some.sum())))
    out[~some], out[some] = first.reshape(-1, out.shape[1]), second.reshape(-1, out.shape[1])
    return out


def _placed(pivots: dict[tuple[str, int], np.ndarray], radius: float, columns: list[str]):
    """``columns`` of the vectors with the cells they are in, and whether it is their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column("class").to_pylist(), dtype=object)
            dim = np.asarray(batch.column("dim"))
            cells, owns, rows = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
            for key in set(zip(label.tolist(), dim.tolist())):
                at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                if key not in pivots:
                    cells.append(np.zeros(len(at), np.int64))
                    owns.append(np.ones(len(at), bool))
                    rows.append(at)
                    continue
                vectors = _matrix(*(batch.column(c).take(pa.array(at)) for c in ("narrow", "wide"))).astype(np.float64)
                home, to = home_and_copies(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), pivots[key], radius)
                i, cell = np.nonzero(to)
                cells.append(cell)
                owns.append(home[i] == cell)
                rows.append(at[i])
            taken = batch.select(columns).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(owns))],
                names=[*taken.schema.names, "cell", "own"],
            )

    return run


def _forest(size: int, edges: list[np.ndarray]) -> np.ndarray:
    """One edge for each of ``size`` items that is connected with a smaller one: to the smallest."""
    root = spanning(size, *np.concatenate(edges, axis=1))
    above = np.flatnonzero(root != np.arange(size))
    return np.stack([above, root[above]])


def _block_links(threshold: float, radius: float):
    """Links between the left and the right rows of a group."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, copies, is_left, is_right = (group.column(c).to_numpy() for c in ("node", "copies", "is_left", "is_right"))
        raw = _matrix(*(group.column(c).combine_chunks() if group.column(c).num_chunks != 1 else group.column(c).chunk(0) for c in ("narrow", "wide")))
        parts = [slice(k, k + AT_ONCE) for k in range(0, len(raw), AT_ONCE)]
        norm = np.concatenate([np.linalg.norm(raw[p].astype(np.float64), axis=1) for p in parts])

        def unit(rows: np.ndarray | slice) -> np.ndarray:
            return raw[rows].astype(np.float64) / norm[rows][:, None]

        pivots = unit(np.unique(np.linspace(0, len(raw) - 1, min(-(-len(raw) // AT_ONCE), PIVOTS)).astype(np.int64)))
        placed = [home_and_copies(unit(p), pivots, radius) for p in parts]
        home, to = (np.concatenate(x) for x in zip(*placed))
        count, edges = np.zeros(len(raw), np.int64), [np.zeros((2, 0), np.int64)]
        for cell in range(len(pivots)):
            lefts, rights = np.flatnonzero(is_left & (home == cell)), np.flatnonzero(is_right & to[:, cell])
            for at in range(0, len(lefts), AT_ONCE):
                left = lefts[at : at + AT_ONCE]
                mine = unit(left)
                for begin in range(0, len(rights), AT_ONCE):
                    right = rights[begin : begin + AT_ONCE]
                    cosine = mine @ unit(right).T
                    linked = cosine >= threshold
                    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < CLOSE)):
                        a, b = left[i], right[j]
                        linked[i, j] = float(np.dot(raw[a].astype(np.float64), raw[b].astype(np.float64))) / (norm[a] * norm[b]) >= threshold
                    linked &= left[:, None] != right[None, :]
                    i, j = np.nonzero(linked)
                    if len(i):
                        count[left] += linked @ copies[right]
                        # one edge is kept for each vector of a part, to the first that it is connected with
                        own = np.concatenate([left, right])
                        edges.append(np.stack([own, own[spanning(len(own), i, len(left) + j)]]))
                        if sum(e.shape[1] for e in edges) > 4 * len(raw):
                            edges = [_forest(len(raw), edges)]
        a, b = _forest(len(raw), edges)
        root, met = np.arange(len(raw)), np.zeros(len(raw), bool)
        root[a] = b
        met[a] = met[b] = True
        return pa.table({"node": node[met], "found": count[met], "root": node[root[met]]})

    return run


def _scaled(vector: Column) -> Column:
    """The vector with its largest component near one where squares would under- or overflow. By powers of two, in two steps, so exact."""
    largest = F.array_max(F.transform(vector, F.abs))
    power = F.when((largest > 0) & ((largest < 1e-100) | (largest > 1e100)), -F.floor(F.log2(largest))).otherwise(F.lit(0)).cast("double")
    half = F.floor(power / 2).cast("double")
    scaled = F.transform(vector, lambda x: x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half))
    return F.when(power == 0, vector).otherwise(scaled)


def embedding_groups(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """All rows with ``n_links``, ``component_id`` and ``kept`` (existing columns of these names are replaced).

    Two vectors link if their labels are equal and not null, they have as many components, and their cosine is ``threshold`` or more.

    * Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: no links, own component, kept.
    * Finite vectors of any size link: very large and very small ones are scaled by a power of two first.
    * A row without id links with nothing and is not counted as a link; its component is null and it is kept.
    * Ties and repeated rows link with each other like any vectors; rows that repeat an id are kept or dropped together.
    * An empty table gives no rows. Other columns pass through unchanged.
    """
    vectors = prefixed(vectors, ADDED)
    ident, given, label = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`"), F.col(f"`{label_col}`")
    names = {k: unused(vectors, f"emb_{k}") for k in ("class", "vector", "dim", "h1", "h2")}
    doubles = F.coalesce(given.cast("array<double>"), F.array().cast("array<double>"))
    faulty = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = ident.isNotNull() & label.isNotNull() & ~faulty & F.exists(doubles, lambda x: x != 0)
    marked = vectors.withColumns({names["class"]: F.when(usable, label.cast("string")), names["vector"]: F.when(usable, _scaled(doubles)), names["dim"]: F.size(doubles)})
    # 128 bits stand for a vector from here on.
    vector = F.col(names["vector"])
    marked = marked.withColumns({names["h1"]: F.xxhash64(vector), names["h2"]: F.xxhash64(F.lit(ID_SALT), vector)})
    able = marked.where(F.col(names["class"]).isNotNull())
    same = ("class", "dim", "h1", "h2")
    wide = able.select(*[F.col(names[k]).alias(k) for k in (*same, "vector")], ident.cast("long").alias("node"))
    narrow = F.col("vector").cast("array<float>")
    exact = F.forall(F.zip_with("vector", narrow, lambda x, y: x == y.cast("double")), lambda equal: equal)
    sized = wide.select(*same, "node", F.when(exact, narrow).alias("narrow"), F.when(~exact, F.col("vector")).alias("wide"))
    # Only vectors that may be there more than once are shuffled to be collapsed.
    several = hold(wide.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("h1"), "repeated")
    seen = maybe_in(sized, F.col("h1"), several, "maybe")
    single = seen.where("not maybe").select(*same, "narrow", "wide", "node", F.lit(1).cast("long").alias("copies"))
    repeated = seen.where("maybe").groupBy(*same, "narrow", "wide").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = hold(single.unionByName(repeated), "vectors")

    radius = float(np.sqrt(2 - 2 * threshold))
    pivots = _pivots(nodes)

    def placed(*columns: str) -> DataFrame:
        if not pivots:
            return nodes.select(*columns, F.lit(0).alias("cell"), F.lit(True).alias("own"))
        fields = [f for c in columns for f in nodes.schema.fields if f.name == c]
        return nodes.mapInArrow(_placed(pivots, radius, list(columns)), StructType([*fields, StructField("cell", IntegerType()), StructField("own", BooleanType())]))

    # Vectors go to their cells in one shuffle; how many a cell gets is counted without them.
    rows = F.least(F.lit(BLOCK_ROWS), F.greatest(F.floor(F.lit(BLOCK_VALUES) / F.col("dim")), F.lit(AT_ONCE)))
    sizes = placed("class", "dim").groupBy("class", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("blocks"))
    large = hold(sizes.where("blocks > 1"), "cell-sizes")
    cut = placed("class", "dim", "node", "copies", "narrow", "wide").join(F.broadcast(large), ["class", "dim", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    block, others = F.col("block"), F.sequence(F.lit(0), F.col("blocks") - 1)
    as_left = F.transform(others, lambda j: F.struct(block.alias("i"), j.alias("j"), F.lit(True).alias("is_left"), (j == block).alias("is_right")))
    as_right = F.transform(F.filter(others, lambda i: ~F.col("own") | (i != block)), lambda i: F.struct(i.alias("i"), block.alias("j"), F.lit(False).alias("is_left"), F.lit(True).alias("is_right")))
    cut = cut.withColumn("pair", F.explode(F.when(F.col("own"), F.concat(as_left, as_right)).otherwise(as_right)))
    grouped = cut.select("class", "dim", "cell", "pair.*", "node", "copies", "narrow", "wide").groupBy("class", "dim", "cell", "i", "j")
    found = hold(grouped.applyInArrow(_block_links(threshold, radius), "node long, found long, root long"), "found")

    ends = nodes.select("node", F.col("node").alias("value"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), ends)
    counts = found.groupBy("node").agg(F.sum("found").alias("found"))
    classes = classes.select("node", "component").join(counts, "node", "left")
    settled = hold(nodes.join(classes, "node").select(
        *[F.col(k).alias(names[k]) for k in ("class", "dim", "h1", "h2")],
        (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"),
    ), "settled")
    joined = able.join(settled, [names[k] for k in ("class", "dim", "h1", "h2")])
    columns = [F.col(f"`{c}`") for c in vectors.columns]
    rest = marked.where(F.col(names["class"]).isNull()).select(*columns, F.lit(0).cast("long").alias("n_links"), ident.cast("long").alias("component_id"))
    everything = joined.select(*columns, "n_links", "component_id").unionByName(rest)
    return everything.withColumn("kept", ident.eqNullSafe(F.col("component_id")))


def _pivots(nodes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Unit pivots of the largest labels, by label and dimension."""
    large = nodes.groupBy("class", "dim").count().where(F.col("count") > CELL_ROWS).orderBy(F.desc("count"), "class", "dim").limit(LABELS).collect()
    if not large:
        return {}
    wanted = {(r["class"], r["dim"]): min(PIVOTS, -(-r["count"] // CELL_ROWS)) for r in large}
    chosen = nodes.where(F.struct("class", "dim").isin([F.struct(F.lit(c), F.lit(d)) for c, d in wanted]))
    order = Window.partitionBy("class", "dim").orderBy(F.xxhash64("node"), "node")
    rows = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS)
    rows = rows.select("class", "dim", "place", F.coalesce(F.col("narrow").cast("array<double>"), "wide").alias("vector")).collect()
    out: dict[tuple[str, int], list] = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        key = (r["class"], r["dim"])
        if r["place"] <= wanted[key]:
            out.setdefault(key, []).append(r["vector"])
    return {k: (x := np.array(v, np.float64)) / np.linalg.norm(x, axis=1, keepdims=True) for k, v in out.items()}


def op10_embedding(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{folder}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


SQL = """
with recursive unit as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and list_dot_product(embedding::double[], embedding::double[]) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from unit a join unit b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach as (
  select a as node, a as other from links union select r.node, l.b from reach r join links l on r.other = l.a),
low as (select node, min(other) as component_id from reach group by node),
counts as (select a as node, count(*) as n_links from links group by a)
select e.vec_id, coalesce(c.n_links, 0) as n_links, coalesce(l.component_id, e.vec_id) as component_id,
  e.vec_id = coalesce(l.component_id, e.vec_id) as kept
from embeddings e left join low l on e.vec_id = l.node left join counts c on e.vec_id = c.node
"""
