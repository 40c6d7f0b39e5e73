"""Codes of vectors by a codebook for each part, refined with adaptive distance bounds.

Every component becomes a whole number, so distances, sums and ties are exact. Each part of a vector keeps, from round to round, its ``b`` closest entries
in order, a lower bound on the distance to each but the first, and one outer bound for all entries that are not listed. After the
entries moved, a bound shrinks by the way its entry went, the outer one by the longest way of any entry, and each bound is made to hold
for all that follow it. The distance to the first entry is computed exactly. Where it is clearly below the first bound, the part stays; where it
is clearly below a later one, only the entries listed before that are compared, as whole numbers; otherwise all entries are. Bounds are
rounded down and distances up, so rounding only causes more comparisons and never another result.

``b`` adapts after each round: it becomes the shortest list that would have settled ``SETTLED`` of the parts that were compared within
their lists, and doubles where more than ``OVERRUN`` of all parts had to see every entry.

A round is one pass of tasks over a table in the shared folder: it reads vectors and lists (packed, a binary each), writes both for the next round, and
beside them, for each task, the sums of the parts that each entry won. The driver adds up those sums (entries times components numbers, whatever the table's size) and makes the next codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from wayfare.llm.tables import hold, prefixed, unused
from wayfare.session import discard, scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SETTLED, OVERRUN = 0.99, 0.05
ADDED = ["code", "error", "label_error", "codebooks_sha256"]
#: Relative room for rounding in 64-bit floats, and the same for bounds that are kept in 32 bits.
ROOM, ROOM32 = 1e-12, 2.0**-22


def part_slices(components: int, parts: int) -> list[slice]:
    """Consecutive parts; where they cannot be equal, earlier ones have one component more."""
    sizes = [components // parts + (p < components % parts) for p in range(parts)]
    ends = np.cumsum([0, *sizes]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances as whole numbers; ``entries`` are the same for all rows, or (row, entry, component)."""
    out = np.zeros((len(x), entries.shape[-2]), np.int64)
    for k in range(x.shape[1]):
        gap = x[:, k, None] - entries[..., k]
        out += gap * gap
    return out


def _below(distance2: np.ndarray) -> np.ndarray:
    return np.sqrt(distance2.astype(np.float64)) * (1 - ROOM)


def _above(distance2: np.ndarray) -> np.ndarray:
    return np.sqrt(distance2.astype(np.float64)) * (1 + ROOM)


class Lists:
    """The closest entries of one part of many vectors: ``near`` (-1: not known), ``bound`` of all but the first, and the outer bound last."""

    def __init__(self, near: np.ndarray, bound: np.ndarray):
        self.near, self.bound = near, bound

    @classmethod
    def unknown(cls, rows: int, b: int) -> Lists:
        near = np.full((rows, b), -1, np.int8)
        near[:, 0] = 0
        return cls(near, np.zeros((rows, b)))

    def resized(self, b: int) -> Lists:
        """Shorter lists drop their ends into the outer bound; longer ones have unknown entries behind the outer bound."""
        old = self.near.shape[1]
        if b <= old:
            return Lists(self.near[:, :b].copy(), self.bound[:, :b].copy())
        pad = ((0, 0), (0, b - old))
        return Lists(np.pad(self.near, pad, constant_values=-1), np.pad(self.bound, pad, mode="edge"))

    def moved(self, way: np.ndarray) -> None:
        """Loosen the bounds by how far each entry went (rounded up)."""
        own = np.where(self.near[:, 1:] >= 0, way[self.near[:, 1:]], way.max(initial=0))
        self.bound[:, :-1] -= own
        self.bound[:, -1] -= way.max(initial=0)
        self.bound = np.minimum.accumulate(self.bound[:, ::-1], axis=1)[:, ::-1] * (1 - ROOM) - ROOM

    def assign(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Settle every row. Gives the squared distance to its entry, and how many listed entries had to be compared (0: none, b + 1: all)."""
        b = self.near.shape[1]
        best = squared(x, entries[self.near[:, 0]][:, None, :])[:, 0]
        far = _above(best)
        clear = far[:, None] < self.bound
        first = np.where(clear.any(axis=1), clear.argmax(axis=1), b)
        needed = np.where(first == 0, 0, first + 1)
        for j in range(1, b):
            rows = np.flatnonzero(first == j)
            if len(rows):
                listed = self.near[rows, : j + 1].astype(np.int64)
                d = squared(x[rows], entries[listed])
                order = np.lexsort((listed, d))
                self.near[rows, : j + 1] = np.take_along_axis(listed, order, 1)
                d = np.take_along_axis(d, order, 1)
                best[rows] = d[:, 0]
                self.bound[rows, :j] = _below(d[:, 1:])
        rows = np.flatnonzero(first == b)
        if len(rows):
            d = squared(x[rows], entries)
            order = np.argsort(d, axis=1, kind="stable")
            d = np.take_along_axis(d, order, 1)
            known = min(b, len(entries))
            self.near[rows] = -1
            self.near[rows, :known] = order[:, :known]
            outer = _below(d[:, known]) if known < len(entries) else np.full(len(rows), np.inf)
            self.bound[rows] = outer[:, None]
            self.bound[rows, : known - 1] = _below(d[:, 1:known])
            best[rows] = d[:, 0]
        self.bound = np.minimum.accumulate(self.bound[:, ::-1], axis=1)[:, ::-1]
        return best, needed


def _limit(components: int) -> int:
    """The largest whole number whose squared distances, summed over a vector, fit a long."""
    return math.isqrt((2**63 - 1) // max(components, 1)) // 2


def _packed(whole: np.ndarray) -> pa.Array:
    """Rows of whole numbers as binaries that sort like the numbers: four bytes each, the highest first, sign turned."""
    return _binaries((whole + 2**31).astype(">u4"))


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(_joined(column), ">u4").astype(np.int64).reshape(len(column), width) - 2**31


def _joined(column: pa.Array) -> bytes:
    return b"".join(column.to_pylist())


def _binaries(rows: np.ndarray) -> pa.Array:
    """A binary for each row of an array."""
    width = rows.shape[1] * rows.itemsize if rows.ndim > 1 else rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _pack(given: str, packed: str):
    """Usable vectors as packed whole numbers; rows with other vectors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(given)
            column = batch.column(at)
            lengths = np.diff(np.asarray(column.offsets))
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero((lengths == length) & column.is_valid().to_numpy(zero_copy_only=False))
                flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = flat.reshape(len(rows), length)  # a null component reads as NaN
                fine = np.isfinite(x).all(axis=1)
                limit = _limit(length)
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(x[fine] * SCALE), -limit, limit).astype(np.int64)
                kept = batch.take(pa.array(rows[fine]))
                yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(kept.columns) if k != at], _packed(whole)], names=[*[n for n in batch.schema.names if n != given], packed])

    return run


def _stored(lists: list[Lists]) -> pa.Array:
    """The lists of a vector's parts as one binary: entries, then bounds in 32 bits, rounded down."""
    near = np.stack([one.near for one in lists], axis=1)
    bound = (np.stack([one.bound for one in lists], axis=1) * (1 - ROOM32)).astype("<f4")
    n = len(near)
    return _binaries(np.concatenate([near.reshape(n, -1).view(np.uint8), bound.reshape(n, -1).view(np.uint8)], axis=1))


def _restored(column: pa.Array, parts: int) -> list[Lists]:
    raw = np.frombuffer(_joined(column), np.uint8).reshape(len(column), parts, -1)
    b = raw.shape[2] // 5
    flat = raw.reshape(len(column), -1)
    near = flat[:, : parts * b].view(np.int8).reshape(len(column), parts, b)
    bound = np.ascontiguousarray(flat[:, parts * b :]).view("<f4").astype(np.float64).reshape(len(column), parts, b)
    return [Lists(near[:, p].copy(), bound[:, p].copy()) for p in range(parts)]


def _round(codebooks: list[np.ndarray], ways: list[np.ndarray], b: int, columns: dict[str, str], last: bool):
    """One pass: settle every part, and give lists and sums for the next round, or codes and errors in the last."""
    slices = np.cumsum([0, *[c.shape[1] for c in codebooks]]).tolist()
    entries = len(codebooks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((entries, c.shape[1] + 1), np.int64) for c in codebooks]
        compared = np.zeros(b + 2, np.int64)
        schema = None
        for batch in batches:
            schema, n = batch.schema, batch.num_rows
            if not n:
                continue
            names = schema.names
            x = _unpacked(batch.column(names.index(columns["whole"])), slices[-1])
            stored = batch.column(names.index(columns["lists"]))
            known = stored.null_count == 0
            settled, error = _restored(stored, len(codebooks)) if known else [Lists.unknown(n, b) for _ in codebooks], np.zeros(n, np.int64)
            for p, entry in enumerate(codebooks):
                part = x[:, slices[p] : slices[p + 1]]
                if known:
                    settled[p].moved(ways[p])
                    settled[p] = settled[p].resized(b)
                best, needed = settled[p].assign(part, entry)
                error += best
                if not last:
                    won = (settled[p].near[:, 0, None] == np.arange(entries)).astype(np.float64)
                    sums[p][:, 0] += won.sum(axis=0).astype(np.int64)
                    sums[p][:, 1:] += (won.T @ part).astype(np.int64)
                    compared += np.bincount(needed, minlength=b + 2) if known else 0
            keep = [c for c in names if c not in (columns.values() if last else (columns["lists"], columns["sums"]))]
            if last:
                codes = np.stack([lists.near[:, 0] for lists in settled], axis=1).astype(np.uint8)
                made = {"code": pa.array([row.tobytes().hex() for row in codes]), "error": pa.array(error)}
            else:
                made = {columns["lists"]: _stored(settled), columns["sums"]: pa.nulls(n, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], *made.values()], names=[*keep, *made])
        if schema is not None and not last:
            total = np.concatenate([*[s.ravel() for s in sums], compared])
            keep = [c for c in schema.names if c not in (columns["lists"], columns["sums"])]
            blank = [pa.nulls(1, schema.field(c).type) for c in keep] + [pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([total.tolist()], pa.list_(pa.int64()))], names=[*keep, columns["lists"], columns["sums"]])

    return run


def _next_codebooks(codebooks: list[np.ndarray], total: list[int]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """New entries (floors of means; unused ones stay), how far each went, and what is left of ``total``."""
    made, ways, at = [], [], 0
    for old in codebooks:
        entries, width = old.shape
        new = old.copy()
        for e in range(entries):
            count, *sums = total[at : at + width + 1]
            at += width + 1
            if count:
                new[e] = [s // count for s in sums]
        made.append(new)
        ways.append(_above(((new - old) ** 2).sum(axis=1)))
    return made, ways, total[at:]


def next_b(b: int, compared: list[int], entries: int) -> int:
    """The length of lists for the next round, from how many parts compared 0, 2, ... b or (last) all entries."""
    rows = sum(compared)
    if not rows:
        return b
    if compared[-1] > OVERRUN * rows:
        return min(2 * b, entries)
    settled, seen = sum(compared[2 : b + 1]), 0
    for j in range(2, b + 1):
        seen += compared[j]
        if seen >= SETTLED * settled:
            return j
    return b


def encode_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """The usable rows with ``ADDED`` (existing columns of these names are replaced).

    A component x counts as floor(4096 * x). ``code`` has two hex digits for each part, ``error`` the squared distances summed over parts,
    ``label_error`` those of a label, ``codebooks_sha256`` the digest of all entries.

    * Rows whose vector is null, or holds null or non-finite components, are left out, and so are vectors of another length than that of the smallest id.
    * The first entries are those of the smallest ids; a null id comes after all others, and rows that share an id go by their components. With fewer
      rows than entries, there are as many entries as rows.
    * Ties go to the lower entry. Repeated rows are coded alike and each count. Null labels are one label.
    * Whole numbers whose squared distances do not fit a long (for 64 components: beyond 1.8e8) count as the largest that do.
    * Parts of a length that does not divide evenly differ by one component. An empty table gives no rows.
    * Other columns are carried through every round, so leave out those that are not wanted.
    """
    if not 1 <= entries <= 128:
        raise ValueError("entries must be 1 to 128")
    vectors = prefixed(vectors, ADDED)
    spark = vectors.sparkSession
    columns = {k: unused(vectors, f"code_{k}") for k in ("whole", "lists", "sums")}
    given, ident = unused(vectors, "code_given"), F.col(f"`{id_col}`")
    carried = [StructField(f.name, f.dataType) for f in vectors.schema.fields]
    final = StructType([*carried, StructField("code", StringType()), StructField("error", LongType())])
    doubles = vectors.withColumn(given, F.col(f"`{vector_col}`").cast("array<double>"))
    written = scratch_path(spark, "codes")
    packed = StructType([*carried, StructField(columns["whole"], BinaryType())])
    doubles.mapInArrow(_pack(given, columns["whole"]), packed).write.parquet(written)
    table = spark.read.schema(packed).parquet(written)

    def smallest(rows: DataFrame) -> list[bytes]:
        by = [F.col("id").asc_nulls_last(), "v"]
        return [bytes(r["v"]) for r in rows.select(ident.alias("id"), F.col(columns["whole"]).alias("v")).orderBy(*by).limit(entries).collect()]

    first = smallest(table)
    if len({len(v) for v in first}) > 1:
        first = smallest(table.where(F.octet_length(columns["whole"]) == len(first[0])))
    if not first:
        return spark.createDataFrame([], StructType([*final.fields, StructField("label_error", LongType()), StructField("codebooks_sha256", StringType())]))
    size = len(first[0]) // 4
    start = _unpacked(pa.array(first, pa.binary()), size)
    codebooks = [start[:, s].copy() for s in part_slices(size, parts)]
    state = StructType([*packed.fields, StructField(columns["lists"], BinaryType()), StructField(columns["sums"], ArrayType(LongType()))])
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in state.fields[-2:]}
    ready = table.where(F.octet_length(columns["whole"]) == 4 * size).withColumns(nothing)

    b, ways = min(max(2, entries // 4), len(first)), [np.zeros(len(first))] * parts
    for _ in range(rounds):
        path = scratch_path(spark, "codes")
        ready.mapInArrow(_round(codebooks, ways, b, columns, False), state).write.parquet(path)
        table = spark.read.schema(state).parquet(path)
        sums = table.where(F.col(columns["sums"]).isNotNull()).select(F.posexplode(columns["sums"]).alias("at", "sum")).groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
        total = [int(r["sum"]) for r in sorted(sums.collect(), key=lambda r: r["at"])]
        codebooks, ways, compared = _next_codebooks(codebooks, total)
        b = next_b(b, compared, len(first))
        discard(spark, written)
        ready, written = table.where(F.col(columns["sums"]).isNull()), path

    path = scratch_path(spark, "coded")
    ready.mapInArrow(_round(codebooks, ways, b, columns, True), final).write.parquet(path)
    discard(spark, written)
    coded = spark.read.schema(final).parquet(path)
    by = unused(coded, "code_label")
    totals = coded.groupBy(F.col(f"`{label_col}`").alias(by)).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    digest = hashlib.sha256(",".join(str(v) for entry in codebooks for v in entry.ravel().tolist()).encode()).hexdigest()
    joined = coded.join(hold(totals, "label-errors"), F.col(f"`{label_col}`").eqNullSafe(F.col(by)))
    return joined.drop(by).withColumn("codebooks_sha256", F.lit(digest))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label")
    return encode_vectors(vectors).select("vec_id", *ADDED)


def _sql() -> str:
    """The rounds written out one after the other."""
    gap = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    text = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as materialized (select vec_id, p, w[p * len(w) // {PARTS} + 1 : (p + 1) * len(w) // {PARTS}] as v from kept, range({PARTS}) t(p)),
c0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, v as c from parts qualify e < {ENTRIES})"""
    for k in range(ROUNDS):
        text += f""",
a{k} as materialized (select vec_id, p, any_value(v) as v, arg_min(e, (d, e)) as e from (select vec_id, p, e, v, {gap} as d from parts join c{k} using (p)) group by 1, 2),
s{k} as (select p, e, i, sum(x)::hugeint as s, count(*)::hugeint as n from (select p, e, unnest(v) as x, generate_subscripts(v, 1) as i from a{k}) group by 1, 2, 3),
m{k} as (select p, e, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from s{k} group by 1, 2),
c{k + 1} as materialized (select c{k}.p, c{k}.e, coalesce(m{k}.c, c{k}.c) as c from c{k} left join m{k} using (p, e))"""
    return text + f""",
f as (select vec_id, p, min(d) as d, arg_min(e, (d, e)) as e from (select vec_id, p, e, {gap} as d from parts join c{ROUNDS} using (p)) group by 1, 2),
coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from f group by 1),
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from c{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (vec_id), digest
"""


SQL = _sql()
