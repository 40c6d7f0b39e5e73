"""Places and running sums along ordered groups of any length.

Rows are range-partitioned by (group, order), so a long group is dealt over many tasks. Each task numbers its own rows; what a group
had before a partition is carried over from the partitions' last rows, one small row for each partition. No task or row ever holds a
group, and nothing is shuffled a second time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from wayfare.session import materialize

#: Bits of ``_edge``: first row of its partition, last row of its partition, row of the partition's first group.
FIRST, LAST, OPENS = 1, 2, 4


def _starts(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """True where a row's group differs from that of the row before it; ``before`` is the group of the row before the batch."""
    n = len(columns[0])
    differs = np.zeros(n, bool)
    for c in columns:
        later, earlier = c.slice(1), c.slice(0, n - 1)
        unequal = pc.fill_null(pc.not_equal(later, earlier), False).to_numpy(zero_copy_only=False)
        differs[1:] |= unequal | (pc.is_null(later).to_numpy(zero_copy_only=False) != pc.is_null(earlier).to_numpy(zero_copy_only=False))
    differs[0] = before is None or tuple(c[0].as_py() for c in columns) != before
    return differs


def _local(group: Sequence[str], sums: Sequence[str], xors: Sequence[str]):
    """Running values within the groups of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, opens = TaskContext.get().partitionId(), None, True
        base = {name: 0 for name in (*sums, *xors)}
        waiting: tuple[dict, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(batch.schema.get_field_index(g)) for g in group]
            starts = _starts(keys, before)
            at = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), -1))
            edge = np.zeros(len(starts), np.int32)
            if before is None:
                edge[0], starts[0] = FIRST, False
            edge[(np.cumsum(starts) == 0) & opens] |= OPENS
            opens = opens and not starts.any()
            columns = dict(zip(batch.schema.names, batch.columns))
            for name in base:
                own = np.asarray(columns[name].fill_null(0), np.int64)
                step, undo = (np.add, np.subtract) if name in sums else (np.bitwise_xor, np.bitwise_xor)
                through = step.accumulate(own)
                ahead = undo(through, own)
                value = np.where(at >= 0, undo(through, ahead[np.maximum(at, 0)]), step(through, base[name]))
                base[name], columns[name] = int(value[-1]), pa.array(value)
            before = tuple(k[len(starts) - 1].as_py() for k in keys)
            if waiting is not None:
                yield _closed(*waiting, part)
            waiting = columns, edge
        if waiting is not None:
            waiting[1][-1] |= LAST
            yield _closed(*waiting, part)

    return run


def _closed(columns: dict, edge: np.ndarray, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns.values(), pa.array(np.full(len(edge), part, np.int32)), pa.array(edge)], names=[*columns, "_part", "_edge"])


def running(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None
) -> DataFrame:
    """``rows`` with running values within each group, up to and including the row: sums and exclusive ors of longs.

    Nulls of ``group`` and ``order`` come first and make groups of their own; a null value counts as 0. Rows that tie in ``order`` follow one
    another in any order. The result is a table in the shared folder, so that places stay as they were given out.
    """
    sums, xors = sums or {}, xors or {}
    added = {**sums, **xors}
    by = [*[F.col(g) for g in group], *order]
    ranged = rows.select("*", *[c.cast("long").alias(name) for name, c in added.items()]).repartitionByRange(*by).sortWithinPartitions(*by)
    schema = StructType([*ranged.schema.fields, StructField("_part", IntegerType()), StructField("_edge", IntegerType())])
    local = materialize(ranged.mapInArrow(_local(group, list(sums), list(xors)), schema), "running")
    edges = local.where(F.col("_edge").bitwiseAND(FIRST | LAST) > 0).select("_part", "_edge", *group, *added).collect()
    carried = [(part, *values) for part, values in _carried(edges, group, list(sums), list(xors)).items()]
    carries = rows.sparkSession.createDataFrame(carried, "_part int" + "".join(f", _carry_{name} long" for name in added))
    joined = local.join(F.broadcast(carries), "_part", "left")
    opens = F.col("_edge").bitwiseAND(OPENS) > 0

    def final(name: str) -> Column:
        carry = F.when(opens, F.coalesce(F.col(f"_carry_{name}"), F.lit(0))).otherwise(0)
        return (F.col(name) + carry if name in sums else F.col(name).bitwiseXOR(carry)).alias(name)

    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[final(name) for name in added])


def _carried(edges: list, group: Sequence[str], sums: list[str], xors: list[str]) -> dict[int, tuple]:
    """What the first group of each partition had before it. ``edges`` are the first and last rows of partitions."""
    out: dict[int, tuple] = {}
    key, held = None, ()
    for row in sorted(edges, key=lambda e: (e["_part"], e["_edge"] & LAST)):
        own = tuple(row[g] for g in group)
        if row["_edge"] & FIRST and own == key:
            out[row["_part"]] = held
        if row["_edge"] & LAST:
            before = out.get(row["_part"], ()) if row["_edge"] & OPENS else ()
            ends = [(row[n], 0 if not before else before[k]) for k, n in enumerate([*sums, *xors])]
            held = tuple(a + b if k < len(sums) else a ^ b for k, (a, b) in enumerate(ends))
            key = own
    return out


def with_place(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], place: str = "position") -> DataFrame:
    """``rows`` with each row's place in its group, counted from 0."""
    return running(rows, group, order, {place: F.lit(1)}).withColumn(place, F.col(place) - 1)
