"""SimHash near-duplicates found through an inverted index on byte positions, with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits differ in at most two bytes, so
they share at least ``8 - 2 = 6`` positional bytes. Lists of single bytes would hold a 256th of all fingerprints; the index therefore
posts groups of positional bytes: positions go by twos, and of the four twos at least two are shared whole, so a
posting under each choice of two twos (six for each fingerprint, four bytes each) brings every such pair together. In a list the shared positional bytes of every
pair are tallied, pairs that reach six are kept, and the differing bits of those are counted.

Copies collapse before the index: each distinct fingerprint is posted once. A list of more than ``LIST_ROWS`` fingerprints, as many variants of
one text make, is cut into blocks, and each pair of blocks is a list of its own. Pairs never leave a task: a spanning forest of a list's links does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.components import components
from wayfare.llm.tables import hold, low_hex, prefixed, text_of, unused

SEED = 42
#: Bits in which linked fingerprints may differ, and the positional bytes of eight that they must then share.
MOST_DIFFERENT = 2
LEAST_SHARED = 8 - MOST_DIFFERENT
#: Four positional bytes each: two of the twos (0, 1), (2, 3), (4, 5) and (6, 7).
GROUPS = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)]
#: Fingerprints of a block of a long list.
LIST_ROWS = 2_048
ADDED = ["fingerprint", "component_id"]
#: Hashes of a long text are counted in blocks of so many.
BLOCK = 1 << 16


def fingerprint(text: str, size: int = 3) -> int:
    """Majority bits of the shingles' hashes as a signed long; zero for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space are meant
    if not words:
        return 0
    shingles = [words] if len(words) < size else zip(*(words[i:] for i in range(size)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_of(text: Column, size: int = 3) -> Column:
    """Column of fingerprints (signed longs); the text must not be null."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, size) for t in texts), np.int64, len(texts)))

    return run(text)


def _key(number: Column, choice: int) -> Column:
    """The choice and its four positional bytes, packed in a long."""
    out = F.lit(choice).cast("long")
    for p in GROUPS[choice]:
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(number, 8 * p).bitwiseAND(F.lit(255)))
    return out


def spanning(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``size`` items reaches over the pairs (a, b)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def list_links(number: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside lists of fingerprints, reduced to one from each linked fingerprint to its list's first.

    ``number`` is that of a row's list; rows of a list stand together. Pairs are formed by their distance, for all lists at once.
    """
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, apart = np.arange(len(node)), 1
    while True:
        at = at[at + apart < len(node)]
        at = at[number[at] == number[at + apart]]
        if not len(at):
            break
        differ = node[at] ^ node[at + apart]
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # shared positional bytes
        kept = at[tally >= LEAST_SHARED]
        kept = kept[np.bitwise_count((node[kept] ^ node[kept + apart]).view(np.uint64)) <= MOST_DIFFERENT]
        found_a.append(kept)
        found_b.append(kept + apart)
        apart += 1
    root = spanning(len(node), np.concatenate(found_a), np.concatenate(found_b))
    linked = np.flatnonzero(root != np.arange(len(node)))
    return node[linked], node[root[linked]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists may cross batches: the last list of a batch waits for the next."""
    names = ["key", "low", "high", "node"]
    held = [np.zeros(0, np.int64) for _ in names]

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, low, high, node = columns
        fresh = np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
        a, b = list_links(np.cumsum(fresh), node)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held = [np.r_[h, batch.column(batch.schema.get_field_index(n)).to_numpy().astype(np.int64)] for h, n in zip(held, names)]
        if not len(held[0]):
            continue
        last = np.logical_and.reduce([h == h[-1] for h in held[:3]])
        cut = int(last.argmax())  # rows are sorted: the last list is the end of the batch
        if cut:
            yield out([h[:cut] for h in held])
        held = [h[cut:] for h in held]
    if len(held[0]):
        yield out(held)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that connect distinct fingerprints (``node``) wherever two differ in one or two bits."""
    postings = prints.select("node", F.explode(F.array(*[_key(F.col("node"), c) for c in range(len(GROUPS))])).alias("key"))
    long_lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST_ROWS)
    blocks = hold(long_lists.select("key", F.ceil(F.col("n") / LIST_ROWS).cast("int").alias("blocks")), "long-lists")
    cut = postings.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = cut.select("key", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    lists = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node")
    return lists.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_linked, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, carry: list[str] | None = None) -> DataFrame:
    """Rows with ``fingerprint`` (16 hex digits) and ``component_id`` (existing columns of these names are replaced).

    The component is the smallest id reachable over links of two or fewer differing bits. ``carry`` names the columns of the
    result besides these two (default: all).

    * A null text counts as empty; texts without words have fingerprint zero and link like any other.
    * Null ids count for nothing; ``component_id`` is null only where a component has no other.
    * Repeated rows and ties share their fingerprint and so their component. Texts are read whole, however long.
    * An empty table gives no rows. Other columns pass through unchanged.
    """
    docs = prefixed(docs, ADDED)
    node = unused(docs, "node")
    carried = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    printed = hold(docs.select(*carried, fingerprint_of(text_of(text_col), size).alias(node)), "printed")
    prints = hold(printed.groupBy(F.col(node).alias("node")).agg(F.min(F.col(f"`{id_col}`")).alias("value")), "fingerprints")
    classes = hold(components(fingerprint_links(prints), prints), "classes")
    classes = classes.select(F.col("node").alias(node), F.col("component").alias("component_id"))
    return printed.join(classes, node).withColumn("fingerprint", low_hex(F.col(node))).drop(node)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One document of each component: the one with the smallest id. Columns as given.

    Rows that repeat an id are one document and stay or go together.
    """
    grouped = simhash_groups(docs, id_col, text_col, size)
    return grouped.where(F.col(f"`{id_col}`").eqNullSafe(F.col("component_id"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return simhash_groups(docs, carry=["doc_id"]).select("doc_id", "fingerprint", "component_id")
