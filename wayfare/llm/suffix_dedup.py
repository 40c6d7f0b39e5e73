"""Exact substring dedup: every byte covered by a string of ``SPAN`` bytes that also starts elsewhere is removed.

Suffixes of the whole corpus are never gathered. Three steps bring together only what can be equal:

1. **Anchors.** Every window of ``SPAN`` bytes names one of its ``GRAM``-byte strings, the one with the smallest hash, leftmost if tied. Equal
   windows name equal strings at equal offsets. Neighbouring windows with the same anchor form a run; a run's windows together are its piece
   of text. Only hashes of anchors and pieces shuffle; an anchor that occurs once rules out its whole run.
2. **Equal pieces.** Runs with the same anchor and the same piece repeat each other wholly. That settles the inside of repeated
   passages and all copies, and leaves one piece of each kind.
3. **Suffix sorting.** Different pieces with the same anchor, as at the edges of passages, are cut from their documents and sorted by suffix in two stages
   (``suffix_sort``) in blocks of whole anchors; adjacent common prefixes of ``SPAN`` bytes mark the windows that repeat.

Documents in which nothing repeats pass straight through; a Bloom filter of bounded size tells which others have to shuffle.
Running sums of bytes only choose anchors, which equal windows do alike whatever their hashes. What is compared are 128 bits for pieces (XXH3 of the anchor
and of the piece, 64 bits each) and 128 bits of SHA-256 for texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.exact_dedup import maybe_in
from wayfare.llm.suffix_sort import Block
from wayfare.llm.tables import hold, map_column, prefixed, text_of, unused

SPAN, GRAM = 200, 64
#: Window starts handled at once, and bytes of pieces sorted at once.
PIECE, BLOCK = 1 << 19, 1 << 19
#: Different pieces of one anchor that are sorted together. Where an anchor has more, its windows are compared by 128-bit hashes
#: instead, which spread over all tasks; the result is the same.
MOST = 4_000
ADDED = ["kept_text", "removed"]
_TABLE = np.random.default_rng(20_240_229).integers(0, 2**64, 256, np.uint64)
_FACTOR = 0x9E3779B97F4A7C15


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, modulo 2**64, for the longest pack."""
    size = 2 * (PIECE + SPAN)
    up, down = np.full(size, _FACTOR, np.uint64), np.full(size, pow(_FACTOR, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _gram_ranks(raw: np.ndarray) -> np.ndarray:
    """A number for every string of ``GRAM`` bytes: differences of running sums. Equal strings have equal numbers, most others do not."""
    up, down = _powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=sums[1:])
    return _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) + 1 - GRAM])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: each is a suffix of one block of that width and a prefix of the next."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, x.max())]).reshape(-1, width)
    front = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])


def runs_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the texts laid end to end in ``raw``: first and last window start, anchor hash, piece hash, text number."""
    grams = _gram_ranks(raw)
    place = np.uint64((1 << 26) - 1)
    ranked = grams & ~place | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_minimum(ranked, SPAN - GRAM + 1) & place).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    whole = np.arange(len(anchor)) + SPAN <= ends[np.minimum(text, len(ends) - 1)]
    change = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(whole & change)
    following = np.r_[np.flatnonzero(change), len(anchor)]
    last = following[np.searchsorted(following, first, side="right")] - 1
    last = np.minimum(last, ends[text[first]] - SPAN)
    own = raw.tobytes()
    anchors = np.fromiter((xxhash.xxh3_64_intdigest(own[a : a + GRAM]) for a in anchor[first].tolist()), np.uint64, len(first))
    pieces = np.fromiter((xxhash.xxh3_64_intdigest(own[a : b + SPAN], 1) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
    return first, last, anchors.view(np.int64), pieces.view(np.int64), text[first]


def _packs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in packs of about PIECE bytes; longer ones in several packs that share SPAN - 1 bytes. Bytes, ends, numbers, offsets."""
    pack, ends, numbers, offsets, size = [], [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - SPAN + 1, PIECE):
            part = t[at : at + PIECE + SPAN - 1]
            pack.append(part)
            size += len(part)
            ends.append(size)
            numbers.append(i)
            offsets.append(at)
            if size >= PIECE:
                yield np.frombuffer(b"".join(pack), np.uint8), np.array(ends), np.array(numbers), np.array(offsets)
                pack, ends, numbers, offsets, size = [], [], [], [], 0
    if pack:
        yield np.frombuffer(b"".join(pack), np.uint8), np.array(ends), np.array(numbers), np.array(offsets)


_RUN = "text_id binary, anchor long, piece long, first int, last int, times int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each text. Of runs that a text repeats, one carries how many there are, and all are given with ``times`` 0 as settled."""
    for batch in batches:
        ids = batch.column("text_id")
        texts = batch.column("raw").to_pylist()
        for raw, ends, numbers, offsets in _packs(texts):
            first, last, anchor, piece, part = runs_of(raw, ends)
            begins = np.r_[0, ends[:-1]]
            shift = offsets[part] - begins[part]
            owner = numbers[part]
            order = np.lexsort((first, piece, anchor, owner))
            same = lambda x: x[order][1:] == x[order][:-1]
            fresh = np.r_[True, ~(same(owner) & same(anchor) & same(piece))]
            group = np.cumsum(fresh) - 1
            times = np.bincount(group)
            settled = order[(times > 1)[group]]
            rows = np.r_[order[fresh], settled]
            number = np.r_[times, np.zeros(len(settled), np.int64)]
            columns = [ids.take(pa.array(owner[rows])), anchor[rows], piece[rows], (first + shift)[rows].astype(np.int32), (last + shift)[rows].astype(np.int32), number.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([columns[0], *[pa.array(c) for c in columns[1:]]], names=["text_id", "anchor", "piece", "first", "last", "times"])


_CUT = "text_id binary, anchor long, times long, first int, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces that are to be sorted, cut from their texts."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for i, raw, pieces in zip(batch.column("text_id").to_pylist(), batch.column("raw").to_pylist(), batch.column("pieces").to_pylist()):
            for p in pieces:
                for column, value in zip(out, (i, p["anchor"], p["times"], p["first"], raw[p["first"] : p["last"] + SPAN])):
                    column.append(value)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["text_id", "anchor", "times", "first", "bytes"])


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both hashes of every window of the pieces."""
    for batch in batches:
        for text, times, first, raw in zip(*(batch.column(c).to_pylist() for c in ("text_id", "times", "first", "bytes"))):
            n = len(raw) - SPAN + 1
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + SPAN]) for i in range(n)), np.int64).reshape(n, 2)
            low, high = both[:, 0], both[:, 1]
            columns = [pa.array([text] * n, pa.binary()), np.full(n, times), np.arange(first, first + n, dtype=np.int32), low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["text_id", "times", "first", "low", "high"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window starts of pieces that repeat in another piece of the same anchor. Rows come sorted by anchor."""
    rows: list[tuple] = []
    size = 0

    def settle(block: list[tuple]) -> pa.RecordBatch:
        flags, texts, firsts, lasts = None, [], [], []
        if len(block) > 1:
            sorted_block = Block([r[4] for r in block], SPAN)
            flags = sorted_block.repeated()
            for start, end, (text, _, times, first, _) in zip(sorted_block.starts, sorted_block.ends, block):
                if times > 1:
                    continue  # equal pieces settled it
                marks = np.flatnonzero(np.diff(np.r_[False, flags[start:end], False]))
                for a, b in zip(marks[::2], marks[1::2]):
                    texts.append(text)
                    firsts.append(first + a)
                    lasts.append(first + b - 1)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], names=["text_id", "first", "last"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= BLOCK and row[1] != rows[-1][1]:
                yield settle(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield settle(rows)


def repeated_windows(texts: DataFrame) -> DataFrame:
    """``text_id``, ``first``, ``last``: window starts that occur elsewhere too. ``texts``: ``text_id`` and ``raw``, copies as further rows."""
    runs = texts.where(F.octet_length("raw") >= SPAN).mapInArrow(_runs, _RUN)
    shared = runs.where("times > 0").groupBy("anchor").agg(F.sum("times").alias("n"), F.min("piece").alias("low"), F.max("piece").alias("high")).where("n > 1")
    shared = hold(shared.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "anchors")
    live = hold(runs.join(shared, "anchor").select("text_id", "anchor", "piece", "first", "last", "times", "mixed"), "runs")
    # copies of a text repeat all its runs: the smallest place stands for them, and the times add up
    kinds = live.where("times > 0").groupBy("anchor", "piece", "mixed").agg(
        F.sum("times").alias("times"), F.min(F.struct("text_id", "first", "last")).alias("at")
    )
    kinds = hold(kinds, "pieces")
    equal = live.join(kinds.where("times > 1").select("anchor", "piece"), ["anchor", "piece"]).select("text_id", "first", "last")
    equal = equal.union(live.where("times = 0").select("text_id", "first", "last"))

    mixed = kinds.where("mixed").select("at.*", "anchor", "times")
    crowded = hold(mixed.groupBy("anchor").count().where(F.col("count") > MOST).select("anchor"), "crowded")
    found = equal.union(_cut_from(texts, mixed.join(crowded, "anchor", "left_anti")).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeats, "text_id binary, first int, last int"))
    if crowded.isEmpty():
        return found
    windows = _cut_from(texts, mixed.join(crowded, "anchor")).mapInArrow(_window_hashes, "text_id binary, times long, first int, low long, high long")
    again = hold(windows.groupBy("low", "high").agg(F.sum(F.least("times", F.lit(2))).alias("n")).where("n > 1").select("low", "high"), "windows")
    return found.union(windows.join(again, ["low", "high"]).select("text_id", "first", F.col("first").alias("last")))


def _cut_from(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The pieces at ``places``, cut from one row of each text."""
    wanted = places.groupBy("text_id").agg(F.collect_list(F.struct("anchor", "times", "first", "last")).alias("pieces"))
    wanted = hold(wanted, "wanted")
    sources = maybe_in(texts, F.xxhash64("text_id"), wanted.select(F.xxhash64("text_id").alias("id")), "maybe").where("maybe")
    sources = sources.groupBy("text_id").agg(F.first("raw").alias("raw"))
    return sources.join(wanted, "text_id").select("text_id", "raw", "pieces").mapInArrow(_cut, _CUT)


def _without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[dict]]:
    """The bytes outside the windows that start in the given ranges, and the removed runs."""
    merged: list[list[int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], last + SPAN)
        else:
            merged.append([first, last + SPAN])
    kept, at = [], 0
    for start, end in merged:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]]), [{"start": a, "end": b} for a, b in merged]


_REMOVED = "array<struct<start:int,end:int>>"


def remove_repeats(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows with ``kept_text`` (binary) and ``removed`` (byte ranges, end exclusive); existing columns of these names are replaced.

    ``carry`` names the columns of the result besides these two (default: all).

    * A null text counts as empty; texts shorter than a window have nothing removed.
    * Copies, repeated rows among them, repeat each other, so all of a copied text of a window's length or more goes.
    * Texts are read whole, however long. An empty table gives no rows. Other columns pass through unchanged.
    """
    docs = prefixed(docs, ADDED)
    ident, ranges, flag, work = (unused(docs, n) for n in ("text_id", "repeat_ranges", "maybe", "text_and_ranges"))
    raw = text_of(text_col).cast("binary")
    text_id = F.unhex(F.substring(F.sha2(raw, 256), 1, 32))
    texts = docs.select(text_id.alias("text_id"), raw.alias("raw"))
    slim = texts.select("text_id", F.octet_length("raw").alias("size"))
    copies = slim.groupBy("text_id").agg(F.count(F.lit(1)).alias("copies"), F.max("size").alias("size")).where("copies > 1")
    copies = hold(copies.select("text_id", "size"), "copies")

    alone = repeated_windows(texts).join(copies.select("text_id"), "text_id", "left_anti")
    spans = alone.groupBy("text_id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    all_of_it = copies.where(F.col("size") >= SPAN).select("text_id", F.array(F.struct(F.lit(0).alias("first"), (F.col("size") - SPAN).alias("last"))).alias("spans"))
    cuts = hold(spans.union(all_of_it), "cuts")

    columns = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    touched = maybe_in(docs.withColumn(ident, text_id), F.xxhash64(ident), cuts.select(F.xxhash64("text_id").alias("id")), flag)
    same = touched.where(~F.col(flag)).select(*columns, raw.alias("kept_text"), F.array().cast(_REMOVED).alias("removed"))

    def cut(pairs: pa.Array) -> list[pa.Array]:
        kept, removed = [], []
        for pair in pairs.to_pylist():
            left, gone = _without(pair["raw"], [(s["first"], s["last"]) for s in pair["spans"] or ()])
            kept.append(left)
            removed.append(gone)
        return [pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    joined = touched.where(flag).join(cuts.select(F.col("text_id").alias(ident), F.col("spans").alias(ranges)), ident, "left")
    pair = F.struct(raw.alias("raw"), F.col(ranges).alias("spans")).alias(work)
    return same.unionByName(map_column(joined.select(*columns, pair), work, {"kept_text": "binary", "removed": _REMOVED}, cut))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"), carry=["doc_id"])
    removed: Column = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", (F.octet_length("kept_text") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_text", 256).alias("kept_sha256"),
    )
