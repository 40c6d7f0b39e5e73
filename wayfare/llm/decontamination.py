"""Benchmark passages in training text, by a generalised suffix automaton of the test items' words.

One automaton holds every run of words of every item. A document streams through it: each word lengthens the match that ends there or
shortens it along suffix links, so the longest match at every word is known in time linear in the text. Where it reaches ``window``
words, the window that ends there occurs in an item, and the state of that length names the items. Items of fewer words
count where they occur whole.

Words that no item has end every match, so only runs of known words as long as the shortest thing to find enter the automaton.
Texts are cut into words piece by piece (``PIECE`` bytes), and only a number for each word is kept of a long text.

Items are dealt into shards of some ``SHARD_WORDS`` words by a running sum, so an automaton that is broadcast has a bounded size whatever the
benchmark's; longer items are cut into pieces that overlap by all but one word of a window. Documents stream through one shard after the other; with
more than one, what they found so far is kept in a column and written to the shared folder between shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from wayfare.llm.tables import ROWS, hold, prefixed, text_of, unused
from wayfare.operators.ordered import running

WINDOW = 10
SHARD_WORDS = 100_000
PIECE = 1 << 20
ADDED = ["n_words", "n_hit", "item_ids", "spans", "clean_text", "rejected"]
#: Bytes of words in UTF-8 after lower-casing: digits, a to z, and all bytes beyond ASCII. Other bytes part words.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text in UTF-8, a list for each piece of about ``PIECE`` bytes; a piece ends between words."""
    start = 0
    while start < len(raw):
        end = min(start + PIECE, len(raw))
        folded = raw[start:end].translate(_FOLD)
        while end < len(raw) and not folded.endswith(b" "):
            more = raw[end : end + PIECE].translate(_FOLD)
            cut = more.find(b" ") + 1 or len(more)
            folded, end = folded + more[:cut], end + cut
        yield folded.split()
        start = end


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window and of each short item."""

    def __init__(self, texts: Iterable[tuple[str | None, list[bytes]]], window: int):
        texts = [(item, words) for item, words in texts if words]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in texts]
        self.window = window
        self.shortest = min([window, *[len(words) for _, words in numbered]])
        for _, words in numbered:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: By state: items that have the window ending there; items of each length that end there whole.
        self.windows: dict[int, set] = {}
        self.whole: dict[int, dict[int, set]] = {}
        for item, words in numbered:
            if len(words) >= window:
                for _, state, _ in self.matches(words, window):
                    self.windows.setdefault(state, set()).add(item)
            else:
                *_, (_, state, _) = self.matches(words, len(words))
                self.whole.setdefault(state, {}).setdefault(len(words), set()).add(item)
        #: Short items (length, items) that end where a state ends: at the state itself or along its suffix links.
        self.shorts: list[list[tuple[int, set]]] = [[] for _ in self.link]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.shorts[self.link[state]]
            self.shorts[state] = [*self.whole[state].items(), *above] if state in self.whole else above

    def _extend(self, last: int, word: int) -> int:
        """The state of the sequence read so far and ``word``; states are cloned where a sequence needs a shorter one."""
        if word in self.next[last]:
            there = self.next[last][word]
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, word, there)
        state = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            there = self.next[at][word]
            self.link[state] = there if self.length[there] == self.length[at] + 1 else self._clone(at, word, there)
        return state

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, at: int, word: int, there: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest match that ends at each word, where it has ``least`` words; longer than a window counts as one."""
        state = length = 0
        following, link, lengths, window = self.next, self.link, self.length, self.window
        for place, word in enumerate(words):
            step = following[state].get(word)
            while step is None and state:
                state = link[state]
                length = lengths[state]
                step = following[state].get(word)
            if step is None:
                continue
            state, length = step, min(length + 1, window)
            while lengths[link[state]] >= length:
                state = link[state]
            if length >= least:
                yield place, state, length

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, runs of hit words (start, end), and the items found."""
        known = [np.fromiter((self.vocabulary.get(w, -1) for w in piece), np.int32, len(piece)) for piece in words_of(raw)]
        ids = np.concatenate(known) if known else np.zeros(0, np.int32)
        edge = np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8))
        runs: list[tuple[int, int]] = []
        items: set = set()
        for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if end - start >= self.shortest:
                for place, state, length in self.matches(ids[start:end].tolist(), self.shortest):
                    longest = 0
                    if length == self.window:
                        longest = length
                        items |= self.windows[state]
                    for size, owners in self.shorts[state]:
                        if size <= length:
                            longest = max(longest, size)
                            items |= owners
                    if longest:
                        _join(runs, start + place + 1 - longest, start + place + 1)
        return len(ids), runs, items


def _join(runs: list[tuple[int, int]], start: int, end: int) -> None:
    """Add a run that ends at or after all others; runs that touch become one."""
    while runs and runs[-1][1] >= start:
        start = min(start, runs.pop()[0])
    runs.append((start, end))


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b], key=lambda run: run[1]):
        _join(out, start, end)
    return out


def _pieces(window: int):
    """Items as pieces of bounded length, in normalised words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for piece in words_of(raw) for w in piece]
                cuts = [words[i : i + SHARD_WORDS + window - 1] for i in range(0, max(len(words) - window + 1, 1), SHARD_WORDS)]
                for cut in filter(None, cuts):
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item], pa.string()), "words": pa.array([b" ".join(cut)]), "n": pa.array([len(cut)])})

    return run


def shards(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces of the items (``item``, ``words``) with their ``shard``."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), text_of(text_col).cast("binary").alias("text"))
    pieces = items.mapInArrow(_pieces(window), "item string, words binary, n long").withColumn("whole", F.lit(0))
    summed = running(pieces, ["whole"], [F.xxhash64("item", "words"), "item", "words"], {"ahead": F.col("n")})
    return hold(summed.select("item", "words", F.floor((F.col("ahead") - F.col("n")) / SHARD_WORDS).alias("shard")), "benchmark")


_FOUND = "struct<words: bigint, runs: array<bigint>, items: array<string>>"
_FINAL = {"n_words": "bigint", "n_hit": "bigint", "item_ids": "array<string>", "spans": "array<struct<start: int, end: int>>", "clean_text": "string", "rejected": "boolean"}


def _final(raw: bytes, words: int, runs: list[tuple[int, int]], items: set, coverage: float) -> dict:
    """What a document is told: counts, spans in characters, the text without them, and whether too much of it is hit."""
    hit = sum(end - start for start, end in runs)
    spans, kept, at, chars = [], [], 0, 0
    if runs:
        places = iter(WORD_BYTES.finditer(raw.lower()))
        index, match = 0, next(places)
        for start, end in runs:
            while index < start:
                index, match = index + 1, next(places)
            first = match.start()
            while index < end - 1:
                index, match = index + 1, next(places)
            last = match.end()
            kept.append(raw[at:first])
            begin = chars + len(raw[at:first].decode(errors="replace"))
            chars = begin + len(raw[first:last].decode(errors="replace"))
            spans.append({"start": begin, "end": chars})
            at = last
    text = b"".join([*kept, raw[at:]]).decode(errors="replace")
    return {"n_words": words, "n_hit": hit, "item_ids": sorted(i for i in items if i is not None), "spans": spans, "clean_text": text, "rejected": hit > coverage * words}


def _stream(automaton, work: str, found: str, coverage: float | None):
    """A pass of documents through one shard; the last pass (``coverage`` given) gives the results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Automaton = automaton.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, out = part.schema.names, []
                for raw, before in zip(part.column(names.index(work)).to_pylist(), part.column(names.index(found)).to_pylist()):
                    words, runs, items = machine.scan(raw)
                    if before:
                        runs = _merged(runs, list(zip(before["runs"][::2], before["runs"][1::2])))
                        items = items | set(before["items"])
                    if coverage is None:
                        out.append({"words": words, "runs": [x for run in runs for x in run], "items": list(items)})
                    else:
                        out.append(_final(raw, words, runs, items, coverage))
                if coverage is None:
                    keep, columns = [n for n in names if n != found], {found: pa.array(out, part.schema.field(found).type)}
                else:
                    keep = [n for n in names if n not in (work, found)]
                    columns = {n: pa.array([o[n] for o in out], _ARROW[n]) for n in _FINAL}
                yield pa.RecordBatch.from_arrays([*[part.column(names.index(n)) for n in keep], *columns.values()], names=[*keep, *columns])

    return run


_ARROW = {
    "n_words": pa.int64(), "n_hit": pa.int64(), "item_ids": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
    "clean_text": pa.string(), "rejected": pa.bool_(),
}


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = 0.5
) -> DataFrame:
    """All rows with ``ADDED`` (existing columns of these names are replaced).

    A run of ``window`` words that an item has too, and a shorter item as a whole, are removed wherever they occur: ``spans`` has them in characters,
    ``clean_text`` the text without them, ``item_ids`` the items they come from. A document is ``rejected`` if more than ``coverage`` of its words are hit.

    * A null text counts as empty. Texts without words have no words, no hits, and are not rejected.
    * Items without words match nothing. An item without id hits words but is not listed; texts that share an id are one item.
    * Runs that overlap or touch are one span. Repeated documents are told the same. Long texts stream through like any other.
    * An empty table gives no rows; without items nothing is hit. Other columns pass through unchanged.
    """
    docs = prefixed(docs, ADDED)
    context = docs.sparkSession.sparkContext
    work = unused(docs, "leak_text")
    found = unused(docs, "leak_found")
    items = shards(benchmark, item_col, item_text_col, window)
    last = items.agg(F.max("shard")).first()[0] or 0
    current = docs.withColumns({work: text_of(text_col).cast("binary"), found: F.lit(None).cast(_FOUND)})
    for shard in range(last + 1):
        rows = items.where(F.col("shard") == shard).select("item", "words").collect()
        machine = context.broadcast(Automaton(((r["item"], bytes(r["words"]).split()) for r in rows), window))
        if shard < last:
            current = hold(current.mapInArrow(_stream(machine, work, found, None), current.schema), "leaks")
        else:
            schema = StructType([*docs.schema.fields, *[StructField(n, DataType.fromDDL(t)) for n, t in _FINAL.items()]])
            current = current.mapInArrow(_stream(machine, work, found, coverage), schema)
    return current


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
with word as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as upper_case, 'abcdefghijklmnopqrstuvwxyz' as lower_case, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' as pattern),
docs as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), upper_case, lower_case), pattern) as w from documents, word),
items as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), upper_case, lower_case), pattern) as w from benchmark, word),
windows as (
  select distinct item, w[i : i + 9] as words from (select item, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from items where len(w) > 0)),
sizes as (select distinct len(words) as size from windows),
places as (
  select row, i, w[i : i + size - 1] as words from (select row, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes where len(w) >= size)),
found as (select row, i, item, len(words) as size from places join windows using (words)),
hit as (select row, count(distinct k) as n_hit from (select row, unnest(range(i, i + size)) as k from found) group by 1),
named as (select row, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct row, item from found where item is not null) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (row) left join named using (row)
"""
