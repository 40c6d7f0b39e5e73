"""Token counts of a unigram tokenizer without building its tokens.

The tokenizer is a unigram model over a vocabulary with scores, words marked by a leading block, unknown characters as bytes.
An Aho-Corasick automaton enumerates all pieces that occur in a word; a pass over the word's ends carries, for each end, the
best score and the number of pieces on the way to it.

Tie rules of the tokenizer: among ways of equal score the one whose last piece starts first wins. A character that is no piece
itself may also be unknown, at ten below the lowest score; it then counts one for each of its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.tables import prefixed, text_of

BLOCK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words a worker remembers before it starts afresh, and the longest one it remembers.
REMEMBERED, LONGEST = 400_000, 64


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces on the best way through one word, which starts with a block."""
        size = len(word)
        best, count = [0.0] + [None] * size, [0] * (size + 1)
        found = self.matches.iter(word)
        last, (length, score) = next(found, (size, (0, 0.0)))
        for end in range(size):
            top, n = None, 0
            while last == end:  # longest match first, so the earliest start is tried first
                way = score + best[end + 1 - length]
                if top is None or way > top:
                    top, n = way, count[end + 1 - length] + 1
                last, (length, score) = next(found, (size, (0, 0.0)))
            if word[end] not in self.single:
                way = self.unknown + best[end]
                if top is None or way > top:
                    top, n = way, count[end] + len(word[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, n
        return count[size]

    def text(self, text: str) -> int:
        marked = text.replace(" ", BLOCK)
        if not marked:
            return 0
        words = marked.split(BLOCK)
        total, known = 0, self.known
        for w in words[1:] if marked[0] == BLOCK else words:
            n = known.get(w)
            if n is None:
                n = self.word(BLOCK + w)
                if len(w) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = n
            total += n
        return total


_COUNTERS: dict[int, Counter] = {}


def _counter(pieces: list[tuple[str, float]]) -> Counter:
    key = hash(tuple(pieces))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(pieces)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Rows with the number of tokens of each text; an existing column of the name is replaced.

    A null text counts as empty, which has none. Texts are counted whole; a word without blanks takes memory in proportion
    to its length. Repeated rows count alike. An empty table gives no rows. ``vocabulary`` is the path of a model file, read
    on the driver; its pieces (bounded by the vocabulary) go to the executors once.
    """
    docs = prefixed(docs, [out_col])
    shipped = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(shipped.value)
        for texts in batches:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    return docs.withColumn(out_col, tokens(text_of(text_col)))


def op7_token_counts(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return count_tokens(docs, vocabulary or public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")
