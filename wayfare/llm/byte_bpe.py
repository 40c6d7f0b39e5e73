"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

A rank file lists byte strings and their ranks. Each byte becomes one printable character, each byte string a piece of such
characters with the score ``-rank``: the model's best merge is then the merge of the lowest rank, leftmost first. The model has
no normalisation of any kind. A text is cut into pre-tokens by the given pattern; a pre-token that is itself in the
vocabulary is that id, as tiktoken has it, and every other one is encoded by the model. Decoding joins the byte strings of the ids.

The model is some 1.5 MB, bounded by the vocabulary, and goes to the executors once.
"""

from __future__ import annotations

import base64
import struct
from array import array

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.tables import map_column, prefixed, text_of, unused

UNKNOWN = "<unknown>"
#: Pre-tokens a worker remembers before it starts afresh.
REMEMBERED = 150_000
ADDED = ["n_tokens", "token_ids"]


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable Latin-1, else the next free one from 256 up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank. Ranks must run from 0 without gaps."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes, a whole number, or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(pieces: list[bytes]) -> bytes:
    """A serialised BPE model of these byte strings; ids are ranks, and one unknown piece follows them."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, "".join(chars[b] for b in p).encode()) + _field(2, float(-i)) + _field(3, normal)) for i, p in enumerate(pieces)]
    out.append(_field(1, _field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(45, UNKNOWN.encode())
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids and ids to bytes. Unknown bytes (of a vocabulary without all 256) raise an error."""

    def __init__(self, model: bytes, pieces: list[bytes], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = pieces
        self.whole = {p: i for i, p in enumerate(pieces)}
        self.find = regex.compile(pattern).findall
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, array] = {}

    def _learn(self, tokens: set[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        hard = []
        for t, b in zip(tokens, raw):
            if (i := self.whole.get(b)) is not None:
                self.known[t] = array("I", (i,))
            else:
                hard.append((t, b.decode("latin-1").translate(self.chars)))
        for (t, _), ids in zip(hard, self.model.encode([m for _, m in hard], num_threads=1)):
            if len(self.pieces) in ids:
                raise ValueError(f"no piece for a byte of {t!r}")
            self.known[t] = array("I", ids)

    def encode(self, text: str) -> array:
        tokens = self.find(text)
        new = set(tokens).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set(tokens)
        if new:
            self._learn(new)
        ids = array("I")
        for piece in map(self.known.__getitem__, tokens):
            ids.extend(piece)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_CODECS: dict[tuple[int, int, str], Codec] = {}


def _codec(model: bytes, pieces: list[bytes], pattern: str) -> Codec:
    """The worker's codec for this model: loading takes a tenth of a second, so it outlives the task."""
    key = (len(model), hash(model), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, pieces, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """Rows with ``n_tokens`` and ``token_ids`` (binary: ids as little-endian unsigned 32-bit integers); see ``ids_of``.

    Existing columns of these names are replaced. A null text counts as empty, which has no tokens. Texts are encoded
    whole, however long. Repeated rows encode alike. An empty table gives no rows.
    ``vocabulary`` is the path of a rank file, read on the driver. With ``round_trip`` the ids are decoded again in the same pass, as
    ``decode`` would, to the column ``decoded``: one Python process for a task instead of two.
    """
    added = {"n_tokens": "long", "token_ids": "binary"} | ({"decoded": "binary"} if round_trip else {})
    docs = prefixed(docs, list(added))
    pieces = read_ranks(vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast((model_bytes(pieces), pieces, pattern))

    def tokens(texts: pa.Array) -> list[pa.Array]:
        codec = _codec(*shipped.value)
        ids = [codec.encode(t) for t in texts.to_pylist()]
        columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([np.asarray(x, "<u4").tobytes() for x in ids], pa.binary())]
        return columns + ([pa.array([codec.decode(x) for x in ids], pa.binary())] if round_trip else [])

    work = unused(docs, "bpe_text")
    return map_column(docs.withColumn(work, text_of(text_col)), work, added, tokens)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Rows with ``decoded`` (binary): the bytes that ``token_ids`` stand for. Null ids count as none."""
    encoded = prefixed(encoded, [out_col])
    shipped = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def text_bytes(column: pa.Array) -> list[pa.Array]:
        pieces = shipped.value
        return [pa.array([b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in column.to_pylist()], pa.binary())]

    work = unused(encoded, "bpe_ids")
    return map_column(encoded.withColumn(work, F.coalesce(F.col(f"`{ids_col}`"), F.lit(b""))), work, {out_col: "binary"}, text_bytes)


def ids_of(token_ids: str = "token_ids"):
    """The packed ids as an array of longs, for small results: four bytes each, lowest first."""
    hexed = F.hex(F.col(token_ids))
    count = (F.length(hexed) / 8).cast("int")

    def number(i):
        at = i * 8 + 1
        flipped = F.concat(*[F.substr(hexed, at + k, F.lit(2)) for k in (6, 4, 2, 0)])
        return F.conv(flipped, 16, 10).cast("long")

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), number)).otherwise(F.array().cast("array<long>"))


def op5_byte_bpe(spark: SparkSession, folder: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = encode(docs, path, pattern or public_tokenizers.PATTERN, round_trip=True)
    return found.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
