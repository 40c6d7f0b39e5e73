"""From raw documents to training tokens: reject toxic documents, drop exact and near copies, mix the sources, encode.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns a table; ``run`` writes what a stage keeps
to the shared folder and gives it to the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from wayfare.llm.tables import hold, unused
from wayfare.session import ensure_utc, ship_package


def _beside(docs: DataFrame, added: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``stage`` keeps, with the columns of ``docs``. Those named like a column the stage adds wait under free names."""
    names = {a.lower() for a in added}
    own = {c: unused(docs, f"own_{c}") for c in docs.columns if c.lower() in names}
    found = stage(docs.withColumnsRenamed(own))
    return found.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled documents, does not call toxic.

    A null or empty text has no words and stays. Texts are scored whole; equal texts and repeated rows stay or go together. No documents give
    no rows, and without labels nothing is toxic. Columns of any name keep their values.
    """
    model = toxicity.fit_from_tables(ship_package(spark), sf_dir)
    return _beside(docs, toxicity.ADDED, lambda d: toxicity.score(d, model).where(~F.col("toxic")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    Null and empty texts are equal. A null id is smaller than any other; of rows that repeat an id and a text one stays. Texts are compared
    whole. No documents give no rows. Columns of any name keep their values.
    """
    return _beside(docs, exact_dedup.ADDED, lambda d: exact_dedup.exact_dedup(d).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints that links connect, the document with the smallest id.

    Texts without words, null ones too, share a fingerprint and so a group. A row without an id stays only where its whole group has none; rows that
    repeat an id are one document. Texts are read whole. No documents give no rows. Columns of any name keep their values.
    """
    ship_package(spark)
    return _beside(docs, simhash.ADDED, simhash.simhash_dedup)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: documents as often as their source's target asks, range-sorted by the time they are due.

    Null sources are one source, the last. A null or empty text has no words and adds nothing where it is taken. Ties (equal ids) go by the text's
    hash. Long texts count all their words. No documents give no rows. Columns of any name keep their values.
    """
    return _beside(docs, [*mixing.ADDED, "position"], mixing.mix)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of tokens for each place of the sequence, with digests of the ids and of what they decode to.

    A null or empty text has no tokens. Texts are encoded whole, repeated rows alike, each in a row of its own. No documents give no rows; only the
    id and the source are carried along.
    """
    import public_tokenizers

    ship_package(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, round_trip=True)
    return found.select(
        "doc_id", "source", "n_tokens", "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: No SQL: fitting a model, hashing with XXH64 and merging by rank have none. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``."""
    docs = ensure_utc(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = hold(stage(spark, docs, sf_dir), name)
    return docs
