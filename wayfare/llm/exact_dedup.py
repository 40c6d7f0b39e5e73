"""Exact duplicates by a two-pass Bloom filter, in DataFrame functions only.

Pass 1 sets bits. Every text has a 64-bit hash; part of it names a 64-bit word of the filter, the rest names ``BITS``
bits of that word. Counting how many rows set each bit (with partial aggregation, so a hot text costs one row a task)
leaves the filter of the bits that were set at least twice.

Pass 2 reads the rows again. A row whose bits were not all set twice has a text of its own and passes straight
through. Only the others shuffle, by the SHA-256 of their text, to be grouped exactly. False positives of the filter
cost a little shuffling and never change the result.

The filter has at most ``words`` 64-bit words, and only words with a bit set twice are broadcast: 16 bytes each, so
32 MB for the default of two million words, whatever the size of the input. Around one false positive in a hundred
rows is reached at some 30 million documents; a larger corpus wants a larger ``words``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.llm.tables import prefixed, text_of, unused

BITS = 3
ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def _word(hashed: Column, words: int) -> Column:
    return F.pmod(hashed, F.lit(words)).cast("int")


def _bit(hashed: Column, k: int) -> Column:
    """The k-th bit of a hash within its word: six bits of a second hash."""
    return F.shiftrightunsigned(F.xxhash64(hashed), 6 * k).bitwiseAND(F.lit(63)).cast("int")


def _flag(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def repeat_filter(texts: DataFrame, hashed: Column, words: int) -> DataFrame:
    """Words of the filter (``word``, ``bits``) that have a bit set by two rows or more."""
    slots = texts.select(
        _word(hashed, words).alias("word"), F.explode(F.array_distinct(F.array(*[_bit(hashed, k) for k in range(BITS)]))).alias("bit")
    )
    twice = slots.groupBy("word", "bit").count().where(F.col("count") > 1)
    return twice.groupBy("word").agg(F.bit_or(_flag(F.col("bit"))).alias("bits"))


def _mask(hashed: Column) -> Column:
    out = F.lit(0).cast("long")
    for k in range(BITS):
        out = out.bitwiseOR(_flag(_bit(hashed, k)))
    return out


def maybe_in(rows: DataFrame, key: Column, members: DataFrame, flag: str, words: int = 1 << 21) -> DataFrame:
    """Rows with a column ``flag``: false where ``key`` (a long) is surely not among ``members`` (one column of longs).

    A broadcast filter of bounded size decides. Every member is flagged, and few others are.
    """
    member = F.col(members.columns[0])
    word, mask, bits = (unused(rows, f"filter_{n}") for n in ("word", "mask", "bits"))
    seen = members.select(_word(member, words).alias(word), _mask(member).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    marked = rows.withColumn(word, _word(key, words)).withColumn(mask, _mask(key)).join(F.broadcast(seen), word, "left")
    found = F.coalesce(F.col(bits).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))
    return marked.withColumn(flag, found).drop(word, mask, bits)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 1 << 21) -> DataFrame:
    """All rows with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (existing columns of these names are replaced).

    Of rows with equal texts the one with the largest id stays.

    * A null text counts as empty, so all null and empty texts are one group.
    * A null id counts as smaller than any other; ``keep_id`` is null only where a whole group has null ids.
    * Rows that repeat both id and text are counted in ``group_size``; one of them has ``kept``, chosen by the hash of the other columns.
    * Long texts are hashed whole. An empty table gives no rows. Other columns pass through unchanged.
    """
    docs = prefixed(docs, ADDED)
    text, ident = text_of(text_col), F.col(f"`{id_col}`")
    hashed = F.xxhash64(text)
    flags, word = unused(docs, "repeat_bits"), unused(docs, "filter_word")
    seen = repeat_filter(docs, hashed, words).withColumnsRenamed({"word": word, "bits": flags})
    mask = _mask(hashed)
    marked = docs.withColumn(word, _word(hashed, words)).join(F.broadcast(seen), word, "left")
    maybe = F.coalesce(F.col(flags).bitwiseAND(mask) == mask, F.lit(False))

    alone = marked.where(~maybe).drop(word, flags).select("*", ident.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2(text, 256).alias("text_sha256"))
    again = marked.where(maybe).drop(word, flags).withColumn("text_sha256", F.sha2(text, 256))

    # A group's rows may be a third of the table. The second join column is a constant of the group: it makes both sides
    # of the join a plain exchange, which adaptive execution can split, instead of reusing the grouping's partitions.
    salt = unused(again, "text_bytes")
    groups = again.groupBy("text_sha256").agg(F.max(ident).alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max(F.octet_length(text)).alias(salt))
    joined = again.withColumn(salt, F.octet_length(text)).join(groups, ["text_sha256", salt])
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    place = unused(joined, "place")
    first = Window.partitionBy("text_sha256", ident).orderBy(F.xxhash64(*others))
    ranked = joined.withColumn(place, F.row_number().over(first))
    kept = ident.eqNullSafe(F.col("keep_id")) & (F.col(place) == 1)
    grouped = ranked.withColumn("kept", kept)
    return alone.unionByName(grouped.select(*alone.columns))


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
