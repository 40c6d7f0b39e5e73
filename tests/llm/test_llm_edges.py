"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing column names and empty tables."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tools import CLASHING, SCHEMA, edge_rows, table

import corpus_pipeline
from wayfare.llm import byte_bpe, compact_windows, exact_dedup, mixing, pii, simhash, suffix_dedup, token_counts, toxicity

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
NO_WORDS = toxicity.fit([], toxicity.np.zeros(0, int))

OPERATORS = {
    "exact_dedup": (exact_dedup.exact_dedup, exact_dedup.ADDED),
    "toxicity": (lambda d: toxicity.score(d, NO_WORDS), toxicity.ADDED),
    "simhash": (simhash.simhash_groups, simhash.ADDED),
    "mixing": (mixing.plan_mix, mixing.ADDED),
    "byte_bpe": (lambda d: byte_bpe.decode(byte_bpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS), [*byte_bpe.ADDED, "decoded"]),
    "compact_windows": (compact_windows.near_passages, compact_windows.ADDED),
    "token_counts": (lambda d: token_counts.count_tokens(d, MODEL), ["n_tokens"]),
    "pii": (pii.find_pii, pii.ADDED),
    "suffix_dedup": (suffix_dedup.remove_repeats, suffix_dedup.ADDED),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_columns_survive(spark, name):
    operator, added = OPERATORS[name]
    docs = table(spark, edge_rows())
    found = operator(docs)
    assert set(found.columns) == set(docs.columns) | set(added)
    assert len(found.columns) == len(set(found.columns))
    rows = found.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter(edge_rows())
    for c in set(CLASHING) - set(added):
        assert {r[c] for r in rows} == {f"own {c}"}, c


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name][0](spark.createDataFrame([], SCHEMA)).count() == 0


def rows_of(frame):
    return frame.collect()


def test_exact_dedup_values(spark):
    found = rows_of(exact_dedup.exact_dedup(table(spark, edge_rows())))
    empty = [r for r in found if not r.text]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in empty} == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False)}
    tied = [r for r in found if r.doc_id == 5]
    assert [r.group_size for r in tied] == [3, 3] and sorted(r.kept for r in tied) == [False, True]
    assert [(r.keep_id, r.kept) for r in found if r.doc_id is None and r.text] == [(6, False)]
    assert all(r.kept and r.keep_id == 9 for r in found if r.doc_id == 9)


def test_simhash_values(spark):
    found = rows_of(simhash.simhash_groups(table(spark, edge_rows())))
    blank = [r for r in found if not (r.text or "").strip()]
    assert {r.fingerprint for r in blank} == {"0" * 16} and {r.component_id for r in blank} == {1}
    assert {r.component_id for r in found if r.doc_id in (4, 5)} == {4}
    assert {r.component_id for r in found if r.doc_id in (7, 8)} == {7}
    assert [r.component_id for r in found if r.doc_id is None and r.text] == [6]


def test_mixing_values(spark):
    found = rows_of(mixing.plan_mix(table(spark, edge_rows())))
    assert all(r.size == 0 and r.taken == 0 for r in found if not (r.text or "").strip())
    assert all(r.taken in (0, r.size, 2 * r.size) and len(r.positions) <= 2 for r in found)
    nothing = rows_of(mixing.plan_mix(table(spark, [(1, None, "a"), (2, " ", None)])))
    assert [(r.size, r.source_size, r.target, r.taken) for r in nothing] == [(0, 0, 0.0, 0)] * 2


def test_bpe_pii_and_counts_of_nothing(spark):
    docs = table(spark, edge_rows())
    for r in rows_of(OPERATORS["byte_bpe"][0](docs)):
        assert bytes(r.decoded) == (r.text or "").encode()
        assert (r.n_tokens == 0) == (not r.text) and len(r.token_ids) == 4 * r.n_tokens
    assert all(r.n_tokens == 0 for r in rows_of(OPERATORS["token_counts"][0](docs)) if not r.text)
    assert all(r.spans == [] for r in rows_of(pii.find_pii(docs)) if not r.text)


def test_substring_values(spark):
    found = rows_of(suffix_dedup.remove_repeats(table(spark, edge_rows())))
    assert all(r.removed == [] and bytes(r.kept_text) == (r.text or "").encode() for r in found if len((r.text or "").encode()) < 200)
    assert all(bytes(r.kept_text) == b"" for r in found if r.doc_id in (4, 5, 7))
    assert {bytes(r.kept_text) for r in found if r.doc_id == 8} == {b" tail"}


def test_passage_values(spark):
    found = rows_of(compact_windows.near_passages(table(spark, edge_rows())))
    assert {(r.class_id, r.n_links) for r in found if r.doc_id in (4, 5)} == {(4, 1)}
    assert {r.class_id for r in found if r.doc_id in (7, 8)} == {7}
    assert [(r.class_id, r.n_links) for r in found if r.doc_id is None and r.text] == [(6, 1)]
    assert all(r.passages == [] and r.n_links == 0 for r in found if len((r.text or "").split()) < 50)


def test_stages_of_the_pipeline(spark, tmp_path):
    """Each stage returns the columns of documents, on edge rows and on no rows at all."""
    folder = str(tmp_path)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = table(spark, edge_rows()).selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "length(text) as n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for start in (docs, docs.limit(0)):
        current = start
        for name, stage in corpus_pipeline.STAGES:
            current = stage(spark, current, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert current.columns == columns, name
        assert (current.count() == 0) == (start is not docs)


def test_columns_of_any_name_pass_through_the_pipeline(spark, tmp_path):
    """Columns that an operator uses for itself are columns of the documents like any other, with their values."""
    own = "size position kept keep_id group_size toxic severity p_toxic fingerprint component_id taken positions target text_sha256".split()
    folder = str(tmp_path)
    docs = table(spark, edge_rows()).select("doc_id", "text", "source")
    for name in own:
        docs = docs.withColumn(name, F.concat(F.lit(f"own {name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.select("doc_id", "text").write.parquet(f"{folder}/documents.parquet")
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, folder)
        assert current.columns == docs.columns, name
        for r in current.collect():
            assert [r[c] for c in own] == [f"own {c} {'none' if r.doc_id is None else r.doc_id}" for c in own], name
