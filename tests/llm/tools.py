"""Tables that the tests of the training-text operators share."""

from pyspark.sql import types as T

#: Names that operators use inside or add; a table may have columns of these names too.
CLASHING = (
    "keep_id group_size kept text_sha256 repeat_bits filter_word filter_mask filter_bits place text_bytes node fingerprint component_id severity toxic "
    "toxicity_text size taken target offset mix_key mix_start n_tokens token_ids bpe_text bpe_ids decoded spans pii_text kept_text removed text_id raw "
    "repeat_ranges maybe text_and_ranges passages n_links class_id uid value position emb_class emb_vector"
).split()

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in CLASHING]
)

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper katsura larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(seed: int, words: int) -> str:
    """Words in an order that depends on the seed; five in a row hardly ever repeat."""
    state, out = seed * 2_654_435_761 % 2**32 or 1, []
    for _ in range(words):
        state = (state * 1_664_525 + 1_013_904_223) % 2**32
        out.append(WORDS[state >> 16 & 15] + str(state >> 20 & 63))
    return " ".join(out)


def table(spark, rows):
    """Rows of (doc_id, text, source), with a filled column of every clashing name."""
    return spark.createDataFrame([(*row, *(f"own {name}" for name in CLASHING)) for row in rows], SCHEMA)


def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = prose(99, 30_000)
    return [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \n\t ", None),
        (4, prose(4, 120), "b"),
        (5, prose(4, 120), "b"),
        (5, prose(4, 120), "b"),
        (6, prose(6, 90), None),
        (None, prose(6, 90), "c"),
        (None, None, None),
        (7, long_text, "b"),
        (8, long_text + " tail", "a"),
        (9, "one", "c"),
        (9, "another text under the same id", "c"),
    ]
