"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A text has a severity grade 0..3. One weight vector is shared by all thresholds: ``P(grade > k) = sigmoid(w . x - theta_k)`` with
``theta_0 < theta_1 < theta_2``. The score of a text is its expected severity, the sum of these probabilities; the text is toxic if
``P(grade > 0)`` reaches the cut.

Features are the distinct words of a text and their leading 4 to 8 letters, hashed into a fixed table. The given labels say toxic or
not. A toxic text's grade is the third of the labelled toxic texts it falls in by its score under a model that was fitted, on the labels alone,
without that text and its copies (two folds by a hash of the features): how sure others' labels make one of it. Non-toxic texts are grade 0. With graded labels, ``fit``
takes them as they are.

The fit sees at most ``FIT_ROWS`` labelled texts (chosen by hash) and runs on the driver: a bounded sample and a table of fixed size. Scoring runs over all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.tables import hold, map_column, prefixed, text_of, unused

FIT_ROWS = 20_000
TABLE = 1 << 18
GRADES = 4
CUT = 0.5
#: Steps of a fit whose scores only put texts in order.
FOLD_ROUNDS = 300
ADDED = ["severity", "p_toxic", "toxic"]
_WORD = re.compile(r"\w+")


def features(text: str) -> np.ndarray:
    """Sorted slots of the text's words and their beginnings."""
    words = set(_WORD.findall(text.lower()))
    parts = words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in (4, 5, 6, 7, 8)))
    return np.unique(np.fromiter((crc32(p.encode("utf-8", "surrogatepass")) % TABLE for p in parts), np.int64, len(parts)))


@dataclass(frozen=True)
class Model:
    """Weights by slot (zero where absent) and the rising thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, slots: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[slots].sum(), -40, 40)))


def chosen_slots(seen: np.ndarray, bad: np.ndarray, rows: int, toxic: int, least: int = 4, deviations: float = 4.0) -> np.ndarray:
    """Which slots occur in toxic texts more often than chance explains; the many others would only add noise.

    ``seen`` and ``bad``: the texts and the toxic texts that have the slot, out of ``rows`` and ``toxic``.
    """
    expected = seen * (toxic / max(rows, 1))
    return (bad >= least) & (bad - expected > deviations * np.sqrt(expected + 0.25))


def grades_of(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grade 0 for texts that aren't toxic; thirds of the toxic ones by their score under a model of the other fold. Texts of equal features share a fold."""
    fold = np.array([crc32(s.tobytes()) & 1 for s in rows], np.int64)
    score = np.zeros(len(rows))
    for f in (0, 1):
        others = [k for k in range(len(rows)) if fold[k] != f]
        model = fit([rows[k] for k in others], toxic[others].astype(np.int64), rounds=FOLD_ROUNDS)
        mine = np.flatnonzero(fold == f)
        score[mine] = [model.weights[rows[k]].sum() for k in mine]
    grades = np.zeros(len(rows), np.int64)
    if toxic.any():
        grades[toxic] = 1 + np.searchsorted(np.quantile(score[toxic], [1 / 3, 2 / 3]), score[toxic], side="left")
    return grades


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 1500, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """Maximum likelihood with a ridge penalty, by Adam on the whole sample. Thresholds stay in order: they are sums of exponentials.

    With no texts, none above grade 0, or no features, nothing is toxic.
    """
    if not len(rows) or not (grades > 0).any() or not sum(map(len, rows)):
        return Model(np.zeros(TABLE), np.full(GRADES - 1, 30.0) + np.arange(GRADES - 1))
    used = np.unique(np.concatenate(rows))
    slot = np.full(TABLE, -1)
    slot[used] = np.arange(len(used))
    flat = slot[np.concatenate(rows)]
    row = np.repeat(np.arange(len(rows)), [len(s) for s in rows])
    levels = np.arange(GRADES - 1)
    above = grades[:, None] > levels
    weights, steps = np.zeros(len(used)), np.array([2.0, 0.0, 0.0])
    params = np.r_[weights, steps]
    first, second = np.zeros_like(params), np.zeros_like(params)
    for turn in range(1, rounds + 1):
        weights, steps = params[: len(used)], params[len(used) :]
        theta = steps[0] + np.r_[0, np.cumsum(np.exp(steps[1:]))]
        score = np.bincount(row, weights[flat], len(rows))
        p = 1 / (1 + np.exp(np.clip(theta - score[:, None], -40, 40)))  # P(grade > k)
        upper, lower = np.c_[np.ones(len(rows)), p], np.c_[p, np.zeros(len(rows))]
        at = np.arange(len(rows)), grades
        mass = np.maximum(upper[at] - lower[at], 1e-12)
        slope = p * (1 - p)
        up, low = np.c_[np.zeros(len(rows)), slope], np.c_[slope, np.zeros(len(rows))]
        by_score = -(up[at] - low[at]) / mass / len(rows)
        by_theta = np.zeros(GRADES - 1)
        np.add.at(by_theta, np.maximum(grades - 1, 0), np.where(grades > 0, up[at] / mass, 0) / len(rows))
        np.add.at(by_theta, np.minimum(grades, GRADES - 2), np.where(grades < GRADES - 1, -low[at] / mass, 0) / len(rows))
        by_steps = np.r_[by_theta.sum(), [np.exp(steps[k]) * by_theta[k:].sum() for k in range(1, GRADES - 1)]]
        gradient = np.r_[np.bincount(flat, by_score[row], len(used)) + ridge * weights, by_steps]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params - rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    whole = np.zeros(TABLE)
    whole[used] = params[: len(used)]
    steps = params[len(used) :]
    return Model(whole, steps[0] + np.r_[0, np.cumsum(np.exp(steps[1:]))])


def _slots_of(sample: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """The sample with ``slots`` in place of ``text``; ``wanted`` flags the slots to keep (a table of fixed size)."""
    kept = None if wanted is None else sample.sparkSession.sparkContext.broadcast(wanted)

    def slots(texts: pa.Array) -> list[pa.Array]:
        found = map(features, texts.to_pylist())
        return [pa.array([s if kept is None else s[kept.value[s]] for s in found], pa.list_(pa.int64()))]

    return map_column(sample, "text", {"slots": "array<long>"}, slots)


def fit_sample(sample: DataFrame) -> Model:
    """A model fitted on a bounded table of ``text`` and ``toxic`` (0 or 1).

    Slots are counted and chosen by Spark; only the chosen ones of each text come to the driver.
    """
    sample = hold(sample.select("text", "toxic"), "toxicity-sample")
    size = sample.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    counts = _slots_of(sample).select("toxic", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("seen"), F.sum("toxic").alias("bad"))
    often = counts.where(F.col("bad") > 1).toPandas()
    often = often[chosen_slots(often["seen"].to_numpy(float), often["bad"].to_numpy(float), size["rows"], size["toxic"])]
    wanted = np.zeros(TABLE, bool)
    wanted[often["slot"].to_numpy(int)] = True
    rows = sorted(_slots_of(sample, wanted).collect(), key=lambda r: (r["slots"], r["toxic"]))  # a bounded sample, in an order of its own
    slots = [np.array(r["slots"], np.int64) for r in rows]
    return fit(slots, grades_of(slots, np.array([r["toxic"] > 0 for r in rows], bool)))


def fit_from_tables(spark: SparkSession, folder: str, limit: int = FIT_ROWS) -> Model:
    """Fitted on at most ``limit`` rows of ``documents`` that ``labels`` covers: those of the smallest id hashes.

    A document labelled more than once is toxic if any of its labels says so; rows without a label or an id are left out.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", text_of("text").alias("text"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").where("toxic is not null and doc_id is not null")
    chosen = labels.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # ids alone, so the bound holds before texts are read
    return fit_sample(docs.join(F.broadcast(chosen), "doc_id"))


def score(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Rows with ``severity`` (expected grade, 0 to 3), ``p_toxic`` and ``toxic``; existing columns of these names are replaced.

    A null text counts as empty and scores like a text without words. Texts are read whole. Equal texts score alike.
    An empty table gives no rows. Other columns pass through unchanged.
    """
    docs = prefixed(docs, ADDED)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> list[pa.Array]:
        above = np.array([shipped.value.above(features(t)) for t in texts.to_pylist()]).reshape(-1, GRADES - 1)
        return [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= cut)]

    work = unused(docs, "toxicity_text")
    return map_column(docs.withColumn(work, text_of(text_col)), work, {"severity": "double", "p_toxic": "double", "toxic": "boolean"}, scored)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return score(docs, fit_from_tables(spark, folder)).select("doc_id", "severity", "p_toxic", "toxic")
