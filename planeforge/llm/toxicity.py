"""Toxicity scores (operator 5): a linear classifier over naive Bayes weighted character n-grams.

Features are the presence of hashed character n-grams of the lower-cased (A-Z) text.  On a bounded,
class-balanced sample of the labelled texts, drawn for each class by itself from distinct ids and texts, each feature gets its naive Bayes log-count ratio; a
logistic regression is then fitted on the features times these ratios.  Labels are noisy, so the model
is fitted three times: on either half of the sample, to score the other half, and then on the rows
whose label the other half's model finds at least ``least_trust`` likely.  The intercept is moved from
the sample's class shares to those of all labelled rows.  Scoring reads whole texts, one pass,
without a shuffle; the model is a fixed number of floats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_text, fold_case, id_crc, lean, map_arrow, portions, text_bytes
from .linear import char_gram_ids, fit_logistic, sigmoid


@dataclass(frozen=True)
class ToxicityParams:
    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    #: Bound of the training sample: distinct texts of each class.
    sample_per_class: int = 800
    smoothing: float = 1.0
    #: Features of fewer sample rows are left out.
    least_rows: int = 3
    decay: float = 1e-3
    #: A sample row goes if the model of the other half gives its label a lower probability.
    least_trust: float = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    params: ToxicityParams
    weights: np.ndarray
    intercept: float

    def score(self, text: bytes, flags: np.ndarray) -> float:
        """``flags``: a zeroed float32 array of the feature space, returned zeroed."""
        ids = char_gram_ids(fold_case(text), self.params.sizes, self.params.bits)
        flags[ids] = 1.0
        margin = float(flags @ self.weights) + self.intercept
        flags[ids] = 0.0
        return float(sigmoid(margin))


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out_remainder: int = 0, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on the documents' texts and ``labels`` (``doc_id, toxic``).

    Not learned from: held-out rows (crc32 of the id mod 5), rows without an id, labels other than
    0 and 1.  Labels are sampled by id before they meet the texts, so the side that is broadcast is
    bounded by the sample and no text is shuffled; where too few of them meet a text, more are drawn.  Of an id that
    repeats, the text with the smallest hash is learned from, once for each class it is labelled with; of each class
    the ``sample_per_class`` distinct texts with the smallest hashes are.  The sample does not depend on the order of
    rows.  If a class is missing, every text gets the share of label 1 (one half without any label).
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(id_crc() % 5 != held_out_remainder).where("toxic in (0, 1)")
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    width = 1 << params.bits
    if not n0 or not n1:
        share = np.clip((n1 + 0.5) / (n0 + n1 + 1.0), 1e-6, 1 - 1e-6)
        return ToxicityModel(params, np.zeros(width, dtype=np.float32), float(np.log(share / (1 - share))))
    got = sampled_texts(docs, marks, (n0, n1), params)
    y = np.array([t for t, _ in got], dtype=np.float64)
    ids = [np.frombuffer(b, dtype="<u4") for _, b in got]
    if not 0 < y.sum() < len(y):
        share = n1 / (n0 + n1)
        return ToxicityModel(params, np.zeros(width, dtype=np.float32), float(np.log(share / (1 - share))))
    trust = np.zeros(len(y))
    for half in (0, 1):
        rest = [k for k in range(len(y)) if k % 2 != half]
        if not 0 < y[rest].sum() < len(rest):
            trust[half::2] = 1.0
            continue
        weights, intercept = _fit([ids[k] for k in rest], y[rest], params)
        p = np.array([sigmoid(weights[x].sum() + intercept) for x in ids[half::2]])
        trust[half::2] = np.where(y[half::2] == 1, p, 1.0 - p)
    sound = trust >= params.least_trust
    if not 0 < y[sound].sum() < sound.sum():
        sound[:] = True
    weights, intercept = _fit([x for x, s in zip(ids, sound, strict=True) if s], y[sound], params)
    share = [sound[y == label].mean() for label in (0, 1)]
    prior = np.log(n1 * share[1] / (n0 * share[0])) - np.log(y[sound].sum() / (sound.sum() - y[sound].sum()))
    return ToxicityModel(params, weights, float(intercept + prior))


def sampled_texts(docs: DataFrame, marks: DataFrame, counts: tuple[int, int], params: ToxicityParams) -> list[tuple[int, bytes]]:
    """Label and n-gram ids (little-endian unsigned 32-bit, ascending) of the texts to learn from, in order."""
    scale, most = 1 << 30, params.sample_per_class
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for widen in (2, 16, 128):
        shares = [min(1.0, widen * most / n) for n in counts]
        bar = F.when(F.col("toxic") == 1, F.lit(int(scale * shares[1]))).otherwise(F.lit(int(scale * shares[0])))
        # about ``widen * most`` ids of each class, whatever the size of the table
        drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < bar).distinct()
        met = texts.join(F.broadcast(drawn), "doc_id").groupBy("toxic", "doc_id").agg(F.min(F.xxhash64("text")).alias("h"))
        rank = F.row_number().over(Window.partitionBy("toxic").orderBy("h"))
        chosen = met.groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id")).withColumn("_rank", rank).where(F.col("_rank") <= most).select("toxic", "h", "doc_id").collect()
        found = [sum(r["toxic"] == label for r in chosen) for label in (0, 1)]
        if all(2 * n >= most or share == 1.0 for n, share in zip(found, shares, strict=True)):
            break

    def run(batches):
        seen = set()  # rows that repeat are described once a task
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            fresh = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if fresh:
                part = batch.take(pa.array(fresh))
                ids = [np.unique(char_gram_ids(fold_case(t), params.sizes, params.bits)).astype("<u4").tobytes() for t in text_bytes(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], names=["toxic", "h", "ids"])

    few = marks.sparkSession.createDataFrame([(r["doc_id"], r["h"], r["toxic"]) for r in chosen], "doc_id long, h long, toxic int")
    rows = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(few), ["doc_id", "h"]).select("toxic", "h", "text")
    once = rows.mapInArrow(lean(run), "toxic int, h long, ids binary").groupBy("toxic", "h").agg(F.min("ids").alias("ids"))
    return sorted((r["toxic"], bytes(r["ids"])) for r in once.collect())


def _fit(ids: list[np.ndarray], y: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, float]:
    """Log-count ratios, then the regression; weights hold the ratios."""
    width = 1 << params.bits
    seen = [np.zeros(width, dtype=np.int64) for _ in (0, 1)]
    for x, t in zip(ids, y, strict=True):
        seen[int(t)][x] += 1
    keep = seen[0] + seen[1] >= params.least_rows
    log = [np.log((s + params.smoothing) / ((y == label).sum() + 2 * params.smoothing)) for label, s in enumerate(seen)]
    ratio = np.where(keep, log[1] - log[0], 0.0)
    chosen = [x[keep[x]] for x in ids]
    chosen = [x if len(x) else np.zeros(1, dtype="<u4") for x in chosen]
    weights, intercept = fit_logistic(chosen, ratio, y, rounds=100, decay=params.decay)
    weights[~keep] = 0.0
    return weights, intercept


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted``; null and empty texts get the score of a text without features."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        flags = np.zeros(1 << own.params.bits, dtype=np.float32)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = np.array([own.score(t, flags) for t in text_bytes(batch.column(1))])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return step

    return map_arrow(df.select(*doc_text(id_col, text_col)), make, "doc_id long, score double, predicted int")


def drop_toxic(df: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows scored below ``threshold``, all columns as they are, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.schema.fieldNames().index(text_col)

    def run(batches):
        own = shared.value
        flags = np.zeros(1 << own.params.bits, dtype=np.float32)
        for batch in portions(batches):
            if batch.num_rows:
                keep = [own.score(t or b"", flags) < threshold for t in text_bytes(batch.column(place))]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)
