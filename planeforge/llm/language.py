"""Language identification (operator 3): family first, then one-versus-one SVMs within the family.

Texts become L2-normalised square roots of hashed byte n-gram counts.  Linear SVMs separate each pair
of language families, and within a family each pair of its languages.  Votes decide, summed margins
break ties.  Models are fitted on a bounded sample of labelled texts, drawn for each language by itself from its
distinct texts, so neither copies nor other languages can crowd it out; prediction reads whole texts in
one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, lean, map_arrow, text_bytes
from .linear import fit_svm, gram_ids, sigmoid

UNKNOWN = "und"

#: Families by ISO 639-1 code (fixed values); other codes form the family "other".
FAMILIES = {
    "germanic": "af da de en fo is lb nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "turkic": "az kk tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), "other")


@dataclass(frozen=True)
class LanguageParams:
    sizes: tuple[int, ...] = (1, 2, 3)
    bits: int = 12
    #: Bound of the training sample: distinct texts of each language.
    sample_per_language: int = 300


@dataclass(frozen=True)
class Duel:
    """Decides between two names: a positive margin is for ``a``."""

    a: str
    b: str
    weights: np.ndarray


@dataclass(frozen=True)
class LanguageModel:
    params: LanguageParams
    families: tuple[str, ...]
    between: tuple[Duel, ...]
    languages: dict[str, tuple[str, ...]]
    within: dict[str, tuple[Duel, ...]]

    def predict(self, text: str | None, letter=regex.compile(r"\p{L}").search) -> tuple[str, float]:
        if text is None or not self.families or not letter(text):
            return UNKNOWN, 0.0
        x = features(text.encode(), self.params)
        family, p = _vote(self.families, self.between, x)
        lang, q = _vote(self.languages[family], self.within[family], x)
        return lang, p * q


def features(text: bytes, params: LanguageParams) -> np.ndarray:
    ids = gram_ids(text.lower(), params.sizes, params.bits)
    x = np.sqrt(np.bincount(ids, minlength=1 << params.bits).astype(np.float32))
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def _vote(names: tuple[str, ...], duels: tuple[Duel, ...], x: np.ndarray) -> tuple[str, float]:
    """The winner and a confidence: its weakest duel's margin as a probability."""
    if len(names) == 1:
        return names[0], 1.0
    votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
    for duel in duels:
        margin = float(duel.weights[:-1] @ x + duel.weights[-1])
        votes[duel.a if margin >= 0 else duel.b] += 1
        for name, m in ((duel.a, margin), (duel.b, -margin)):
            sums[name] += m
            least[name] = min(least[name], m)
    best = max(names, key=lambda n: (votes[n], sums[n], n))
    return best, float(sigmoid(2.0 * least[best]))


def sampled_texts(labelled: DataFrame, per_language: int) -> DataFrame:
    """``lang, h, text``: of each language the distinct texts with the smallest hashes, some of them repeated.

    Drawn are the texts below a hash that is set for each language by its (approximate) count of distinct texts, twice
    as many as needed; so what is drawn depends on texts and languages alone, and a copy is drawn with its like.
    """
    known = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("h"), "text")
    scale = 1 << 30
    bars = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    # one row a language
    bars = bars.select("lang", F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n")).alias("share"))
    drawn = known.join(F.broadcast(bars), "lang")
    return drawn.where(F.pmod("h", F.lit(scale)) < F.col("share") * scale).select("lang", "h", "text")


def fit_languages(labelled: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fit on rows ``text, lang``; rows with a null language, a null text, or without a letter are ignored.

    Of each language the ``sample_per_language`` distinct texts with the smallest hashes are learned from, whatever the
    order of the rows and however often a text is repeated.
    """

    def run(batches):
        seen = set()  # a text is described once a task; below the bar there are boundedly many
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            fresh = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if fresh:
                part = batch.take(pa.array(fresh))
                x = [features(t, params).astype("<f4").tobytes() for t in text_bytes(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], names=["lang", "h", "x"])

    described = sampled_texts(labelled, params.sample_per_language).mapInArrow(lean(run), "lang string, h long, x binary")
    once = described.groupBy("lang", "h").agg(F.min("x").alias("x"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    got = once.withColumn("_rank", rank).where(F.col("_rank") <= params.sample_per_language).collect()
    got = sorted((r["lang"], bytes(r["x"])) for r in got)
    names = sorted({lang for lang, _ in got})
    x = np.array([np.frombuffer(b, dtype="<f4") for _, b in got], dtype=np.float32).reshape(len(got), 1 << params.bits)
    lang = np.array([lang for lang, _ in got], dtype=object)
    group = np.array([family_of(n) for n in lang], dtype=object)
    families = tuple(sorted(set(group)))
    languages = {f: tuple(n for n in names if family_of(n) == f) for f in families}

    def duels(of: np.ndarray, among: tuple[str, ...]) -> tuple[Duel, ...]:
        out = []
        for a, b in combinations(among, 2):
            rows = (of == a) | (of == b)
            out.append(Duel(a, b, fit_svm(x[rows], np.where(of[rows] == a, 1.0, -1.0)).astype(np.float32)))
        return tuple(out)

    return LanguageModel(params, families, duels(group, families), languages, {f: duels(lang, languages[f]) for f in families})


def predict_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: a learned language, or ``und`` with score 0.

    ``und`` stands for null texts, texts without a letter, and for all texts if nothing was learned.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [own.predict(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

        return step

    plain = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(plain, make, "doc_id long, lang_pred string, score double")


def training_rows(docs: DataFrame, held_out_remainder: int = 2) -> DataFrame:
    """Text and language of the rows that may be learned from (crc32 of the id mod 4); no id: none."""
    return docs.where(id_crc() % 4 != held_out_remainder).select("text", "lang")
