"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes single spaces, and n-grams of one to three code points are hashed
into 2 ** 15 features with logarithmic counts, inverse document frequencies and unit length. Document frequencies are
counted over all training documents. The weights come from follow-the-regularised-leader with elastic-net penalties on
a bounded sample of labelled training rows (per_language rows of each language, expected), dealt by a hash of the id;
a fifth of the sample is set apart to fit the temperature. The model is at most 2 ** 15 weights per language.

Defined results: null texts and texts without a letter are "und" with score 0, and so is every text if no row is labelled.
Rows whose id is null are not learned from and not held out. Equal texts get equal predictions. An empty table gives an
empty result. The columns lang_pred, score and held_out replace input columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


FEATURES, ORDERS, UNKNOWN = 1 << 15, 3, "und"

_state: dict = {}


def _letters() -> np.ndarray:
    """Which code points are letters, once per worker."""
    if "letters" not in _state:
        _state["letters"] = np.array([chr(k).isalpha() for k in range(0x110000)])
    return _state["letters"]


def counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and their counts; None for a text without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint64)
    grams, h = [], np.zeros(len(points), np.uint64)
    for n in range(ORDERS):
        h = (h[: len(points) - n] + points[n:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        grams.append(h & np.uint64(FEATURES - 1))
        h = h[:-1] if len(h) else h
    dense = np.bincount(np.concatenate(grams).astype(np.int64), minlength=FEATURES)
    at = np.flatnonzero(dense)
    return at, dense[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    if (got := counts(text)) is None:
        return None
    x = (1 + np.log(got[1])) * idf[got[0]]
    return got[0], x / np.sqrt(x @ x)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x (features + 1); the last is the bias
    temperature: float

    def probabilities(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return softmax((self.weights[:, at] @ x + self.weights[:, FEATURES]) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        got = vector(text, self.idf) if text and self.languages else None
        if got is None:
            return UNKNOWN, 0.0
        p = self.probabilities(*got)
        return self.languages[k := int(p.argmax())], float(p[k])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def follow_the_leader(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    z, n = np.zeros((classes, FEATURES + 1)), np.zeros((classes, FEATURES + 1))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            at, x, y = examples[k]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = weights(z[:, at], n[:, at])
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x[None, :]
            z[:, at] += g - (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / alpha * w
            n[:, at] += g * g
    return weights(z, n)


def best_temperature(scores: list[np.ndarray], labels: list[int]) -> float:
    """The temperature of least log loss on rows that the weights have not seen; 1 if there are none.

    Targets are smoothed as if each other class had been met once, so that a fold without errors gives no certainty."""
    if not scores:
        return 1.0
    s, y = np.array(scores), np.array(labels)
    n, k = s.shape
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), y] = (n + 1) / (n + k)

    def loss(t: float) -> float:
        v = s / t
        v = v - v.max(1, keepdims=True)
        return float((target * (np.log(np.exp(v).sum(1, keepdims=True)) - v)).sum(1).mean())

    return float(min(np.exp(np.linspace(np.log(0.01), np.log(20), 161)), key=loss))


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Of all rows: their number, and how many have each feature. At most FEATURES + 1 numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                if text and (got := counts(text)):
                    total[got[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array([-1, *at.tolist()], pa.int32()), "n": pa.array([n, *total[at].tolist()], pa.int64())})

    rows = docs.select(text_col).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES)
    for r in rows:
        if r["feature"] >= 0:
            df[r["feature"]] = r["n"]
    return next((r["n"] for r in rows if r["feature"] < 0), 0), df


def fit(
    training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = 1000, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 4
) -> Model:
    """A model of the labelled rows of training."""
    labelled = training.where(F.col(lang_col).isNotNull())
    n, df = document_frequencies(labelled, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = {r[0]: r["n"] for r in labelled.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((0, FEATURES + 1)), 1.0)
    rate = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, int(min(1.0, per_language / sizes[k]) * (1 << 30)))]), F.col(lang_col))
    dealt = F.xxhash64(F.lit("sample"), F.col(id_col))
    sample = labelled.where(F.pmod(dealt, F.lit(1 << 30)) < rate).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.shiftrightunsigned(dealt, 32), F.lit(5)).alias("fifth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, fifth, got) for lang, text, fifth in zip(*[c.to_pylist() for c in b.columns], strict=True) if text and (got := vector(text, idf))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2][0].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[2][1].astype("<f4").tobytes() for r in rows], pa.binary())],
                names=["lang", "fifth", "at", "x"],
            )

    rows = sorted(sample.mapInArrow(run, "lang string, fifth long, at binary, x binary").collect(), key=lambda r: (r["lang"], r["at"], r["x"]))
    examples = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["x"], "<f4").astype(float), languages.index(r["lang"]), r["fifth"]) for r in rows]
    weights = follow_the_leader([e[:3] for e in examples if e[3]], len(languages), alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    apart = [e for e in examples if not e[3]]
    scores = [weights[:, at] @ x + weights[:, FEATURES] for at, x, _, _ in apart]
    return Model(languages, idf, weights.astype(np.float32), best_temperature(scores, [e[2] for e in apart]))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    at, held = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            got = [m.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def third(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with held_out (the id's CRC-32 leaves 1 on division by 3), lang_pred and score; learned from the others."""
    model = fit(docs.where(third(id_col) != 1), id_col, text_col, lang_col)
    marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "held_out"], F.coalesce(third(id_col) == 1, F.lit(False)).alias("held_out"))
    return predict(marked, model, text_col)


def keep_identified(docs: DataFrame, text_col: str = "text", *, least_score: float = 0.3) -> DataFrame:
    """The documents whose language is known with at least least_score, with the columns they came with."""
    return identify(docs, text_col=text_col).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
