"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1, the unlabelled are any rows; the class prior is estimated. A linear model on
text features minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss. Rows labelled 0 are read
neither for the prior nor for the weights; with the logistic loss the margin is the score's log odds. Fitting takes a bounded sample of
different rows, chosen by a hash of id and text (``most_positive``, ``most_unlabelled``), and sends feature vectors of fixed length to the
driver, never texts. Scoring reads every row whole, without a shuffle.

Features come from the text alone: shares of character-class trigrams (hashed; letters of every script are one
class), and ratios of words and lines. Label, language, source and id are no inputs.

Nulls: a null text is the empty text, which has a score too; a null label is no label. Of rows that share a doc_id each
gets a score; of those that share the text, too, one is in a sample; a document labelled both 0 and 1 is no positive. Without a positive label every score is 0.5. An empty
table of documents gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.llm import common

HASHED, DENSE = 512, 14
_CLASS = np.zeros(256, np.uint32)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == " " else 5 if _c == "\n" else 6 if _b < 32 else 7 + (_b % 57)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def features(raw: bytes) -> np.ndarray:
    """The features of a whole text (UTF-8)."""
    out = np.zeros(HASHED + DENSE, np.float32)
    k = np.frombuffer(raw, np.uint8)
    n = len(k)
    if n >= 3:
        c = _CLASS[k]
        code = (c[:-2] * 4096 + c[1:-1] * 64 + c[2:]) * np.uint32(2654435761) >> np.uint32(23)
        out[:HASHED] = np.sqrt(np.bincount(code, minlength=HASHED) / (n - 2))
    words = raw.split()
    m = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = len(set(words))
    same = sum(map(bytes.__eq__, words[1:], words[:-1])) if m > 1 else 0
    upper = int(((k >= 65) & (k <= 90)).sum())
    lower = int(((k >= 97) & (k <= 122)).sum())
    three = len(set(zip(words, words[1:], words[2:], strict=False))) if m > 2 else 0
    letters = max(1, upper + lower)
    out[HASHED:] = (
        np.log1p(m) / 10, np.log1p(n) / 15, seen / max(1, m) ** 0.8, same / max(1, m), upper / letters, three / max(1, m - 2),
        len(set(lines)) / max(1, len(lines)), min(20, (n - raw.count(b" ")) / max(1, m)) / 20, sum(map(raw.count, (b"*", b"&", b"%", b"$", b"#"))) / max(1, m),
        raw.count(b"!") / max(1, m), raw.count(b"|") / max(1, m), min(1, len(lines) / max(1, m)), m == 0, m < 50,
    )
    return out


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def sample(rows: DataFrame, most: int, seed: str) -> DataFrame:
    """text of at most ``most`` different rows(doc_id, text): those with the least hashes of both. Hashes are reduced to
    different ones before they are sorted, and equal rows that pass the bound to one, so repeated rows add nothing."""
    keyed = rows.select(common.text_of().alias("text"), F.xxhash64("doc_id", common.text_of(), F.lit(seed)).alias("o"))
    bound = keyed.select("o").distinct().orderBy("o").limit(most).agg(F.max("o").alias("o")).first()["o"]
    return keyed.where(F.col("o") <= F.lit(bound).cast("long")).groupBy("o").agg(F.first("text").alias("text"))


def matrix(sampled: DataFrame) -> np.ndarray:
    """Features of the rows of ``sampled(o, text)``, a sample of bounded size, in order of their hashes."""
    schema = pa.schema([("o", pa.int64()), ("x", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            x = [features(raw).astype(np.float16).tobytes() for raw in common.utf8(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("o"), pa.array(x, pa.binary())], schema=schema)

    got = sorted(sampled.select("o", "text").mapInArrow(extract, "o long, x binary").collect())
    return np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32).reshape(-1, HASHED + DENSE)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.03, decay: float = 1e-3) -> tuple[np.ndarray, float, list[float]]:
    """Weights, bias and the risk at each step. Where the negative part of the risk falls below 0 its gradient is
    taken back, which keeps the risk non-negative."""
    w = np.zeros(positive.shape[1] + 1)
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (positive, unlabelled))
    m, v, risks = np.zeros_like(w), np.zeros_like(w), []
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        plus = np.logaddexp(0, -zp).mean() * prior
        minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        risks.append(float(plus + max(0.0, minus)))
        up = -(p * _sigmoid(-zp)[:, None]).mean(0) * prior
        down = (u * _sigmoid(zu)[:, None]).mean(0) - prior * (p * _sigmoid(zp)[:, None]).mean(0)
        g = (up + down if minus >= 0 else -down) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1]), risks


def shares_above(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """For each positive's margin the share of the unlabelled whose margin is no less."""
    return 1 - np.searchsorted(np.sort(unlabelled), positive, "left") / len(unlabelled)


def prior_of(above: np.ndarray, n_unlabelled: int) -> float:
    """The share of positives among the unlabelled: above any threshold the unlabelled have at least the prior times the
    positives' share, so the least quotient of both shares bounds it (best bin). The unlabelled's share has the deviations of both
    samples added, 1 / sqrt(rows) each, which counts the less the larger a bin is: the fewer positives, the larger the bin."""
    t = np.sort(above)
    share = np.arange(1, len(t) + 1) / len(t)
    slack = 1 / np.sqrt(len(t)) + 1 / np.sqrt(n_unlabelled)
    best = int(np.argmin((t + slack) / share))
    return float(np.clip(t[best] / share[best], 0.05, 0.95))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from the margins of positives that the model hasn't seen and of unlabelled rows."""
    return prior_of(shares_above(positive, unlabelled), len(unlabelled))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 3000, most_unlabelled: int = 6000, held_out: int = 2) -> Model:
    """Fit on rows whose fold is not ``held_out``: rows labelled 1 there and unlabelled rows there, both samples of bounded
    size. Other labels aren't read. The ids of positives are sampled before their texts are looked up, and their texts again."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").where(fold(F.col("doc_id")) != held_out)
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    # A document that is labelled both ways is no trusted positive.
    named = named.where(fold(F.col("doc_id")) != held_out).groupBy("doc_id").agg(F.min("label").alias("label")).where("label = 1")
    picked = named.select("doc_id", F.xxhash64("doc_id", F.lit("labelled")).alias("o")).orderBy("o", "doc_id").limit(most_positive).select("doc_id")
    positive = matrix(sample(texts.join(F.broadcast(picked), "doc_id"), most_positive, "labelled"))
    free = matrix(sample(texts, most_unlabelled, "unlabelled"))
    width = HASHED + DENSE
    if not len(positive) or not len(free):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    return fit(positive, free)


def fit(positive: np.ndarray, free: np.ndarray) -> Model:
    """The model of features of positives and of unlabelled rows. Each half of the positives fits a first model that places the other
    half among the unlabelled; all places together estimate the prior, with which the last model is fitted. (One positive places itself.)"""
    mean, scale = free.mean(0), free.std(0) + 1e-2
    positive, free = (positive - mean) / scale, (free - mean) / scale
    halves = [(positive[::2], positive[1::2]), (positive[1::2], positive[::2])] if len(positive) > 1 else [(positive, positive)]
    above = []
    for own, other in halves:
        w, bias, _ = minimise(own, free, 0.5)
        above.append(shares_above(other @ w + bias, free @ w + bias))
    prior = prior_of(np.concatenate(above), len(free))
    w, bias, _ = minimise(positive, free, prior)
    return Model(mean, scale, w, bias, prior)


def score(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default) of every row of ``docs`` and the text's score (0 to 1) as ``name``."""
    keep = ["doc_id"] if keep is None else keep
    own = docs.select(*[F.col(c) for c in keep], *([] if "text" in keep else ["text"]))
    weights = model.weights / model.scale
    base = model.bias - float(model.mean @ weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            z = np.array([features(raw) @ weights + base for raw in common.utf8(b, "text")])
            held = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*held, pa.array(_sigmoid(z), pa.float64())], names=[*keep, name])

    return own.mapInArrow(run, own.select(*keep).withColumn(name, F.lit(0.0)).schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    name = "_pu_score"
    scored = score(docs, train(docs, labels), name, docs.columns)
    return scored.where(F.col(name) >= threshold).drop(name)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
