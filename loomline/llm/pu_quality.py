"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that it learns from. The share of
positives in the unlabelled text (the class prior) is estimated from the best bin of a
first classifier that tells the two apart: above a good threshold the unlabelled text
holds positives only. The model then minimises the non-negative unbiased risk

    prior * R(positives, +) + max(0, R(unlabelled, -) - prior * R(positives, -)),

stepping back where the second part falls below zero. It adds up one weight for each
measure's bin, so it follows any shape of a measure and scores a text in one pass.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import mapped

#: Most positives, and most unlabelled texts, that a model is fitted on; more are drawn by a hash of the id.
SAMPLE = 12_000
BINS = 24
STEPS = 600
LEEWAY = 0.04
#: The fixed cut between predicted classes.
CUT = 0.3

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
MEASURES = ("words", "word_length", "symbols", "distinct", "neighbours", "upper", "digits", "lines_again", "triples_again", "marks", "words_upper", "top_word")


def measures(text: str | None) -> list[float]:
    """Shape of a whole text; an empty one has zeros."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    chars = sum(map(len, words))
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = max(1, n - 2)
    upper = sum(map(str.isupper, text))
    return [
        math.log1p(n), chars / n, len(_SYMBOLS.findall(raw)) / chars, len(kinds) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, upper / chars, len(re.findall(rb"[0-9]", raw)) / chars,
        1 - len(set(lines)) / len(lines), 1 - len(set(zip(words, words[1:], words[2:]))) / triples if n > 2 else 0.0,
        len(re.findall(rb"[.,;:!?]", raw)) / n, sum(map(bytes.isupper, words)) / n, max(kinds.values()) / n,
    ]


@dataclass
class Model:
    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The flat index of each measure's bin."""
        cols = [np.searchsorted(e, x[:, k], side="right") + k * (BINS + 1) for k, e in enumerate(self.edges)]
        return np.stack(cols, axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[self.bins(x)].sum(axis=1) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _minimise(pos: np.ndarray, unl: np.ndarray, size: int, prior: float | None, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-5):
    """Adam on the logistic loss: of positives against unlabelled without a prior, else of the non-negative risk."""
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        fp, fu = _sigmoid(w[pos].sum(axis=1) + b), _sigmoid(w[unl].sum(axis=1) + b)
        if prior is None:
            gp, gu = (fp - 1) / len(pos), fu / len(unl)
        else:
            rest = -np.log1p(-np.minimum(fu, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(fp, 1 - 1e-9)).mean()
            gu, gp_minus = fu / len(unl), -prior * fp / len(pos)
            if rest >= 0:
                gp = prior * (fp - 1) / len(pos) + gp_minus
            else:  # the unbiased estimate has gone below what a risk can be: step back
                gp, gu = -gp_minus, -gu
        g = np.zeros(size + 1)
        for index, each in ((pos, gp), (unl, gu)):
            g[:size] += np.bincount(index.ravel(), np.repeat(each, index.shape[1]), size)
        g[size] = gp.sum() + gu.sum()
        g[:size] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - d[:size], b - d[size]
    return w, b


def estimate_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Best bin: the least ratio of unlabelled to positive scores above a threshold.

    The lower end of its error bound is returned, at most LEEWAY below the ratio: with
    too large a prior the risk is zero before all negatives have been told apart.
    """
    cuts = np.unique(np.quantile(pos, np.linspace(0.0, 0.95, 96)))
    qp = np.array([(pos >= c).mean() for c in cuts])
    qu = np.array([(unl >= c).mean() for c in cuts])
    slack = math.sqrt(math.log(4 / delta) / 2 / len(pos)) + math.sqrt(math.log(4 / delta) / 2 / len(unl))
    best = int(np.argmin((qu + slack) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[best] / qp[best] - min(slack, LEEWAY), 0.01, 0.99))


def fit_arrays(pos: np.ndarray, unl: np.ndarray) -> Model:
    """Fit on measures of positives and of unlabelled texts. Without either, every score is 0.5."""
    k = len(MEASURES)
    if not len(pos) or not len(unl):
        return Model(np.zeros((k, BINS)), np.zeros(k * (BINS + 1)), 0.0, 0.5)
    edges = np.quantile(np.concatenate([pos, unl]), np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    model = Model(edges, np.zeros(k * (BINS + 1)), 0.0, 0.5)
    size = k * (BINS + 1)
    # The first classifier learns on even rows and is read on odd ones.
    ip, iu = model.bins(pos), model.bins(unl)
    w, b = _minimise(ip[::2], iu[::2], size, None)
    of = lambda i: w[i].sum(axis=1) + b
    model.prior = estimate_prior(of(ip[1::2] if len(ip) > 1 else ip), of(iu[1::2] if len(iu) > 1 else iu))
    model.weights, model.bias = _minimise(ip, iu, size, model.prior)
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([measures(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))], ["x"])

    return mapped(docs.select(text_col), run, "x array<double>")


def _sampled(docs: DataFrame, id_col: str, text_col: str, most: int) -> np.ndarray:
    n = docs.count()
    share = min(1.0, most / max(n, 1))
    drawn = docs.filter(F.pmod(F.xxhash64(F.lit(5), F.col(id_col), F.col(text_col)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else docs
    rows = [r[0] for r in _measured(drawn, text_col).limit(2 * most).collect()]
    return np.array(sorted(rows), np.float64).reshape(-1, len(MEASURES))


def fit(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the texts of `docs`, whose labels are not looked at, and on those with an id in `positives`.

    About `sample` texts of either are measured on the executors; their measures, not
    their texts, come to the driver.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = positives.select(F.col(id_col).alias("p_id")).distinct()
    pos = docs.join(chosen, F.col("doc_id") == F.col("p_id"), "left_semi")
    rng = np.random.default_rng(3)
    arrays = [_sampled(d, "doc_id", "text", sample) for d in (pos, docs)]
    return fit_arrays(*[a[rng.permutation(len(a))] for a in arrays])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): every whole text, null and empty ones too; ids may be null or repeated."""

    def run(batches):
        for batch in batches:
            x = np.array([measures(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double")


def op4_pu_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.filter(~held_out("doc_id")), labels.filter((F.col("quality") == 1) & ~held_out("doc_id")))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
