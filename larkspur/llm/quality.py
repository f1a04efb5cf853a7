"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives (documents labelled good) are held against unlabelled web text: every document, whatever its
label. Of a linear scorer g with squared loss, the risk ``prior * E_P[(g - 1)^2] + max(0, E_U[(g + 1)^2] -
prior * E_P[(g + 1)^2])`` is minimised. It takes first and second moments of the features only, so the unlabelled
side is all the documents: tasks sum moments, and one matrix comes back whatever the corpus. Where the bracket goes
below zero the step follows its negated gradient instead, as the non-negative estimator asks.

The class prior is estimated from positives and unlabelled rows alone. For any set S, U(S) >= prior * P(S), so the least
ratio U(S) / P(S) over score thresholds of a cross-fitted scorer bounds it from above; the ratios are of
histograms counted over all rows. No labelled negative takes part in anything.

Features describe the text only: frequencies of its bytes, and shares of repeated words, lines and word
windows, upper case, marks and blanks. They are taken over the whole text, whatever its length, and are whole
multiples of 1/1024, so that sums of moments are exact and don't depend on their order.

Edge cases: a null text is an empty one; repeated ids are separate rows; label rows with null id or label
teach nothing; without a positive or without documents to learn from, every score is the prior (0.5); an
empty table gives an empty result; further columns pass through, and results whose names are taken get underscores added.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._common import alone, append_scores, discard, materialize, small_batches

#: Most documents labelled good that the classifier is fitted on; their ids are broadcast.
SAMPLE = 100_000
THRESHOLD = 0.3
N_SHAPE = 22
N_FEATURES = 256 + N_SHAPE
#: Steps of a feature to one, and the most that a feature may be.
UNIT, MOST = 1024, 5
#: Added to each feature's deviation, and the weight of the squared weights.
FLOOR, RIDGE = 0.05, 0.1
#: Bins of the score histograms that the prior is read off.
BINS = 4096


def text_features(text: str) -> np.ndarray:
    """256 byte frequencies (square roots) and N_SHAPE shares of the whole text."""
    raw = text.encode("utf-8", "replace")
    out = np.zeros(256 + N_SHAPE, np.float32)
    words = text.split()
    n = len(words)
    if not n:
        out[-1] = 1
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    size = counts.sum()
    out[:256] = np.sqrt(counts / size)
    lines = text.split("\n")
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    again = sum(map(eq, words, words[1:])) / n
    kinds = len(set(words)) / n
    two = 1 - len(set(zip(words, words[1:]))) / max(1, n - 1)
    three = 1 - len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
    full = [x for x in lines if x and not x.isspace()]
    dup_lines = 1 - len(set(full)) / max(1, len(full))
    bare = sum(1 for w in words if not w[0].isalnum() and len(w) == 1) / n
    tail = (sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,") / n) if n else 0
    shape = [
        upper / (upper + lower + 1), upper > lower, marks / size, marks / n, counts[48:58].sum() / size, counts[32] / size, counts[10] / size, counts[128:].sum() / size,
        again, again > 0.3, kinds * min(1, np.log1p(n) / 5), kinds < 0.1, two, three, three > 0.5, dup_lines, bare, bare > 0.2, tail, tail > 0.3, (size / n) / 10,
    ]
    out[256 : 256 + len(shape)] = shape
    return out


def quantised(texts: list[str]) -> np.ndarray:
    """(n, N_FEATURES) int16: features in steps of 1 / UNIT."""
    x = np.stack([text_features(t) for t in texts]) if texts else np.zeros((0, N_FEATURES), np.float32)
    return np.rint(np.clip(x, 0, MOST) * UNIT).astype(np.int16)


@dataclass
class Model:
    """score = (1 + weights . features + bias) / 2, within 0 and 1; no weights: the prior."""

    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.prior)
        return np.clip((x.astype(np.float64) / UNIT @ self.weights + self.bias + 1) / 2, 0.0, 1.0)


# ---------------------------------------------------------------- fitting on moments


def moments(x: np.ndarray) -> np.ndarray:
    """Sums of products of the rows, with a column of ones added."""
    one = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    return one.T @ one


def _scaling(u: np.ndarray) -> np.ndarray:
    """The matrix that standardises features (with a one added) by the unlabelled rows' moments."""
    n, d = u[-1, -1], len(u) - 1
    mean = u[-1, :-1] / n
    sd = np.sqrt(np.maximum(np.diag(u)[:-1] / n - mean**2, 0)) + FLOOR
    t = np.zeros((d + 1, d + 1))
    t[:d, :d], t[:d, d], t[d, d] = np.diag(1 / sd), -mean / sd, 1
    return t


def nnpu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive and the negative part of the risk, and their gradients. p, u: moments over their count."""
    ones_p, ones_u = p[-1], u[-1]
    pw, uw = p @ w, u @ w
    positive = prior * (w @ pw - 2 * w @ ones_p + 1)
    negative = (w @ uw + 2 * w @ ones_u + 1) - prior * (w @ pw + 2 * w @ ones_p + 1)
    return positive, negative, 2 * prior * (pw - ones_p), 2 * (uw + ones_u) - 2 * prior * (pw + ones_p)


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.003, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights (bias last) of least non-negative risk, and the risk. Starts at the minimum of the unbiased risk."""
    keep = np.full(len(p), ridge)
    keep[-1] = 0
    w = np.linalg.lstsq(u + np.diag(keep), 2 * prior * p[-1] - u[-1], rcond=None)[0]
    m, v, best = np.zeros(len(w)), np.zeros(len(w)), (np.inf, w, 0.0)
    for t in range(1, steps + 1):
        positive, negative, d_positive, d_negative = nnpu_risk(w, p, u, prior)
        risk = positive + max(0.0, negative)
        goal = risk + float(keep @ (w * w))
        if goal < best[0]:
            best = (goal, w, risk)
        grad = (d_positive + d_negative if negative >= 0 else -d_negative) + 2 * keep * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return best[1], float(best[2])


def discriminant(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Least-squares weights that tell positives from unlabelled rows, scaled so that unlabelled scores have mean 0 and deviation 1."""
    a, b = p / p[-1, -1], u / u[-1, -1]
    keep = np.full(len(p), 2 * RIDGE)
    keep[-1] = 1e-9
    w = np.linalg.solve(a + b + np.diag(keep), a[-1] - b[-1])
    mean, square = w @ b[-1], w @ b @ w
    w[-1] -= mean
    return w / np.sqrt(max(square - mean**2, 1e-12))


def bins_of(z: np.ndarray) -> np.ndarray:
    return np.clip(((z + 8) * (BINS / 16)).astype(np.int64), 0, BINS - 1)


def prior_bound(p: np.ndarray, u: np.ndarray, least: float = 0.3) -> float:
    """U(score >= t) / P(score >= t) for one t, of the bins that keep ``least`` of P.

    It is the t of the least ratio with one standard error added to each side, so that no ratio is taken for being small by
    chance. p, u: histograms of scores by weights that these rows had no part in.
    """
    n_p, n_u = p.sum(), u.sum()
    if not n_p or not n_u:
        return 1.0
    fp, fu = p[::-1].cumsum()[::-1] / n_p, u[::-1].cumsum()[::-1] / n_u
    slack = np.sqrt(fu * (1 - fu) / n_u + 1e-9) + np.sqrt(fp * (1 - fp) / n_p)
    t = np.argmin(np.where(fp >= least, (fu + slack) / np.maximum(fp, 1e-9), np.inf))
    return min(1.0, float(fu[t] / fp[t]))


# ---------------------------------------------------------------- over tables


def _featured(docs: DataFrame) -> DataFrame:
    """good, fold, x (int16 features) of each row. docs: text, good, fold."""

    def run(batches):
        import pyarrow as pa

        alone("quality")
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                x = quantised([t or "" for t in some.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(map(bytes, x), pa.binary())], ["good", "fold", "x"])

    return docs.select("text", "good", "fold").mapInArrow(run, "good boolean, fold int, x binary")


def _rows_of(b) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(2).to_pylist()), np.int16).reshape(-1, N_FEATURES)


def sum_moments(feats: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Moments of the unlabelled (0) and the positive rows (1) of each fold: by (fold, good).

    Each task sums its own; a row of a matrix is one record of the shuffle, so what comes back is four matrices.
    """

    def run(batches):
        import pyarrow as pa

        sums = {g: np.zeros((N_FEATURES + 1, N_FEATURES + 1)) for g in range(4)}
        for b in batches:
            if not b.num_rows:
                continue
            x, good, fold = _rows_of(b), np.array(b.column(0).to_pylist(), bool), b.column(1).to_numpy()
            for f in (0, 1):
                sums[2 * f] += moments(x[fold == f])
                sums[2 * f + 1] += moments(x[(fold == f) & good])
        for g, m in sums.items():
            if m[-1, -1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), g, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)), pa.array(map(bytes, m), pa.binary())], ["g", "i", "v"])

    def add(batches):
        import pyarrow as pa

        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for g, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums[g, i] = sums.get((g, i), 0) + np.frombuffer(v)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([bytes(sums[k]) for k in keys], pa.binary())], ["g", "i", "v"])

    schema = "g int, i int, v binary"
    out = {(g // 2, g % 2): np.zeros((N_FEATURES + 1, N_FEATURES + 1)) for g in range(4)}
    for r in feats.mapInArrow(run, schema).repartition("g", "i").mapInArrow(add, schema).collect():
        out[r["g"] // 2, r["g"] % 2][r["i"]] = np.frombuffer(r["v"])
    for m in out.values():  # from steps to units
        m[:-1] /= UNIT
        m[:, :-1] /= UNIT
    return out


def estimate_prior(feats: DataFrame, sums: dict[tuple[int, int], np.ndarray]) -> float:
    """The bound over all rows: each fold is scored by weights fitted on the other."""
    scale = _scaling(sums[0, 0] + sums[1, 0])
    if not all(sums[f, 1][-1, -1] for f in (0, 1)):
        return 0.5
    by_fold = [discriminant(*(scale @ sums[1 - f, k] @ scale.T for k in (1, 0))) @ scale for f in (0, 1)]

    def run(batches):
        import pyarrow as pa

        counts = np.zeros((2, 2, BINS), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, good, fold = _rows_of(b), np.array(b.column(0).to_pylist(), bool), b.column(1).to_numpy()
            for f in (0, 1):
                at = bins_of(x[fold == f].astype(np.float64) / UNIT @ by_fold[f][:-1] + by_fold[f][-1])
                counts[f, 0] += np.bincount(at, minlength=BINS)
                counts[f, 1] += np.bincount(at[good[fold == f]], minlength=BINS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["at", "n"])

    counts = np.zeros(4 * BINS, np.int64)
    for at, n in feats.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        counts[at] = n
    unlabelled, good = counts.reshape(2, 2, BINS).sum(0)
    return min(0.98, max(0.02, prior_bound(good, unlabelled)))


def train(docs: DataFrame, labels: DataFrame, learn_from, sample: int = SAMPLE) -> Model:
    """Fit on all rows of docs that may be learnt from, of which at most ``sample`` (drawn by hash of the id) count as positives too.

    docs: doc_id, text. labels: doc_id, label. learn_from(column): which ids may be learnt from.
    """
    small_batches(docs.sparkSession)
    good = labels.where((F.col("label") == 1) & F.col("doc_id").isNotNull() & learn_from("doc_id")).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    good = materialize(good.withColumn("good", F.lit(True)), "quality-good")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & learn_from("doc_id")).join(F.broadcast(good), "doc_id", "left")
    rows = rows.select("text", F.coalesce("good", F.lit(False)).alias("good"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))
    feats = materialize(_featured(rows), "quality-features")
    sums = sum_moments(feats)
    p, u = sums[0, 1] + sums[1, 1], sums[0, 0] + sums[1, 0]
    if not p[-1, -1] or not u[-1, -1]:
        return Model(np.zeros(0), 0.0, 0.5)
    prior, scale = estimate_prior(feats, sums), _scaling(u)
    discard(feats, good)
    w, _ = fit_nnpu(*(scale @ m @ scale.T / m[-1, -1] for m in (p, u)), prior)
    w = w @ scale
    return Model(w[:-1], float(w[-1]), prior)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (double) and predicted (int) added; the columns given pass through."""
    return append_scores(docs, "text", "quality", lambda texts: model.score(quantised(texts)), threshold)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs predicted 1, with docs' columns."""
    return append_scores(docs, "text", "quality", lambda texts: model.score(quantised(texts)), threshold, only=True)
