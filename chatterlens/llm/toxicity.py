"""Toxicity: a factorization machine over hashed terms.

A document is the set of the hashes of its lower-cased words. Every term seen in
at least ``LEAST`` sampled documents has a weight and a vector of ``FACTORS``
numbers; the model adds weights and the inner products of all pairs of vectors,
so two terms that are harmless alone can weigh together, also terms as frequent
in either class. It is fitted by AdaGrad on the logistic loss: first the terms
whose shares of the classes differ by ``CLEAR`` standard errors, the clearest
first, up to ``TERMS``, from half the log ratio of these shares; then from there
all terms, for as many passes as a quarter of the sample that is not fitted gains
by (none, if it never does). On this quarter the model is calibrated as well.

Defined cases: null and empty texts have no term and get the score of the bias;
with no labelled row of one class every score is 1 or 0 by the class that there
is (0 with none); repeated rows each give a row; whole texts count, of any
length; further columns of the tables are never read.
"""

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .labelled import SAMPLE_PER_CLASS, calibrate, score_column, share, training_rows

#: Terms fitted first at most, factors; least documents of a term, and difference of one fitted first.
TERMS, FACTORS, LEAST, CLEAR = 1 << 13, 8, 5, 4.0
#: Passes over all terms at most, and in a row without a gain of 1 %, by which they end.
MORE, PATIENCE = 50, 12
#: From this score up a document counts as toxic.
REJECT = 0.5
_WORD = re.compile(r"\w+")


def terms(text: str | None) -> np.ndarray:
    """Sorted 32-bit hashes of the different words."""
    words = set(_WORD.findall((text or "").lower()))
    return np.sort(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)))


def _choose(y, rows, most, least):
    """(sorted hashes of the model's terms, places among them of the clearest)."""
    every, at = np.unique(np.concatenate(rows or [np.empty(0, np.uint32)]), return_inverse=True)
    label = np.repeat(y, [len(r) for r in rows])
    with_, without = np.bincount(at[label == 1], minlength=len(every)), np.bincount(at[label == 0], minlength=len(every))
    often = with_ + without >= least
    every, with_, without = every[often], with_[often], without[often]
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    p = (with_ + without + 1) / (n1 + n0 + 2)
    clear = np.abs(with_ / n1 - without / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    ok = np.nonzero(clear >= CLEAR)[0]
    return every, np.sort(ok[np.lexsort((every[ok], -clear[ok]))][:most])


def _ratios(y, placed, n):
    """First weights: half the log of the ratio of a term's smoothed class shares."""
    share_of = []
    for c in (1, 0):
        count = np.bincount(np.concatenate([p for p, z in zip(placed, y) if z == c] or [np.empty(0, np.int64)]).astype(np.int64), minlength=n)
        share_of.append((count + 0.5) / (max(1, (y == c).sum()) + 1))
    return 0.5 * np.log(share_of[0] / share_of[1])


def _sums(flat, start, w, v):
    """Margins without bias, and factor sums, of documents whose model terms lie
    one after another in ``flat`` from ``start``."""
    ends = np.append(start[1:], len(flat))
    run = lambda x: np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    vf = v[flat]
    a, b, c = run(w[flat]), run(vf), run((vf * vf).sum(axis=1))
    s = b[ends] - b[start]
    return a[ends] - a[start] + 0.5 * ((s * s).sum(axis=1) - (c[ends] - c[start])), s


def _places(rows, chosen):
    """Places of the terms of each row that the sorted ``chosen`` holds."""
    if not len(chosen):
        return [np.empty(0, np.int64) for _ in rows]
    at = [np.minimum(np.searchsorted(chosen, r), len(chosen) - 1) for r in rows]
    return [p[chosen[p] == r] for p, r in zip(at, rows)]


def _descend(y, placed, use, w, v, bias, passes, rate, decay, rng, start=1e-6, pace=0.2):
    """AdaGrad passes over the documents ``use``; yields the model after each."""
    gw, gv, gb = np.full(len(w), start), np.full(v.shape, start), 1e-6
    weigh = np.where(y == 1, 0.5 / max(1, (y[use] == 1).sum()), 0.5 / max(1, (y[use] == 0).sum())) * len(use)
    for _ in range(passes):
        mixed = rng.permutation(use)
        for at in range(0, len(mixed), 128):
            batch = mixed[at:at + 128]
            sizes = np.array([len(placed[i]) for i in batch])
            flat = np.concatenate([placed[i] for i in batch])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            margin, s = _sums(flat, first, w, v)
            slope = (1 / (1 + np.exp(-np.clip(margin + bias, -35, 35))) - y[batch]) * weigh[batch] / len(batch)
            each = np.repeat(slope, sizes)
            here, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, each, len(here)) + decay * w[here]
            inner = each[:, None] * (np.repeat(s, sizes, axis=0) - v[flat])
            dv = np.stack([np.bincount(back, inner[:, k], len(here)) for k in range(FACTORS)], axis=1) + decay * v[here]
            gw[here] += dw * dw
            gv[here] += dv * dv
            w[here] -= rate * dw / np.sqrt(gw[here])
            v[here] -= pace * rate * dv / np.sqrt(gv[here])
            gb += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(gb)
        yield w, v, bias


def _loss(y, margin):
    """Logistic loss after calibration, classes weighed the same."""
    p = np.clip(share(margin, calibrate(margin, y)), 1e-9, 1 - 1e-9)
    return -0.5 * (np.log(p[y == 1]).mean() + np.log(1 - p[y == 0]).mean())


def fit(y: np.ndarray, rows: list, passes: int = 25, rate: float = 0.2, decay: float = 1e-5, seed: int = 0) -> dict:
    if not len(y) or y.min() == y.max():
        return {"terms": np.empty(0, np.uint32), "only": float(y[0]) if len(y) else 0.0}
    every, clear = _choose(y, rows, TERMS, LEAST)
    part = np.arange(len(y)) % 4 == 3
    if min(np.bincount(y[part], minlength=2)) < 5:
        part[:] = False
    use, rest = np.nonzero(~part)[0], np.nonzero(part if part.any() else ~part)[0]
    rng = np.random.default_rng(seed)
    # the clear terms first
    chosen = every[clear]
    placed = _places(rows, chosen)
    n = max(1, len(chosen))
    for w, v, bias in _descend(y, placed, use, _ratios(y, placed, n), rng.normal(0, 0.01, (n, FACTORS)), 0.0, passes, rate, decay, rng):
        pass
    model = {"terms": chosen, "w": w.copy(), "v": v.copy(), "bias": bias, "only": None}
    # then every term, from there, as long as documents that are not fitted gain by it
    least, since = _loss(y[rest], _margins(model, [rows[i] for i in rest])), 0
    placed, mark = _places(rows, every), least
    w2, v2 = np.zeros(max(1, len(every))), rng.normal(0, 0.03, (max(1, len(every)), FACTORS))
    w2[clear], v2[clear] = w[:len(clear)], v[:len(clear)]
    for w, v, bias in _descend(y, placed, use, w2, v2, bias, MORE, 0.25 * rate, decay, rng, 1e-3, 1.0):
        now = {"terms": every, "w": w, "v": v, "bias": bias, "only": None}
        loss, since = _loss(y[rest], _margins(now, [rows[i] for i in rest])), since + 1
        if loss < 0.99 * mark:
            mark, since = loss, 0
        if loss < least:
            model, least = now | {"w": w.copy(), "v": v.copy()}, loss
        if since == PATIENCE:
            break
    model["curve"] = calibrate(_margins(model, [rows[i] for i in rest]), y[rest])
    return model | {"w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}


def _margins(model, rows):
    if not len(model["terms"]):
        return np.full(len(rows), model["bias"])
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate([*rows, np.empty(0, np.uint32)])
    at = np.minimum(np.searchsorted(model["terms"], flat), len(model["terms"]) - 1)
    known = model["terms"][at] == flat
    owner = np.repeat(np.arange(len(rows)), sizes)[known]
    start = np.searchsorted(owner, np.arange(len(rows)))
    return _sums(at[known], start, model["w"], model["v"])[0] + model["bias"]


def score_texts(model: dict):
    def score(texts: list) -> np.ndarray:
        if model["only"] is not None:
            return np.full(len(texts), model["only"])
        out = [share(_margins(model, [terms(t) for t in texts[i:i + 100]]), model["curve"]) for i in range(0, len(texts), 100)]
        return np.concatenate([*out, np.empty(0)])

    return score


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict:
    return fit(*training_rows(docs, labels, "toxic", terms, per_class))


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, per_class)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(score_texts(model)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``REJECT``."""
    small_batches(docs.sparkSession)
    return docs.where(score_column(score_texts(train(docs, labels, per_class))) < REJECT)
