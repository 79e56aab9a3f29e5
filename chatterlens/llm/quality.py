"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams: lower-cased words, and 1- to 3-grams of
word shapes (runs of letters, digits and each symbol, in order; a word equal to
its predecessor has a shape of its own). Each indicator is scaled by the log of
the ratio of its smoothed class counts, and a linear hinge-loss model over the
scaled indicators is fitted by dual coordinate descent; a logistic curve fitted
on the part of the sample that the model has not seen turns margins into scores.

Defined cases: null and empty texts have no indicator and get the score of the
bias; with no labelled row of one class every score is 1 or 0 by the class that
there is (0.5 with none); repeated rows each give a row; whole texts count, of
any length; further columns of the tables are never read.
"""

import zlib
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .labelled import SAMPLE_PER_CLASS, calibrate, score_column, share, training_rows

#: Indicators are hashed to this many places: the model is 2 MB at any size of input.
PLACES = 1 << 18
#: From this score up a document counts as good.
ACCEPT = 0.3


def _classes() -> np.ndarray:
    """Class byte of each character below 0x10000: a letter's case, 0 for digits,
    a space for white space, ASCII symbols themselves, o for the rest."""
    out = np.full(1 << 16, ord("o"), np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            out[i] = 32
        elif c.isalpha():
            out[i] = ord("A" if c.isupper() else "a")
        elif c.isdigit():
            out[i] = ord("0")
        elif 32 < i < 127:
            out[i] = i
    return out


_CLASS = _classes()
_BITS = 64 - (PLACES.bit_length() - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of shapes, forgotten when there are too many."""

    def __missing__(self, shape):
        if len(self) >= 200_000:
            self.clear()
        b = shape.encode("latin-1")
        self[shape] = h = zlib.crc32(b) << 32 | zlib.crc32(b"s" + b)
        return h


_shapes = _Hashes()


def indicators(text: str | None) -> np.ndarray:
    """Sorted places of the n-grams in the text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    runs = _CLASS[np.minimum(points, 0xFFFF)]
    runs = runs[np.append(True, runs[1:] != runs[:-1])]
    one = np.fromiter(map(_shapes.__getitem__, runs.tobytes().decode("latin-1").split()), np.uint64, n)
    again = np.fromiter(map(eq, words[1:], words), bool, n - 1)
    one[1:][again] = 1
    two = (one[:-1] * np.uint64(31) + one[1:]) * _MIX
    three = (two[:-1] * np.uint64(31) + one[2:]) * _MIX
    grams = np.concatenate([one * _MIX, two, three]) >> np.uint64(_BITS)
    lower = set(text.lower().split())
    alone = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in lower), np.uint32, len(lower)) % np.uint32(PLACES)
    return np.unique(np.concatenate([grams.astype(np.uint32), alone]))


def descend(rows, y, cost: float = 0.1, passes: int = 12, seed: int = 0):
    """Dual coordinate descent for the linear hinge loss (L1 loss, with a bias
    feature): (weights, bias). ``rows``: (places, values) of each document."""
    w, bias = np.zeros(PLACES), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    n = len(y)
    each = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum()))) * cost
    alpha = np.zeros(n)
    square = np.array([v @ v + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(n):
            at, v = rows[i]
            slope = sign[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), each[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def fit(y: np.ndarray, rows: list) -> dict:
    """Model from labels and indicator sets: one weight for each place, log-count
    ratio included, a bias and the calibration curve."""
    if not len(y) or y.min() == y.max():
        only = 0.5 if not len(y) else float(y[0])
        return {"w": np.zeros(PLACES, np.float32), "bias": 0.0, "curve": (0.0, 0.0), "only": only}
    ratio = np.zeros(PLACES)
    for c, sign in ((1, 1), (0, -1)):
        count = 1.0 + np.bincount(np.concatenate([r for r, z in zip(rows, y) if z == c] or [np.empty(0, np.int64)]).astype(np.int64), minlength=PLACES)
        ratio += sign * np.log(count / count.sum())
    part = np.arange(len(y)) % 4 == 3
    if min(np.bincount(y[part], minlength=2)) < 5:
        part[:] = False
    scaled = []
    for r in rows:
        v = ratio[r]
        scaled.append((r.astype(np.int64), v / max(1e-9, np.sqrt(v @ v))))
    use = np.nonzero(~part)[0]
    w, bias = descend([scaled[i] for i in use], y[use], cost=10.0)
    rest = np.nonzero(part)[0] if part.any() else use
    margin = np.array([w[scaled[i][0]] @ scaled[i][1] + bias for i in rest])
    return {"w": (w * ratio).astype(np.float32), "ratio": ratio.astype(np.float32), "bias": float(bias),
            "curve": calibrate(margin, y[rest]), "only": None}


def score_texts(model: dict):
    def score(texts: list) -> np.ndarray:
        if model["only"] is not None:
            return np.full(len(texts), model["only"])
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            at = indicators(t)
            r = model["ratio"][at].astype(np.float64)
            out[i] = model["w"][at].astype(np.float64).sum() / max(1e-9, np.sqrt(r @ r)) + model["bias"]
        return share(out, model["curve"])

    return score


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict:
    return fit(*training_rows(docs, labels, "quality", indicators, per_class))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, per_class)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(score_texts(model)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``ACCEPT``."""
    small_batches(docs.sparkSession)
    return docs.where(score_column(score_texts(train(docs, labels, per_class))) >= ACCEPT)
