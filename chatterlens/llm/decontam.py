"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of ASCII letters and digits and of characters beyond
ASCII; other ASCII characters part words. A test item is cut into segments of at
most ``SEGMENT`` words, and further ones lie across each cut, so a passage
counts alike wherever it stands in the item.Every 3-gram of a segment that a document
holds is a seed, however many documents hold it. Around the diagonals with a
seed a window is looked at; where it holds so few words of the segment that no
alignment can reach the threshold it is left, else the segment is aligned with
it (local alignment of words: match 2, other -1, gap -1) and scored as a share of
the score of a whole copy. A document's rows depend on its own text alone.

The items are read in blocks of at most ``BLOCK_WORDS`` words, each sent to the
tasks as a table of that bound; the documents are only scanned, never shuffled.

Defined cases: null, empty and shorter than three-word texts or items match
nothing; items with the same text are all reported; repeated documents each
give their rows; whole texts count, of any length; an empty table gives no row.
"""

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

GRAM, SEGMENT = 3, 64
#: Seeds, and words of windows, that are looked at in one step.
STEP = 1 << 20
#: Words of test items held by a task at once.
BLOCK_WORDS = 400_000
#: From this share of a whole copy's score up a document is contaminated.
THRESHOLD = 0.4
MATCH, OTHER, GAP = 2, -1, -1
_TO_WORDS = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
_BREAK = b"\x01"  # stands between texts; it is in no word


def lowered(text: str = "text"):
    """Lower-cased UTF-8 of a text column, made by Spark for items and texts alike."""
    return F.lower(F.col(text)).cast("binary")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def segments(ids: np.ndarray) -> list[np.ndarray]:
    """Equal parts of at most ``SEGMENT`` words, and over each cut between two a
    part from the middle of one to the middle of the next."""
    cuts = [0, *np.cumsum([len(x) for x in np.array_split(ids, -(-len(ids) // SEGMENT))]).tolist()]
    middle = [(a + b) // 2 for a, b in zip(cuts, cuts[1:])]
    return [ids[a:b] for a, b in [*zip(cuts, cuts[1:]), *zip(middle, middle[1:])]]


class Block:
    """Segments of some test items with the index of their 3-grams."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items, self.segments = [], []
        for item, w in items:
            ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64)
            for part in segments(ids) if len(ids) >= GRAM else []:
                self.items.append(item)
                self.segments.append(part)
        self.size = max(1, len(self.vocabulary))
        self.vocabulary[_BREAK] = -2
        codes = [self.codes(s) for s in self.segments]
        self.grams = np.unique(np.concatenate([*codes, np.empty(0, np.int64)]))
        self.sizes = np.array([len(x) for x in self.segments], np.int64)
        #: segments of each 3-gram and its place in them, one after another
        gram = np.searchsorted(self.grams, np.concatenate([*codes, np.empty(0, np.int64)]))
        order = np.argsort(gram, kind="stable")
        self.segment_of = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order]
        self.place_of = np.concatenate([*(np.arange(len(c)) for c in codes), np.empty(0, np.int64)]).astype(np.int64)[order]
        self.gram_from = np.searchsorted(gram[order], np.arange(len(self.grams) + 1))
        #: (segment, word) pairs
        self.pairs = np.unique(np.concatenate([*(k * self.size + x for k, x in enumerate(self.segments)), np.empty(0, np.int64)]))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for each 3-gram; -1 where a word is in no item."""
        if len(ids) < GRAM:
            return np.empty(0, np.int64)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        return np.where((a >= 0) & (b >= 0) & (c >= 0), (a * self.size + b) * self.size + c, -1)

    def read(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of the texts one after another, -1 for words of no
        item and between texts, and where each text starts."""
        w = (b" " + _BREAK + b" ").join((t or b"").translate(_TO_WORDS) for t in texts).split()
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w))
        starts = np.concatenate([[0], np.nonzero(ids == -2)[0] + 1])
        ids[ids == -2] = -1
        return ids, starts

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, 3-gram) of the item 3-grams in a text."""
        code = self.codes(ids)
        at = np.nonzero(code >= 0)[0]
        if not len(at) or not len(self.grams):
            return at[:0], at[:0]
        gram = np.minimum(np.searchsorted(self.grams, code[at]), len(self.grams) - 1)
        ok = self.grams[gram] == code[at]
        return at[ok], gram[ok]

    def candidates(self, ids: np.ndarray, starts: np.ndarray):
        """(text, segment, first, last) word windows around the diagonals with
        seeds, but for those that can't reach the threshold."""
        at, gram = self.found(ids)
        many = self.gram_from[gram + 1] - self.gram_from[gram]
        steps = np.searchsorted(np.cumsum(many), np.arange(STEP, int(many.sum()) + STEP, STEP), side="right")
        for a, b in zip([0, *steps.tolist()], steps.tolist()):
            yield from self.windows(ids, starts, at[a:b], gram[a:b], many[a:b])

    def windows(self, ids, starts, at, gram, many):
        if not len(at):
            return
        nth = _runs(self.gram_from[gram], many)
        k, at = self.segment_of[nth], np.repeat(at, many)
        text, diagonal = np.searchsorted(starts, at, side="right") - 1, at - self.place_of[nth]
        pad = self.sizes[k] // 4 + 2
        # neighbouring diagonals share a window that holds the window of each
        near = diagonal // (pad + 1)
        order = np.lexsort((diagonal, near, k, text))
        text, k, near, diagonal, pad = (x[order] for x in (text, k, near, diagonal, pad))
        new = np.ones(len(k), bool)
        new[1:] = (text[1:] != text[:-1]) | (k[1:] != k[:-1]) | (near[1:] != near[:-1])
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(k)) - 1
        text, k, pad = text[first], k[first], pad[first]
        ends = np.append(starts[1:] - 1, len(ids))
        low = np.maximum(starts[text], diagonal[first] - pad)
        high = np.minimum(ends[text], diagonal[last] + self.sizes[k] + 2 * pad)
        # a match needs a word of the segment: the score is at most MATCH for each
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        least = THRESHOLD * self.sizes[k] - 1e-6
        ok = np.nonzero(known[high] - known[low] >= least)[0]
        for part in np.array_split(ok, -(-int((high - low)[ok].sum()) // STEP)) if len(ok) else []:
            size = (high - low)[part]
            word = ids[_runs(low[part], size)]
            pair = np.repeat(k[part], size) * self.size + word
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            held = np.concatenate([[0], np.cumsum((word >= 0) & (self.pairs[place] == pair))])
            end = np.cumsum(size)
            part = part[held[end] - held[end - size] >= least[part]]
            yield from zip(text[part].tolist(), k[part].tolist(), low[part].tolist(), high[part].tolist())


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, one run after another."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


def align(query: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row of ``query`` (n, l) in the same
    row of ``rows`` (n, w), and the column where it ends; -1 never matches and
    -2 (padding of the query) scores nothing."""
    n, w = rows.shape
    ramp = np.arange(w, dtype=np.int32) * -GAP
    h = np.zeros((n, w + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(query.shape[1]):
        q = query[:, i:i + 1]
        step = np.where((rows == q) & (q >= 0), MATCH, OTHER)
        new = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] + GAP), 0)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        h = np.concatenate([np.zeros((n, 1), np.int32), np.where(q == -2, 0, new)], axis=1)
        col = h[:, 1:].argmax(axis=1)
        top = h[np.arange(n), col + 1]
        better = top > best
        best[better], end[better] = top[better], col[better]
    return best, end


def score_text(block: Block, texts: list) -> list[list[tuple]]:
    """For each text its best (item, score, first word, last word) per item."""
    out = [{} for _ in texts]
    queue = []

    def flush():
        if not queue:
            return
        rows = np.full((len(queue), max(len(x[2]) for x in queue)), -1, np.int64)
        query = np.full((len(queue), max(len(block.segments[x[1]]) for x in queue)), -2, np.int64)
        for i, (_, k, window, _) in enumerate(queue):
            rows[i, :len(window)] = window
            query[i, :len(block.segments[k])] = block.segments[k]
        best, end = align(query, rows)
        for (t, k, _, first), score, last in zip(queue, best.tolist(), end.tolist()):
            size = len(block.segments[k])
            part = score / (MATCH * size)
            item = block.items[k]
            if part >= THRESHOLD and (item not in out[t] or part > out[t][item][0]):
                out[t][item] = (part, max(first, first + last + 1 - size), first + last)
        queue.clear()

    for base, part in slices(texts):
        ids, starts = block.read(part)
        for t, k, first, last in block.candidates(ids, starts):
            queue.append((base + t, k, ids[first:last].copy(), first - int(starts[t])))
            if len(queue) == 2048:
                flush()
    flush()
    return [[(i, round(s, 6), a, b) for i, (s, a, b) in sorted(d.items())] for d in out]


def blocks(benchmark: DataFrame):
    """Blocks of test items, a bounded number of words at a time; an item longer
    than a block fills one alone."""
    held, size = [], 0
    for r in benchmark.select("item_id", lowered().alias("text")).where("item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        w = words(None if r.text is None else bytes(r.text))
        if held and size + len(w) > BLOCK_WORDS:
            yield Block(held)
            held, size = [], 0
        held.append((r.item_id, w))
        size += len(w)
    if held:
        yield Block(held)


def leaks_column(block: Block, text: str = "text"):
    """Array of (item_id, score, first_word, last_word) found in the text."""
    kind = "array<struct<item_id:long,score:double,first_word:long,last_word:long>>"
    made = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    @F.arrow_udf(kind)
    def leaks(texts: pa.Array) -> pa.Array:
        names = ("item_id", "score", "first_word", "last_word")
        return pa.array([[dict(zip(names, x)) for x in d] for d in score_text(block, texts.to_pylist())], made)

    return leaks(lowered(text))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: a row for each document and
    test item with an alignment of at least ``THRESHOLD``."""
    small_batches(docs.sparkSession)
    out = None
    for block in blocks(benchmark):
        part = docs.select("doc_id", F.explode(leaks_column(block)).alias("x")).select("doc_id", "x.*")
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, last_word long")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of a test item."""
    small_batches(docs.sparkSession)
    for block in blocks(benchmark):
        docs = docs.where(F.size(leaks_column(block)) == 0)
    return docs
