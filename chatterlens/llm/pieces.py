"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is a sequence of units: a run of spaces with the word after it; no piece
of the vocabulary crosses from a word into spaces, so units are encoded alone.
The different units of a batch that are equally long advance together: for each
end and each piece length, the rolling hashes of all substrings are looked up in
the sorted hashes of the pieces, and the best predecessor is kept as a
backpointer. Of equally good segmentations the one whose last piece is longest
wins, from the end backwards.

The given vocabulary is merge-ranked (BPE). There the best path is that which
the merges leave: a step from one piece to the next is only allowed where no
merge would cross the boundary between them before the pieces are whole, which
the merge trees of the two pieces tell. Exactly one path is left then, and the
ids are those of the SentencePiece library. With ``merges=False`` every step is
allowed and the sum of the piece scores decides, as for unigram vocabularies.
Units that begin with several spaces, whose pieces all rank alike, and the few
of more than ``LONG`` characters replay their merges one by one.

Characters without a piece, and a literal U+2581 (which would decode as a
space), become byte pieces, so decoding gives back every text exactly.

The vocabulary is read on the driver from ``path`` and sent to the tasks as
arrays; it is of fixed size. Defined cases: null stays null, an empty text has
no piece; repeated rows each give a row; whole texts are encoded, of any length.
"""

import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = 0x2581, 0x110000  # the second stands for a U+2581 of the text
#: A character without a piece scores so much below the lowest piece.
UNKNOWN = 10.0
#: Different units remembered by a task at most.
REMEMBERED = 1_000_000
_UNIT = re.compile(r" *[^ ]+| +")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = 0xD6E8FEB86659FD93  # spreads short substrings over the first bits


#: Longer units have too few equals to advance with.
LONG = 48
#: Pairs of pieces whose boundary is remembered by a task: places of a table.
PAIRS = 1 << 21


def _polynomial(points) -> int:
    h = 0
    for p in points:
        h = (h * int(_BASE) + p + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _hash(points) -> int:
    return _polynomial(points) * _MIX & 0xFFFFFFFFFFFFFFFF


class Vocabulary:
    """Arrays of the pieces: texts, scores, sorted hashes, byte pieces, and the
    outer edges of the merge trees."""

    def __init__(self, texts: list[str], scores: list[float], plain: list[bool], byte_ids: list[int], merges: bool = True):
        self.raw, self.merges = np.array(scores, np.float64), merges
        self.by_text = {t: i for i, t in enumerate(texts) if plain[i]}
        usual = min((x for x in scores if x > -1e8), default=0.0)
        #: pieces that the file gives no usable score rank below all others
        self.scores = np.maximum(np.array(scores, np.float64), usual - 1)
        known = [i for i in range(len(texts)) if plain[i] and texts[i]]
        if merges:  # pieces that their own merges lead to
            known = self._edges(texts, known)
        keys = np.array([_hash(map(ord, texts[i])) for i in known], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(known, np.int64)[order]
        #: where keys with these first bits start and how many there are: most
        #: substrings are no piece and fall on none, the others on one or two
        top = (self.keys >> np.uint64(44)).astype(np.int64)
        count = np.bincount(top, minlength=1 << 20)
        self.start, self.some = (np.cumsum(count) - count).astype(np.int32), count > 0
        self.deepest = int(count.max())
        self.keys = np.append(self.keys, np.zeros(self.deepest, np.uint64))
        self.power = np.ones(max([len(texts[i]) for i in known], default=0) + 1, np.uint64)
        self.power[1:] = np.multiply.accumulate(np.full(len(self.power) - 1, _BASE))
        self.lengths = np.unique([len(texts[i]) for i in known])
        self.lowest = usual - UNKNOWN
        self.byte_ids = byte_ids
        #: what a piece decodes to, as bytes
        self.bytes = [t.replace("▁", " ").encode() if p else b"" for t, p in zip(texts, plain)]
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def replay(self, symbols: list[str], trees: dict | None = None) -> list:
        """Merge neighbours that make a piece, the best-scored first, of equals
        the leftmost; ``trees`` gets the parts of each piece made."""
        n = len(symbols)
        text, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def ask(i):
            j = right[i] if i >= 0 else -1
            if j >= 0 and (made := self.by_text.get(text[i] + text[j])) is not None:
                heapq.heappush(heap, (-self.raw[made], i, len(text[i]), len(text[j]), made))

        for i in range(n - 1):
            ask(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i] if text[i] is not None else -1
            if j < 0 or text[j] is None or (len(text[i]), len(text[j])) != (a, b) or self.by_text.get(text[i] + text[j]) != made:
                continue
            if trees is not None:
                trees[made] = (text[i], text[j])
            text[i], text[j] = text[i] + text[j], None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            ask(left[i])
            ask(i)
        return [t for t in text if t is not None]

    def _edges(self, texts, known):
        """Right edges (first part of a pair) and left edges (second part) of the
        merge trees, from the whole piece inwards: ids, and the times (scores,
        falling) at which a node is made and taken into its parent."""
        trees, alone = {}, []
        for i in known:
            own = {}
            if self.replay(list(texts[i]), own) == [texts[i]]:
                alone.append(i)
                if i in own:
                    trees[i] = own[i]
        made = {}

        def when(i):
            if i not in made:
                made[i] = np.inf if i not in trees else min(self.raw[i], *(when(self.by_text[t]) for t in trees[i]))
            return made[i]

        size = len(texts)
        self.spines = []
        depth = 1 + max(map(len, texts))
        for side in (1, 0):
            ids, start, stop = np.full((depth, size), -1, np.int32), np.zeros((depth, size)), np.zeros((depth, size))
            for i in alone:
                node, taken, k = i, -np.inf, 0
                while True:
                    ids[k, i], start[k, i], stop[k, i] = node, when(node), taken
                    if node not in trees:
                        break
                    taken, node, k = when(node), self.by_text[trees[node][side]], k + 1
            deep = int((ids >= 0).any(axis=1).sum())
            self.spines.append((ids[:deep].copy(), start[:deep].copy(), stop[:deep].copy()))
        self.length = np.array([len(t) for t in texts])
        self.plain_hash = np.array([_polynomial(map(ord, t)) for t in texts], np.uint64)
        self.pair_key, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        return alone

    def _find(self, key):
        """Piece of each substring hash, -1 where there is none."""
        top = (key >> np.uint64(44)).astype(np.int64)
        at = self.start[top]
        hit = self.keys[at] == key
        for _ in range(1, self.deepest):
            at = np.where(hit, at, at + 1)
            hit = self.keys[at] == key
        return np.where(hit & self.some[top], self.ids[np.minimum(at, len(self.ids) - 1)], -1)

    def _apart(self, a, b):
        """Whether the merges keep piece ``b`` apart from piece ``a`` before it:
        no node of a's right edge merges with one of b's left edge while both
        stand open."""
        crossed = np.zeros(len(a), bool)
        (ra, sa, ea), (lb, sb, eb) = self.spines
        deep = np.arange(len(a))
        for i in range(len(ra)):
            deep = deep[ra[i, a[deep]] >= 0]  # an edge has no gaps
            row = deep
            for j in range(len(lb)):
                row = row[~crossed[row]]
                row = row[lb[j, b[row]] >= 0]
                if not len(row):
                    break
                p, q = a[row], b[row]
                x, y = ra[i, p], lb[j, q]
                key = (self.plain_hash[x] * self.power[np.minimum(self.length[y], len(self.power) - 1)] + self.plain_hash[y]) * np.uint64(_MIX)
                both = self._find(key)
                score = np.where(both >= 0, self.raw[both], -np.inf)
                opens = np.minimum(np.minimum(sa[i, p], sb[j, q]), score)
                # of equal merges the leftmost goes first: a's own, this one, b's own
                inside, behind = ea[i, p], eb[j, q]
                first = ((opens > inside) | ((opens == inside) & (score > inside))) & ((opens > behind) | ((opens == behind) & (score >= behind)))
                crossed[row[(both >= 0) & first]] = True
        return ~crossed

    def apart(self, a, b):
        """``_apart`` with a table of pairs met before."""
        pair = a.astype(np.int64) * len(self.raw) + b
        place = ((pair.astype(np.uint64) * _BASE) >> np.uint64(64 - PAIRS.bit_length() + 1)).astype(np.int64)
        new = np.nonzero(self.pair_key[place] != pair)[0]
        ok = self.pair_ok[place]
        if len(new):
            _, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            one = new[first]
            found = self._apart(a[one], b[one])
            ok[new] = found[back]
            self.pair_key[place[one]], self.pair_ok[place[one]] = pair[one], found
        return ok

    def _by_score(self, prefix, points, back, piece):
        """Backpointers of the best sums of scores."""
        best = np.zeros(piece.shape)
        for end in range(1, len(piece)):
            # an unknown character first: any piece that does as well replaces it
            best[end] = best[end - 1] + self.lowest
            for length in self.lengths[self.lengths <= end].tolist():
                ids = self._find((prefix[end] - prefix[end - length] * self.power[length]) * np.uint64(_MIX))
                total = np.where(ids >= 0, best[end - length] + self.scores[ids], -np.inf)
                better = total >= best[end]
                best[end] = np.where(better, total, best[end])
                back[end], piece[end] = np.where(better, length, back[end]), np.where(better, ids, piece[end])

    def _by_merges(self, prefix, points, back, piece):
        """Backpointers of the one path that the merges leave: short last pieces
        are tried first, and only while a unit has none yet."""
        for end in range(1, len(piece)):
            # a character without a piece is a step of its own
            rows = np.nonzero(self._find((points[end - 1] + np.uint64(1)) * np.uint64(_MIX)) >= 0)[0]
            for length in self.lengths[self.lengths <= end].tolist():
                if not len(rows):
                    break
                key = (prefix[end, rows] - prefix[end - length, rows] * self.power[length]) * np.uint64(_MIX)
                hit = np.nonzero(self.some[(key >> np.uint64(44)).astype(np.int64)])[0]
                ids = self._find(key[hit])
                hit, ids = hit[ids >= 0], ids[ids >= 0]
                # the start of the unit and unknown characters merge with nothing
                before = piece[end - length, rows[hit]] if length < end else np.full(len(hit), -1, np.int32)
                ok = before < 0
                ok[~ok] = self.apart(before[~ok], ids[~ok])
                hit, ids = hit[ok], ids[ok]
                back[end, rows[hit]], piece[end, rows[hit]] = length, ids
                left = np.ones(len(rows), bool)
                left[hit] = False
                rows = rows[left]

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of units that are all equally long, one after another, and how
        many each unit has."""
        n, size = len(units), len(units[0])
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).T.astype(np.uint64)
        points = np.where(points == SPACE, np.uint64(LITERAL), np.where(points == 32, np.uint64(SPACE), points))
        prefix = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * _BASE + points[i] + np.uint64(1)
        back, piece = np.ones((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int32)
        (self._by_merges if self.merges else self._by_score)(prefix, points, back, piece)
        # all units walk back together
        steps, rows, end = [], np.arange(n), np.full(n, size)
        while len(rows):
            at = end[rows]
            steps.append((rows, at, piece[at, rows]))
            end[rows] = at - back[at, rows]
            rows = rows[end[rows] > 0]
        row, at, ids = (np.concatenate([x[k] for x in reversed(steps)]) for k in range(3))
        order = np.lexsort((at, row))
        row, at, ids = row[order], at[order], ids[order]
        sizes = np.bincount(row, minlength=n)
        if (ids < 0).any():
            spelt = [[p] if p >= 0 else [self.byte_ids[b] for b in units[j][e - 1].encode("utf-8", "surrogatepass")]
                     for j, e, p in zip(row.tolist(), at.tolist(), ids.tolist())]
            sizes = np.bincount(row, [len(x) for x in spelt], n).astype(np.int64)
            ids = np.array([x for part in spelt for x in part], np.int32)
        return ids.astype(np.int32), sizes

    def _replayed(self, unit: str) -> np.ndarray:
        symbols = ["▁" if c == " " else "\0literal" if c == "▁" else c for c in unit]
        out = []
        for part in self.replay(symbols):
            i = self.by_text.get(part)
            out += [i] if i is not None else [self.byte_ids[b] for b in ("▁" if part == "\0literal" else part).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32)

    def encode(self, texts: list, memory: "Memory") -> list:
        """Arrays of piece ids of the texts."""
        split = [[] if not t else _UNIT.findall(" " + t) for t in texts]
        every = list(chain.from_iterable(split))
        fresh = set(every) - memory.index.keys()
        if len(memory.index) + len(fresh) > REMEMBERED:
            memory.clear()
            fresh = set(every)
        by_size = {}
        for u in fresh:
            alone = self.merges and (u[:2] == "  " or u == " " or len(u) > LONG)
            by_size.setdefault(0 if alone else len(u), []).append(u)
        for u in by_size.pop(0, []):
            ids = self._replayed(u)
            memory.add([u], ids, np.array([len(ids)]))
        for size, same in by_size.items():
            step = max(1, 2_000_000 // size)
            for at in range(0, len(same), step):
                memory.add(same[at:at + step], *self.segment(same[at:at + step]))
        ids, ends = memory.read(every)
        last = np.cumsum([len(u) for u in split])
        parts = np.split(ids, np.append(0, ends)[last[:-1]]) if texts else []
        return [None if t is None else part for t, part in zip(texts, parts)]

    def decode(self, ids) -> str | None:
        """Text of piece ids; the space put before the text goes."""
        if ids is None:
            return None
        ids, out = np.asarray(ids, np.int64), []
        for at in range(0, len(ids), 1 << 20):
            out.append(_gather(self.flat, self.first[ids[at:at + (1 << 20)]], self.sizes[ids[at:at + (1 << 20)]])[0].tobytes())
        text = b"".join(out)
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def _gather(flat, first, sizes):
    """Stretches of ``flat`` one after another, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first - (ends - sizes), sizes) + np.arange(total)], ends


class Memory:
    """Pieces of units met before."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.index, self.ids, self.sizes, self.new = {}, np.empty(0, np.int32), np.empty(0, np.int64), []

    def add(self, units, ids, sizes):
        known = len(self.index)
        self.index.update(zip(units, range(known, known + len(units))))
        self.new.append((ids, sizes))

    def read(self, units):
        """Pieces of the units one after another, and where each unit's end."""
        if self.new:
            self.ids = np.concatenate([self.ids, *(x[0] for x in self.new)])
            self.sizes = np.concatenate([self.sizes, *(x[1] for x in self.new)])
            self.new = []
        at = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        return _gather(self.ids, (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at])


@lru_cache(maxsize=2)
def load(path: str = MODEL, merges: bool = True) -> Vocabulary:
    """Vocabulary of a SentencePiece model file; ``merges`` for merge-ranked ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the vocabulary has no byte pieces")
    return Vocabulary(texts, [model.get_score(i) for i in range(n)], plain, byte_ids, merges)


#: In a Python worker: each model with what its tasks have met so far.
_kept: dict = {}


def _met(path: str, sent: Vocabulary) -> tuple[Vocabulary, Memory]:
    """The worker's own copy: tasks call this by name, so it is not sent along."""
    return _kept.setdefault(path, (sent, Memory()))


def encode_column(text="text", path: str = MODEL):
    """struct<ids array<int>, lossless boolean>: the pieces of a text, and whether
    they decode to exactly that text (null for null)."""
    sent = load(path)
    made = pa.struct([("ids", pa.list_(pa.int32())), ("lossless", pa.bool_())])

    @F.arrow_udf("struct<ids:array<int>,lossless:boolean>")
    def encoded(texts: pa.Array) -> pa.Array:
        vocabulary, memory = _met(path, sent)
        parts, exact, sizes = [], [], []
        texts = texts.to_pylist()
        for _, part in slices(texts):
            for text, ids in zip(part, vocabulary.encode(part, memory)):
                exact.append(None if text is None else vocabulary.decode(ids) == text)
                sizes.append(None if text is None else len(ids))
                if text is not None:
                    parts.append(ids)
        ends = np.cumsum([0, *[s or 0 for s in sizes]])
        offsets = pa.array(ends, pa.int32(), mask=np.array([*[s is None for s in sizes], False], bool))
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.empty(0, np.int32)]), pa.int32()))
        return pa.StructArray.from_arrays([ids, pa.array(exact, pa.bool_())], fields=list(made))

    return encoded(F.col(text) if isinstance(text, str) else text)


def decode_column(ids="ids", path: str = MODEL):
    """Text of an array of piece ids."""
    vocabulary = load(path)

    @F.arrow_udf("string")
    def decoded(arrays: pa.Array) -> pa.Array:
        return pa.array([vocabulary.decode(x) for x in arrays.to_pylist()], pa.string())

    return decoded(F.col(ids) if isinstance(ids, str) else ids)
