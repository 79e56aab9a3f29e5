"""License notices in whole texts, exact and with a few wrong characters.

A text is lower-cased (A-Z), and its words (runs of digits, letters and bytes
above 7F) are joined by single spaces, so line breaks and punctuation inside a
notice cost nothing. A notice of n characters may hold ``n // 8`` edits: it is cut
into one part more than that, so one part at least of every such copy is exact
(pigeonhole). Each place of a part gives the few characters in which the copy must
lie, and there the ``regex`` library's bounded-error search looks for a copy that
starts and ends with a word; it counts the edits and gives the span. Notices too
short for an edit are found as whole words only.

The search is a column: one text at a time, work in proportion to its length and
to the places of parts, no shuffle. Every place of a part is looked at once,
however many there are.

Defined cases: null and empty texts have no words and no places, labels of
``""`` and a score of 0; places that overlap all count; notices must not be empty
and hold words as above. Edits are counted in characters.
"""

import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: the notices whose exact places are counted -----------------
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# ------------------------------------------------------------------------------

#: Notices that are also found with edits; the labels of the last three are of this search only.
NOTICES = BASE | {
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
}

#: Characters of a notice for one edit.
PER_EDIT = 8

_SPACES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

RESULT = ("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,"
          "score:double,matches:array<struct<label:string,first_word:long,last_word:long,edits:int>>>")
_MATCH = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
_RESULT = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(_MATCH))])


def words_of(text: bytes | None) -> bytes:
    """The words of a text between single spaces, with a space before and after."""
    words = (text or b"").translate(_SPACES).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def parts(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """(offset in characters, bytes) of ``edits + 1`` parts of near-equal length."""
    cuts = [i * len(notice) // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:])]


class Search:
    """Notices with their seeds and patterns; small, sent with the tasks."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], per_edit: int):
        self.base = [(b" " + n.encode() + b" ", label) for n, label in base.items()]
        self.near = []
        for notice, label in notices.items():
            edits = len(notice) // per_edit
            pattern = regex.compile(rf"(?b)(?<= )(?:{re.escape(notice)}){{e<={edits}}}(?= )") if edits else None
            self.near.append((notice, label, edits, parts(notice, edits), pattern))

    def places(self, text: bytes, needle: bytes) -> list[int]:
        out, at = [], text.find(needle)
        while at >= 0:
            out.append(at)
            at = text.find(needle, at + 1)
        return out

    def copies(self, text: bytes, notice: str, edits: int, seeds, pattern) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the best copy near each place of a seed."""
        if not edits:
            return [(at + 1, at + 1 + len(notice.encode()), 0) for at in self.places(text, b" " + notice.encode() + b" ")]
        near = sorted({at - len(notice[:offset].encode()) for offset, part in seeds for at in self.places(text, part)})
        size, reach, found = len(notice.encode()), 4 * edits + 4, set()
        for start in near:
            low = max(0, start - reach)
            window = text[low:start + size + reach].decode("utf-8", "replace")
            m = pattern.search(window)
            if m:
                first = low + len(text[low:start + size + reach].decode("utf-8", "surrogateescape")[:m.start()].encode("utf-8", "surrogateescape")) \
                    if not window.isascii() else low + m.start()
                found.add((first, first + len(m.group().encode()), sum(m.fuzzy_counts)))
        kept: list[tuple[int, int, int]] = []
        for a, b, e in sorted(found):  # of copies that overlap, the one with the fewest edits
            if kept and a < kept[-1][1]:
                if e < kept[-1][2]:
                    kept[-1] = (a, b, e)
            else:
                kept.append((a, b, e))
        return kept

    def scan(self, text: bytes | None) -> dict:
        joined = words_of(text)
        n = joined.count(b" ") - 1
        base = sorted((at, label) for needle, label in self.base for at in self.places(joined, needle)) if n else []
        matches = []
        for notice, label, edits, seeds, pattern in self.near if n else ():
            matches += [(a, b, e, label, 1 - e / len(notice)) for a, b, e in self.copies(joined, notice, edits, seeds, pattern)]
        matches.sort(key=lambda m: (m[0], m[1], m[3]))
        word = _counter(joined)
        # starts ascend, so the words before them are counted in one pass
        starts = {at: word(at) for at in sorted({at for at, _ in base} | {m[0] - 1 for m in matches})}
        spans = [{"label": label, "first_word": starts[a - 1], "last_word": starts[a - 1] + joined.count(b" ", a, b), "edits": e}
                 for a, b, e, label, _ in matches]
        base_labels = {label for _, label in base}
        return {"n_words": n, "n_base": len(base), "first_word": starts[base[0][0]] if base else None,
                "last_word": starts[base[-1][0]] if base else None, "base_labels": ",".join(sorted(base_labels)),
                "labels": ",".join(sorted(base_labels | {m[3] for m in matches})),
                "score": max([1.0 * bool(base), *(m[4] for m in matches)]), "matches": spans}


def _counter(text: bytes):
    """The number of the word after the space at each of some ascending places."""
    state = [0, 0]

    def word(at: int) -> int:
        state[1] += text.count(b" ", state[0], at)
        state[0] = at
        return state[1]

    return word


@lru_cache(maxsize=8)
def _search(base: tuple, notices: tuple, per_edit: int) -> Search:
    return Search(dict(base), dict(notices), per_edit)


def scan_column(text="text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, per_edit: int = PER_EDIT):
    """``RESULT`` of a text column: words, exact places of ``base``, labels and
    spans of ``notices`` with up to one edit for every ``per_edit`` characters, and
    the largest share of a notice that stands (0 where none is found)."""
    settings = tuple(base.items()), tuple(notices.items()), per_edit

    @F.arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        search = _search(*settings)
        return pa.array([search.scan(t) for t in texts.to_pylist()], _RESULT)

    return scanned((F.col(text) if isinstance(text, str) else text).cast("binary"))


def scan_licenses(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """doc_id and the result of the search, a row for every row of ``docs``."""
    return docs.select("doc_id", scan_column(text, **settings).alias("found")).select("doc_id", "found.*")
