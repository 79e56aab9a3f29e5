"""Text scalar functions as pure Column expressions (no Python on executors).

Tokenized text is ``array<array<string>>``: a list of sentences, each a list
of cleaned words.  Cleaning follows the reference rules exactly:

* sentences are split by a documented regex (``SENT_RE``) instead of a
  trained splitter;
* words are split on a single space only, so a newline inside a sentence
  glues two words (``foo\\nbar`` -> ``foobar``);
* each word is lower-cased, then every character outside ``[a-zA-Z ]`` is
  *deleted* (accents, digits, apostrophes), empties are dropped, and only
  then stop words are removed (``don't`` -> ``dont`` survives);
* a null text yields an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import ENGLISH_STOP_WORDS

# --- fixed values -------------------------------------------------------------
# Sentence boundary: a run of terminal punctuation followed by whitespace.
SENT_RE = r"[.!?]+\s+"
# Characters kept by the word cleaner.
NON_ALPHA_RE = "[^a-zA-Z ]"
# End of a sentence in lower-cased text, which has no capital of its own, and
# what goes from such a text.
SENT_END, NON_LOWER_RE = "Z", "[^a-zZ ]+"
# Recurring-thread title alternation (case sensitive), short and long forms.
THREAD_TITLE_RE = (
    "Thread|thread|Sunday Live Chat|consolidation zone|Containment Zone|"
    "Daily Discussion|Daily discussion|Saturday Chat|"
    "What Are Your Moves Tomorrow|What Are Your Moves Today|MEGATHREAD"
)
THREAD_TITLE_LONG_RE = (
    "Afterhours Thread|Discussion Thread|GME thread|GME Thread|"
    "Sunday Live Chat|consolidation zone|Containment Zone|Containment Thread|"
    "Daily Discussion|Daily discussion|Saturday Chat|"
    "What Are Your Moves Tomorrow|What Are Your Moves Today|MEGATHREAD|"
    "Megathread|megathread"
)
# Bodies of removed posts.
REMOVED_BODIES = ["[deleted]\n", "[removed]\n"]
# URL-like token: scheme or www. prefix, or a dotted host with a common TLD.
URL_TOKEN_RE = (
    r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://\S+|www\.\S+|"
    r"\S+\.(?:com|net|org|io|gov|edu|co|uk|de|fr|es|ly|gl|be|me|tv)(?:[/?#:]\S*)?)$"
)
# ------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stop_array(stop_words=None) -> Column:
    words = ENGLISH_STOP_WORDS if stop_words is None else list(stop_words)
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def clean_word(w: Column) -> Column:
    """lower, then delete everything but ASCII letters and space."""
    return F.regexp_replace(F.lower(w), NON_ALPHA_RE, "")


def tokenize(text, stop_words=None) -> Column:
    """Text -> array<array<string>> of cleaned, stop-filtered words.

    ``stop_words=None`` uses the English list; ``stop_words=[]`` keeps all
    words (the vector-training variant).  The text is cleaned as a whole, once, before
    it is split: no space is ever deleted, so the words are those of a word-by-word
    cleaning.
    """
    stops = list(ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    t = _col(text)
    ended = F.regexp_replace(F.lower(t), SENT_RE, SENT_END)
    sentences = F.split(F.regexp_replace(ended, NON_LOWER_RE, ""), SENT_END)

    def per_sentence(s):
        words = F.split(s, " ")
        if stops:
            # ``isin`` over a long literal list is planned as a hash-set lookup
            return F.filter(words, lambda w: (w != "") & ~w.isin(stops))
        return F.filter(words, lambda w: w != "")

    return F.when(t.isNull(), F.array().cast("array<array<string>>")) \
        .otherwise(F.transform(sentences, per_sentence))


def flat_tokens(tokens) -> Column:
    return F.flatten(_col(tokens))


def regex_clean_keep_case(c, null_text: str | None = "nan") -> Column:
    """Delete ``[^a-zA-Z ]`` keeping case; nulls become the text 'nan'."""
    x = _col(c)
    if null_text is not None:
        x = F.coalesce(x.cast("string"), F.lit(null_text))
    return F.regexp_replace(x, NON_ALPHA_RE, "")


def regex_clean_lower(c) -> Column:
    """Lower-case then delete non letters."""
    return F.regexp_replace(F.lower(_col(c)), NON_ALPHA_RE, "")


def alpha_tokens(c, stop_words=None) -> Column:
    """Whitespace tokens made only of letters, lower-cased, stop words out."""
    stops = list(ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    toks = F.split(F.lower(F.trim(_col(c))), r"\s+")
    return F.filter(toks, lambda t: t.rlike("^[a-zA-Z]+$") & ~t.isin(stops))


def replace_url_tokens(c) -> Column:
    """Every whitespace token that looks like a URL becomes ``URL``."""
    toks = F.split(F.trim(_col(c)), r"\s+")
    return F.array_join(
        F.transform(toks, lambda t: F.when(t.rlike(URL_TOKEN_RE), F.lit("URL")).otherwise(t)), " ")


def replace_emoji(c, names_df=None) -> Column:
    """Emoji code points -> ``emoji<name>emoji``.

    Without a name table every pictographic code point becomes ``emojiemoji``
    plus its hex code (a stable stand-in for the Unicode name).  A name table
    ``(glyph, name)`` can be applied with :func:`replace_emoji_with_table`.
    """
    x = _col(c)
    return F.regexp_replace(x, r"([\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}])", " emoji$1emoji ")


def html_to_text(c) -> Column:
    """HTML -> visible text; null-safe.

    Drops script/style/comment bodies, turns tags into spaces, decodes the
    common named and numeric entities and collapses whitespace.
    """
    x = _col(c)
    x = F.regexp_replace(x, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for ent, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                    ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(ent), F.lit(ch))
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return x


def concat_text(*cols, sep: str = " ") -> Column:
    """Title + ' ' + selftext (nulls skipped)."""
    return F.concat_ws(sep, *[_col(c) for c in cols])


def normalise_post_id(c) -> Column:
    """Prefix ``t3_`` when absent."""
    x = _col(c)
    return F.when(x.startswith("t3_"), x).otherwise(F.concat(F.lit("t3_"), x))


def author_or_none(c) -> Column:
    """Missing author -> the literal string ``None``."""
    return F.coalesce(_col(c), F.lit("None"))


def pad_truncate(arr, maxlen: int, pre: bool = True, value: int = 0) -> Column:
    """Fixed-length integer sequence; front padding and front truncation by
    default (keep the last ``maxlen``), or both at the back with ``pre=False``."""
    a = _col(arr)
    n = F.size(a)
    if pre:
        kept = F.when(n > maxlen, F.slice(a, n - maxlen + 1, maxlen)).otherwise(a)
        pad = F.array_repeat(F.lit(value), F.greatest(F.lit(maxlen) - F.size(kept), F.lit(0)))
        return F.concat(pad, kept)
    kept = F.slice(a, 1, maxlen)
    pad = F.array_repeat(F.lit(value), F.greatest(F.lit(maxlen) - F.size(kept), F.lit(0)))
    return F.concat(kept, pad)


def hashed_word_ids(words, vocab_size: int) -> Column:
    """Hashed one-hot word ids in ``1..vocab_size-1`` (0 stays padding)."""
    return F.transform(_col(words), lambda w: F.pmod(F.xxhash64(w), F.lit(vocab_size - 1)) + 1)


def contains_token(tokens, word: str) -> Column:
    """Any sentence holds the token exactly."""
    return F.array_contains(F.flatten(_col(tokens)), F.lit(word))


def contains_substring_token(tokens, part: str) -> Column:
    """Some token contains ``part`` as a substring."""
    return F.exists(F.flatten(_col(tokens)), lambda t: t.contains(part))


def not_thread_title(c, pattern: str = THREAD_TITLE_RE) -> Column:
    """Negated regex match; a null title counts as not matching."""
    return ~F.coalesce(_col(c).rlike(pattern), F.lit(False))
