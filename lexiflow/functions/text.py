"""Column -> Column text expressions (cleaning and tokenising).

All of these are built-in Spark expressions, so they run inside whole-stage
codegen. Character classes are written out (``\\p{L}``, ``[\\p{L}\\p{N}_]``)
instead of ``\\w``/``\\s`` shortcuts whose Unicode meaning differs between
regex dialects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Patterns that must match the source semantics.
#   URL and mention removal: "http\S+", "www\S+", "@" followed by word chars.
#   Word characters: letters, digits and underscore.
#   Punctuation kept by the "punct" cleaner: . , ! ? ; : -
#   Punctuation kept by the "light" cleaner: . , ! ? -
#   Cyrillic alphabet of the source: а-яё (lower case, ё listed separately);
#   with Latin: а-яёa-z.
# ---------------------------------------------------------------------------
URL_MENTION = r"(?=[hw@])(?:http\S+|www\S+|@[\p{L}\p{N}_]+)"       # one look at most characters
WORD_CHARS = r"\p{L}\p{N}_"
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"
PUNCT_FULL = r".,!?;:-"
PUNCT_LIGHT = r".,!?-"
ALPHABET_RU = "а-яё"
ALPHABET_RU_LATIN = "а-яёa-z"
ALPHABET_ANY = r"\p{L}"
WS = r"\s"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_to_empty(x) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def collapse_ws(x) -> Column:
    """Whitespace runs -> one space, then trim."""
    return F.trim(F.regexp_replace(_c(x), r"\s(?:\s+|(?<=[\t-\r]))", " "))       # a single space is left as it is


def keep_chars(x, alphabet: str, extra: str = "") -> Column:
    """Drop every character outside ``alphabet``, whitespace and ``extra``."""
    extra_esc = "".join("\\" + ch if ch in "-]\\^[" else ch for ch in extra)
    return F.regexp_replace(_c(x), f"[^{alphabet}{WS}{extra_esc}]", "")


def strip_urls_mentions(x) -> Column:
    return F.regexp_replace(_c(x), URL_MENTION, "")


def clean_strict(x, stopwords: list[str] | None = None, alphabet: str = ALPHABET_RU,
                 min_word_len: int = 3) -> Column:
    """Lower, keep alphabet+space, collapse, drop stopwords and short words."""
    t = collapse_ws(keep_chars(F.lower(null_to_empty(x)), alphabet))
    words = F.split(t, " ")
    stop = F.array(*[F.lit(w) for w in (stopwords or [])]) if stopwords else None

    def keep(w):
        cond = F.length(w) >= min_word_len
        if stop is not None:
            cond = cond & ~F.array_contains(stop, w)
        return cond

    return F.array_join(F.filter(words, keep), " ")


def clean_punct(x, alphabet: str = ALPHABET_RU_LATIN) -> Column:
    """URL/mention strip, collapse+trim, then keep letters and . , ! ? ; : -"""
    t = F.when(_c(x).isNull() | (_c(x) == ""), F.lit("")).otherwise(F.lower(_c(x)))
    t = collapse_ws(strip_urls_mentions(t))
    return keep_chars(t, alphabet, PUNCT_FULL)


def clean_light(x, alphabet: str = ALPHABET_RU_LATIN) -> Column:
    """As P03 but keeps only . , ! ? -"""
    t = F.when(_c(x).isNull() | (_c(x) == ""), F.lit("")).otherwise(F.lower(_c(x)))
    t = collapse_ws(strip_urls_mentions(t))
    return keep_chars(t, alphabet, PUNCT_LIGHT)


def clean_letters(x, alphabet: str = ALPHABET_RU_LATIN) -> Column:
    """Collapse happens before the letter strip, so double spaces survive."""
    t = F.when(_c(x).isNull() | (_c(x) == ""), F.lit("")).otherwise(F.lower(_c(x)))
    t = collapse_ws(strip_urls_mentions(t))
    return keep_chars(t, alphabet)


def clean_letters_normalized(x, alphabet: str = ALPHABET_RU_LATIN) -> Column:
    """Null -> '', URL/mention strip, letters only, collapse+trim last."""
    t = F.lower(null_to_empty(x))
    t = keep_chars(strip_urls_mentions(t), alphabet)
    return collapse_ws(t)


def add_prefix(x, prefix: str = "clustering: ") -> Column:
    """Model prefix before embedding."""
    return F.concat(F.lit(prefix), _c(x))


# ----------------------------------------------------------------- tokenisers

def tokenize_words(x) -> Column:
    """Lower, split on non-word runs, drop empty tokens."""
    return F.filter(F.split(F.lower(null_to_empty(x)), NON_WORD_RUN), lambda t: t != "")


def tokenize_whitespace(x) -> Column:
    """Split on whitespace runs; leading/trailing space yields no token."""
    return F.filter(F.split(null_to_empty(x), r"\s+"), lambda t: t != "")


def tokenize_space(x) -> Column:
    """Split on single spaces, keeping empty tokens."""
    return F.split(null_to_empty(x), " ")


def tokenize_vectorizer(x, min_len: int = 2) -> Column:
    """Lower-cased word tokens of at least ``min_len`` characters, in one match of the text."""
    return F.regexp_extract_all(F.lower(null_to_empty(x)), F.lit(f"[{WORD_CHARS}]{{{max(min_len, 1)},}}"), 0)


SEGMENT_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


def tokenize_segments(x) -> Column:
    """Words, numbers and single punctuation marks, in text order."""
    return F.regexp_extract_all(null_to_empty(x), F.lit(SEGMENT_PATTERN), 0)


def ngrams(tokens, n_min: int = 1, n_max: int = 2) -> Column:
    """All word n-grams with n in [n_min, n_max], space-joined, in order.

    Built from shifted copies of the token array combined with ``zip_with``,
    so each lambda touches only its own arguments and the token array is
    evaluated a fixed number of times per row, not once per element.
    """
    tokens = _c(tokens)
    size = F.size(tokens)
    parts = []
    acc = tokens
    for n in range(1, n_max + 1):
        if n > 1:
            shifted = F.slice(tokens, n, F.greatest(size - n + 1, F.lit(0)))
            acc = F.zip_with(acc, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= n_min:
            parts.append(F.filter(acc, lambda g: g.isNotNull()) if n > 1 else acc)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def remove_stopwords(tokens, stopwords: list[str]) -> Column:
    """Drop listed stopwords from a token array."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(_c(tokens), lambda t: ~F.array_contains(stop, t))


def parse_topic_words(x, n_words: int = 10, strip_prefix: str | None = None) -> Column:
    """Comma string -> trimmed non-empty words, optional prefix strip, first n."""
    words = F.transform(F.split(null_to_empty(x), ","), lambda w: F.trim(w))
    if strip_prefix:
        plen = len(strip_prefix)
        words = F.transform(words, lambda w: F.when(w.startswith(strip_prefix),
                                                    w.substr(F.lit(plen + 1), F.length(w))).otherwise(w))
    return F.slice(F.filter(words, lambda w: w != ""), 1, n_words)
