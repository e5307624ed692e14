"""Text columns: whitespace, title case, city names, token lists.

Everything runs in the JVM. The one exception is Unicode compatibility folding (NFKC), which Spark lacks: strings
that NFKC could change are sent to an Arrow UDF, all others pass it as NULL and never leave the JVM as text.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that counts as white space when text is split into words.
SPACE = r"[\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Lower-case spelling -> city.
CITY_ALIASES = {
    "bengaluru": "Bangalore",
    "bangalore": "Bangalore",
    "gurugram": "Gurgaon",
    "gurgaon": "Gurgaon",
    "new delhi": "Delhi",
    "ncr": "Delhi",
    "mumbai": "Mumbai",
    "bombay": "Mumbai",
}

# Text that may need more than its outer blanks removed holds one of these, or two blanks in a row.
_UNUSUAL = "[^ -~]"

_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"
_WORD_START = rf"(?<=[^{_CASED} ])(?=[{_CASED}])"
_ASCII_WORD_START = r"[!-@\[-`{-~][A-Za-z]"


@lru_cache(maxsize=None)
def _maybe_unstable() -> str:
    """Regex for a character NFKC might touch.

    Below U+0300 no character combines with its neighbour, so a string made only of characters that are NFKC-stable
    on their own and lie below U+0300 is NFKC-stable as a whole. Anything else goes to the UDF.
    """
    ranges: list[list[int]] = []
    for c in range(0x300):
        if not unicodedata.is_normalized("NFKC", chr(c)):
            continue
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


@lru_cache(maxsize=None)
def _folds():
    # Nested so that they travel to the executors by value. Most batches hold only NULLs and return at once.
    def fold_text(s: pd.Series) -> pd.Series:
        from unicodedata import normalize

        return s.map(lambda v: normalize("NFKC", v), na_action="ignore") if s.notna().any() else s

    def fold_parts(s: pd.Series) -> pd.Series:
        from unicodedata import normalize

        if not s.notna().any():
            return s
        return s.map(lambda v: [normalize("NFKC", p) for p in v.split(",")], na_action="ignore")

    def fold_each(s: pd.Series) -> pd.Series:
        from unicodedata import normalize

        if not s.notna().any():
            return s
        return s.map(lambda v: None if v is None else [None if p is None else normalize("NFKC", p) for p in v])

    def fold_row(s: pd.Series) -> pd.Series:
        from json import loads
        from unicodedata import normalize

        if not s.notna().any():
            return s
        # Python's words end at the characters of SPACE.
        return s.map(lambda v: [" ".join(normalize("NFKC", p).split()) for p in loads(v)], na_action="ignore")

    return (
        F.pandas_udf(fold_text, "string"),
        F.pandas_udf(fold_parts, "array<string>"),
        F.pandas_udf(fold_each, "array<string>"),
        # A filter on folded text is not to move below the fold, which would then run twice.
        F.pandas_udf(fold_row, "array<string>").asNondeterministic(),
    )


def has_non_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def _unstable(text: Column) -> Column:
    # The byte count settles plain ASCII without running the regex.
    return has_non_ascii(text) & text.rlike(_maybe_unstable())


def nfkc(text: Column) -> Column:
    return F.coalesce(_folds()[0](F.when(_unstable(text), text)), text)


def nfkc_parts(text: Column) -> Column:
    # Split first: folding may turn other characters into commas, and those do not separate.
    return F.coalesce(_folds()[1](F.when(_unstable(text), text)), F.split(text, ","))


def _nfkc_each(items: Column) -> Column:
    unstable = F.exists(items, lambda x: F.coalesce(_unstable(x), F.lit(False)))
    return F.coalesce(_folds()[2](F.when(unstable, items)), items)


def nfkc_row(texts: list[Column], parts: Column) -> Column:
    """Folded and squeezed: ``texts``, then the parts of a comma list, or NULL if NFKC changes none of them.

    One UDF for a whole row. ``texts`` must not be NULL; a NULL list has no parts.
    """
    unstable = reduce(Column.__or__, [_unstable(t) for t in (*texts, F.coalesce(parts, F.lit("")))])
    items = F.concat(F.array(*texts), F.coalesce(F.split(parts, ","), F.array().cast("array<string>")))
    # As JSON: a column of lists costs ten times as much on its way to Python, even if all are NULL.
    return _folds()[3](F.when(unstable, F.to_json(items)))


def strip(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike("^[^!-~]|[^!-~]$"), F.regexp_replace(trimmed, f"^{SPACE}+|{SPACE}+$", "")).otherwise(
        trimmed
    )


def _is_plain(trimmed: Column) -> Column:
    """Printable ASCII whose words are one blank apart, as nearly all text is: the wide patterns find nothing in it."""
    return ~(trimmed.contains("  ") | trimmed.rlike(_UNUSUAL))


def squeeze(text: Column) -> Column:
    """Words joined by single spaces."""
    trimmed = F.trim(text)
    return F.when(_is_plain(trimmed), trimmed).otherwise(F.trim(F.regexp_replace(trimmed, f"{SPACE}+", " ")))


def normalize_whitespace(text: Column) -> Column:
    """NFKC, then words joined by single spaces."""
    return squeeze(nfkc(text))


def title_case(text: Column) -> Column:
    """Title case in which every run of letters starts a word (``domino's`` -> ``Domino'S``).

    Expects whitespace-normalised text. ``initcap`` only sees spaces, so each inner word start is marked with two
    spaces, which normalised text cannot hold, and the marks are removed afterwards.
    """
    starts = text.rlike(_ASCII_WORD_START) | text.rlike(_UNUSUAL)
    marked = F.when(starts, F.regexp_replace(text, _WORD_START, "  ")).otherwise(text)
    return F.replace(F.initcap(marked), F.lit("  "), F.lit(""))


def city_of(text: Column) -> Column:
    """City name of whitespace-normalised text: alias table, else title case."""
    aliases = F.create_map(*[F.lit(x) for kv in CITY_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(aliases, F.lower(text)), title_case(text))


def normalize_city(text: Column) -> Column:
    return city_of(normalize_whitespace(text))


def lower_tokens(items: Column) -> Column:
    """Normalise and lower-case each array item and drop blanks; order and repeats stay."""
    return F.filter(F.transform(_nfkc_each(items), lambda t: F.lower(squeeze(t))), lambda t: t != "")


def tokens_of(parts: Column) -> Column:
    """Lower-case tokens of already split text, first occurrence of each; NULL -> empty."""
    tokens = F.transform(parts, lambda t: F.lower(squeeze(t)))
    return F.coalesce(F.array_distinct(F.filter(tokens, lambda t: t != "")), F.array().cast("array<string>"))


def split_tokens(text: Column, parts: Column) -> Column:
    """``tokens_of(parts)``, the NFKC parts of a comma list; a plain list is split as a whole, without them."""
    trimmed = F.trim(text)
    closed = F.replace(F.replace(F.lower(trimmed), F.lit(" ,"), F.lit(",")), F.lit(", "), F.lit(","))
    plain = F.array_distinct(F.array_remove(F.split(closed, ","), ""))
    return F.when(_is_plain(trimmed), plain).otherwise(tokens_of(parts))


def split_cuisines(text: Column) -> Column:
    """Comma list -> lower-case tokens, first occurrence of each; NULL or blank -> empty."""
    return split_tokens(text, nfkc_parts(text))


def split_free_text(text: Column) -> Column:
    """Comma or newline list -> trimmed non-blank parts."""
    parts = F.transform(F.split(text, "[,\n]"), strip)
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))
