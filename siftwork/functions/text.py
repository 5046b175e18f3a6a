"""Text expressions. All are JVM-side; only ``exact`` folding, which also parts Hangul syllables, is an Arrow UDF."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the input format's language knows it, and the words that mean "no value".
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
EMPTY_WORDS = ("", "null", "n/a", "na", "none", "not available", "not provided")
#: A blank text or a word that means "no value", whatever the white space around and within it.
EMPTY = rf"(?i)^{SPACE}*(?:" + "|".join(w.replace(" ", f"{SPACE}+") for w in EMPTY_WORDS if w) + rf")?{SPACE}*\z"
#: One white space character. A wide class is gone through for each character it doesn't hold, so one range tells most of these before.
ONE_SPACE = rf"(?![\x21-\x{{9F}}]){SPACE}"
#: White space that folding changes: a run, one at an end, or other than a plain space.
UNFOLDED = rf"(?![\x21-\x{{9F}}])(?:{SPACE}{{2}}|^{SPACE}|{SPACE}\z|[{SPACE[1:-1]}&&[^ ]])"
MARKS = r"[\x{300}-\x{36F}]+"


def _plain(text: str) -> str:
    """Compatibility form without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not "̀" <= c <= "ͯ")


def _folds() -> tuple[str, str, str, str]:
    """By the rules of ``_plain``: characters that become one other, these others; those that become several, as entries of a map and as a pattern of ranges."""
    singles, several, ranges = [], [], []
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        plain = "" if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF else _plain(c)
        if len(plain) == 1 and plain != c:
            singles.append((c, plain))
        elif len(plain) > 1:
            several.append(f"{c}\x01{plain}")
            if ranges and code - ranges[-1][1] <= 8:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    # what is below all ranges is told by one of them, not by each
    wide = rf"(?![\x00-\x{{{ranges[0][0] - 1:X}}}])[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"
    return "".join(a for a, _ in singles), "".join(b for _, b in singles), "\x02".join(several), wide


_FROM, _TO, _SEVERAL, _WIDE = _folds()
NOT_ASCII = r"[^\x00-\x7F]"


def fold_space(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.when(c.rlike(UNFOLDED), F.trim(F.regexp_replace(c, f"{ONE_SPACE}{SPACE}*", " "))).otherwise(c)


def is_empty_word(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*EMPTY_WORDS)


def clean(c: Column) -> Column:
    """Folded text, null for words that mean "no value"."""
    return F.when(~c.rlike(EMPTY), fold_space(c))


def is_missing(c: Column) -> Column:
    """Null or blank."""
    return c.isNull() | c.cast("string").rlike(rf"^{SPACE}*\z")


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _plain(t))


def _native_plain(c: Column) -> Column:
    """``_plain`` but for Hangul: characters that become several are looked up one by one, in the texts that have any."""
    known = F.str_to_map(F.lit(_SEVERAL), F.lit("\x02"), F.lit("\x01"))
    spelt = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(_WIDE), F.coalesce(F.try_element_at(known, x), x)).otherwise(x)), "")
    return F.regexp_replace(F.translate(F.when(c.rlike(_WIDE), spelt).otherwise(c), _FROM, _TO), MARKS, "")


def strip_marks(c: Column, exact: bool = False) -> Column:
    """Compatibility form without accents; ``exact`` also parts Hangul syllables into letters, as the standard does."""
    if exact:
        return F.coalesce(_nfkd(F.when(c.rlike(NOT_ASCII), c)), c)
    return F.when(c.rlike(NOT_ASCII), _native_plain(c)).otherwise(c)


def fold(c: Column, exact: bool = False) -> Column:
    """Lower-case words of letters and digits, without accents, joined by a space."""
    return F.trim(F.regexp_replace(F.lower(strip_marks(c, exact)), r"[^\p{L}\p{N}]++", " "))


def fold_key(name: str) -> str:
    """A field name's letters and digits; schema-level, so on the driver."""
    return "".join(c for c in _plain(name).lower() if c.isascii() and c.isalnum())


def escape_like(text: str) -> str:
    """``text`` as a LIKE pattern's literal part."""
    for c in "\\%_":
        text = text.replace(c, f"\\{c}")
    return text


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def similar(a: Column, b: Column, least: float) -> Column:
    """Whether ``similarity`` is at least ``least``; cheap differences in length rule most pairs out before the distance is computed."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    possible = F.abs(F.length(a) - F.length(b)) <= longest * (1.0 - least) + 1e-9
    return F.when(possible, similarity(a, b) >= least - 1e-12).otherwise(False)


def redact(c: Column) -> Column:
    """Known key formats are replaced. The patterns."""
    return F.regexp_replace(c, r"(?:fc-[a-zA-Z0-9_-]{12,}|AIza[\w-]{20,}|AQ\.[\w-]{10,})", "[REDACTED]")


def tokens(c: Column, stop_words: tuple[str, ...]) -> Column:
    """Folded words of two characters or more that aren't stop words."""
    return F.filter(F.split(fold(c), " "), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))
