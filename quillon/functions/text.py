"""Text operators as column expressions: words, n-grams, filters, classes, case and UTF-8 structure.

Every function takes columns and returns one, so plans stay in generated code. A null input gives a null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_UTF16, MAX_UTF32, MAX_LEGAL_UTF32 = 0xFFFF, 0x7FFFFFFF, 0x10FFFF
LETTERS = r"\p{L}"
#: Group predicates over Unicode general categories.
GROUPS = {
    "letter": r"\p{L}",
    "cased_letter": r"[\p{Lu}\p{Ll}\p{Lt}]",
    "mark": r"\p{M}",
    "number": r"\p{N}",
    "punctuation": r"\p{P}",
    "symbol": r"\p{S}",
    "separator": r"\p{Z}",
    "other": r"\p{C}",
    "hieroglyph": r"\p{IsHan}",
}
#: The thirty general categories.
CATEGORIES = (
    "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split()
)


def words(text: Column, letters: str = LETTERS) -> Column:
    """Maximal runs of letters, in order, case kept."""
    return F.array_remove(F.split(text, f"[^{letters}]+"), "")


def symbols(text: Column) -> Column:
    """The code points of a text, one string each."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def code_points(text: Column) -> Column:
    """The code points of a text as numbers."""
    return F.transform(symbols(text), F.ascii)


def from_code_points(codes: Column) -> Column:
    """Encode code points as UTF-8; beyond U+10FFFF becomes U+FFFD."""

    def octets(c: Column) -> Column:
        more = lambda shift: F.lpad(F.hex(F.shiftright(c, shift).bitwiseAND(0x3F).bitwiseOR(0x80)), 2, "0")
        return (
            F.when(c < 0x80, F.lpad(F.hex(c), 2, "0"))
            .when(c < 0x800, F.concat(F.hex(F.shiftright(c, 6).bitwiseOR(0xC0)), more(0)))
            .when(c < 0x10000, F.concat(F.hex(F.shiftright(c, 12).bitwiseOR(0xE0)), more(6), more(0)))
            .when(c <= MAX_LEGAL_UTF32, F.concat(F.hex(F.shiftright(c, 18).bitwiseOR(0xF0)), more(12), more(6), more(0)))
            .otherwise(F.lit("EFBFBD"))
        )

    return F.decode(F.unhex(F.array_join(F.transform(codes, octets), "")), "UTF-8")


def ngrams(items: Column, low: int, high: int) -> Column:
    """All runs of low to high items, by start, then length; joined to strings."""
    if low < 1 or low > high:
        raise ValueError("n-gram lengths need 1 <= low <= high")
    n = F.size(items)
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: F.transform(
                F.filter(F.sequence(F.lit(low), F.lit(high)), lambda k: i + k - 1 <= n),
                lambda k: F.array_join(F.slice(items, i, k), ""),
            ),
        )
    )
    return F.when(n > 0, runs).when(items.isNotNull(), F.array().cast("array<string>"))


def kgrams(word: Column, most: int) -> Column:
    """Lower-case substrings of ^word$ of 3 to `most` code points, by length, then start."""
    marked = F.concat(F.lit("^"), lower(word), F.lit("$"))
    n = F.length(marked)
    top = F.least(F.lit(most), n)
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(3), F.greatest(top, F.lit(3))),
            lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(marked, i, k)),
        )
    )
    return F.when(top >= 3, grams).when(word.isNotNull(), F.array().cast("array<string>"))


def distinct_kgrams(words: Column, most: int) -> Column:
    """The distinct k-grams of some lower-case words, as kgrams() gives them; no word holds a line break."""
    marked = F.concat(F.lit("^"), F.array_join(words, "$\n^"), F.lit("$"))
    grams = [F.regexp_extract_all(marked, F.lit(rf"(?=([^\n]{{{k}}}))[^\n]"), F.lit(1)) for k in range(3, most + 1)]
    return F.when(F.size(words) > 0, F.array_distinct(F.concat(F.array().cast("array<string>"), *grams))).when(words.isNotNull(), F.array().cast("array<string>"))


def filtered(items: Column, keep, change=lambda x: x) -> Column:
    """Drop items by a predicate, change the others."""
    return F.transform(F.filter(items, keep), change)


def alpha_filter(text: Column) -> Column:
    """Letters in lower case; a run of separators becomes one space, and all else goes."""
    return lower(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{Z}]", ""), r"\p{Z}+", " "))


def is_class(symbol: Column, *categories: str) -> Column:
    """Whether a symbol is in one of the general categories."""
    unknown = set(categories) - set(CATEGORIES)
    if unknown:
        raise ValueError(f"no such category: {sorted(unknown)}")
    return symbol.rlike("^[" + "".join(rf"\p{{{c}}}" for c in categories) + "]$")


def is_group(symbol: Column, group: str) -> Column:
    """Whether a symbol is in one of GROUPS."""
    return symbol.rlike(f"^{GROUPS[group]}$")


def symbol_class(symbol: Column) -> Column:
    """The general category of a symbol."""
    out = F.when(F.lit(False), F.lit(""))
    for c in CATEGORIES:
        out = out.when(symbol.rlike(rf"^\p{{{c}}}$"), F.lit(c))
    return out


def _simple(symbol: Column, mapped: Column) -> Column:
    return F.when(F.length(mapped) == F.length(symbol), mapped).otherwise(symbol)


def lower(text: Column) -> Column:
    return F.lower(text)


def upper_symbol(symbol: Column) -> Column:
    """One-to-one upper case: a symbol whose upper case is longer stays as it is."""
    return _simple(symbol, F.upper(symbol))


def lower_symbol(symbol: Column) -> Column:
    """One-to-one lower case."""
    return _simple(symbol, F.lower(symbol))


def filter_line(line: Column, letters: str) -> Column:
    """Keep a line that is one date attribute; in others each character that is no letter becomes a space."""
    return F.when(line.rlike(r"^\$[A-Za-z_]+:\d{4}-\d{2}-\d{2}$"), line).otherwise(F.regexp_replace(line, f"[^{letters}]", " "))
