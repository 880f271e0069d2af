"""Text cleaning expressions; all stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Null words of the loaders and of the city check, after trim and case folding.
LAKE_NULL_WORDS = ["NAN", "NONE", "", "N/A"]
FLAT_NULL_WORDS = ["NULL", ""]
INVALID_CITY_WORDS = ["", "nan", "na", "n/a", "none", "null", "s/n", "sn", "-", "--", ".", "..."]

# White space as the Unicode standard defines it; SQL trim alone removes spaces only.
WHITESPACE = "".join(
    chr(c) for c in range(0x3001)
    if chr(c).isspace()
)


def _fold_rules() -> tuple[str, str, dict[str, str]]:
    """Single-letter and multi-letter foldings of Latin letters, from their decompositions."""
    letters, plain = [], []
    several: dict[str, str] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0xAA, 0xBA]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base != char and base.isascii() and len(base) == 1:
            letters.append(char)
            plain.append(base)
        elif base != char and base.isascii() and len(base) > 1:
            several[char] = base
    # letters without a decomposition
    for char, base in zip("ØøĐđŁłĦħıŦŧ", "OoDdLlHhiTt", strict=True):
        letters.append(char)
        plain.append(base)
    several.update({"ß": "ss", "ẞ": "SS", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th"})
    # combining marks have no counterpart, so translate() drops them
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(letters) + marks, "".join(plain), several


_FOLD_FROM, _FOLD_TO, _FOLD_SEVERAL = _fold_rules()


def strip_space(c: Column) -> Column:
    """Trim all white space, not only blanks; text between printable ASCII ends is left alone."""
    ends = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(ends, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def upper_trim(c: Column) -> Column:
    return F.upper(strip_space(c))


def null_words(c: Column, words: list[str]) -> Column:
    """Null where the value is one of the given words."""
    return F.when(~c.isin(words), c)


def clean_text(c: Column) -> Column:
    """Trim, upper-case, and turn the loader's null words into null."""
    return null_words(upper_trim(c), LAKE_NULL_WORDS)


def lower_trim(c: Column) -> Column:
    return F.lower(strip_space(c))


def text_or_empty(c: Column) -> Column:
    """Null text becomes the empty string, so that keys always compare."""
    return F.coalesce(c, F.lit(""))


def digits_only(c: Column) -> Column:
    """Keep digits; null gives ''.

    The traces of a float export go first: a fraction of zeros, and the exponent form of a whole number.
    """
    whole = F.when(c.rlike(r"\A\d(\.\d+)?[eE]\+?\d{1,2}\z"), c.try_cast("decimal(38,0)").cast("string"))
    return text_or_empty(F.regexp_replace(F.regexp_replace(F.coalesce(whole, c), r"\.0+\z", ""), "[^0-9]", ""))


def padded_code(c: Column, width: int) -> Column:
    """Digits with the leading zeros a float export has dropped."""
    digits = digits_only(c)
    return F.when((digits != "") & (F.length(digits) < width), F.lpad(digits, width, "0")).otherwise(digits)


def cut(c: Column, width: int) -> Column:
    """Cut to the declared width; null stays null."""
    return F.substring(c, 1, width)


def fold_accents(c: Column) -> Column:
    """Latin letters without their marks."""
    def expand(col: Column, rule: tuple[str, str]) -> Column:
        return F.replace(col, F.lit(rule[0]), F.lit(rule[1]))

    # the letters that become two are rare: skip their replaces when none occurs
    wide = "".join(_FOLD_SEVERAL)
    folded = F.translate(c, _FOLD_FROM, _FOLD_TO)
    return F.when(
        folded.rlike(f"[{re.escape(wide)}]"), reduce(expand, _FOLD_SEVERAL.items(), folded)
    ).otherwise(folded)


def accent_key(c: Column) -> Column:
    """Accent-free upper-case key for matching names."""
    return F.upper(fold_accents(strip_space(c)))


def substitute(c: Column, mapping: dict[str, str]) -> Column:
    """Replace whole values by a small fixed map; other values stay."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def map_lookup(c: Column, mapping: dict) -> Column:
    """Value of a small fixed map; null where absent."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), c)


def only_digits(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d+$"), F.lit(False))


def without_letters(c: Column) -> Column:
    return F.coalesce(c.rlike("^[^a-zA-ZÀ-ÿ]+$"), F.lit(False))


def invalid_city(c: Column) -> Column:
    """City text that cannot be a name: a null word, digits only, or no letter at all."""
    name = text_or_empty(lower_trim(c))
    return name.isin(INVALID_CITY_WORDS) | only_digits(name) | without_letters(name)


def display_label(c: Column) -> Column:
    """Column name as a chart label."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def column_name(name: object) -> str:
    """Header text as a column name: no accents, lower case, other runs as ``_``."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", str(name)) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "_", plain.lower()).strip("_")


def squeeze_space(c: Column) -> Column:
    """White space runs as one blank, ends trimmed, trailing semicolon dropped."""
    return F.regexp_replace(strip_space(F.regexp_replace(c, r"\s+", " ")), r"\s*;$", "")
