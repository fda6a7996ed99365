"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import edits

#: What stands for a bullet.
BULLETS = "•‣◦⁃·∙‧*–—-"
#: Fixed value: a list marker: a bullet, a short number, or up to three letters or digits with a dot or bracket.
MARKER = f"^[ \\t\\x0B\\f\\r]*([{BULLETS}]|[0-9]{{1,3}}|\\(?[A-Za-z0-9]{{1,3}}[.)])[ \\t\\x0B\\f\\r]+"


def collapse(s: Column) -> Column:
    """Runs of ASCII white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(s, "[ \\t\\n\\x0B\\f\\r]+", " "))


def escape_xml(s: Column) -> Column:
    """& < > escaped, after characters that XML does not allow are dropped."""
    s = F.regexp_replace(s, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_attribute(s: Column) -> Column:
    """A text as the value of an attribute between double quotes."""
    return F.replace(escape_xml(s), F.lit('"'), F.lit("&quot;"))


def line_key(s: Column) -> Column:
    """A line's key for comparison: collapsed, lower case, digits kept."""
    return F.lower(collapse(s))


def edit_distance(a: Column, b: Column) -> Column:
    """The edit distance of two texts, many at a time."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(edits.distances(a.to_pylist(), b.to_pylist()), pa.int32())

    return run(a, b)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - edit_distance(a, b) / longer)


#: Fixed value: digits beyond which a number is an amount or an id and counts no pages.
COUNTING_DIGITS = 6


def number_shape(s: Column) -> Column:
    """The text with # for each number; null, so equal to none, where a number is too long to count pages."""
    return F.when(~s.rlike(f"[0-9]{{{COUNTING_DIGITS + 1}}}"), F.regexp_replace(s, "[0-9]+", "#"))


def has_number(s: Column) -> Column:
    return s.rlike("[0-9]")


def numbers(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("[0-9]+"), 0)


def is_list_item(s: Column) -> Column:
    return s.rlike(MARKER + ".")


def strip_marker(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, MARKER, ""))


def count_matches(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)).cast("long")


def is_caps(s: Column) -> Column:
    """At least three letters, of which 80 % are upper case."""
    letters = count_matches(s, "\\p{L}")
    return (letters >= 3) & (count_matches(s, "\\p{Lu}") * 10 >= letters * 8)


def digit_percent(s: Column) -> Column:
    shown = count_matches(s, "[^ \\t\\n\\x0B\\f\\r]")
    return F.when(shown == 0, 0).otherwise(F.floor(100 * count_matches(s, "[0-9]") / shown + 0.5)).cast("long")


def ends_sentence(s: Column) -> Column:
    return s.rlike("[.!?…][ \\t\\n\\x0B\\f\\r]*$")


def has_word(s: Column) -> Column:
    return s.rlike("\\p{L}{2,}")


def _folded() -> tuple[str, str]:
    """Lower-case letters that decompose into a letter and accents (U+0300 to U+036F), and those letters."""
    marked, plain = "", ""
    for c in map(chr, range(0xC0, 0x2000)):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if bare != c == c.lower() and len(bare) == 1:
            marked, plain = marked + c, plain + bare
    return marked, plain


#: Letters with accents, and what search folds them to.
MARKED, PLAIN = _folded()


def fold(s: Column) -> Column:
    """Lower case without accents; ß and ligatures stay."""
    return F.regexp_replace(F.translate(F.lower(s), MARKED, PLAIN), "[\\u0300-\\u036F]", "")


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def snippet(s: Column, at: Column) -> Column:
    """30 characters before a hit (1-based place) and 40 from it on."""
    start = F.greatest(F.lit(1), at - 30)
    return F.substring(s, start, at - start + 40)


def four_decimals(x: Column) -> Column:
    """Up to four decimals, no trailing zeros, no negative zero; 0 where there is no finite number."""
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), "\\.$", "")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(~finite | shown.isin("-0", "0"), "0").otherwise(shown)


def half_points(x: Column) -> Column:
    return F.floor(x * 2 + 0.5) / 2


def upper_median(xs: Column) -> Column:
    """The element at n div 2 of the sorted array."""
    return F.sort_array(xs)[F.floor(F.size(xs) / 2).cast("int")]


#: Ranges of strong right-to-left letters, and of scripts that part no words with blanks.
RTL = "\\u0590-\\u08FF\\uFB1D-\\uFDFF\\uFE70-\\uFEFC"
CJK = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uF900-\\uFAFF"


def sanitize(s: Column) -> Column:
    """Characters that XML does not allow become U+FFFD."""
    return F.regexp_replace(s, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "�")


def is_rtl(s: Column) -> Column:
    """More letters of right-to-left scripts than others."""
    rtl = count_matches(s, f"[{RTL}&&[\\p{{L}}]]")
    return rtl * 2 > count_matches(s, "\\p{L}")


def is_ltr_words(s: Column) -> Column:
    """Neither right to left nor written without blanks; an empty text is."""
    return ~is_rtl(s) & ~s.rlike(f"[{CJK}]")


def ends_open(s: Column) -> Column:
    """A line's text with a blank after it, unless it ends in one or in a hyphen."""
    return F.when(s.rlike("[ \\t\\n\\x0B\\f\\r-]$") | (s == ""), s).otherwise(F.concat(s, F.lit(" ")))
