"""Scalar functions as Column expressions: text, marks, labels, dates, geometry of points, number formats."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

INF = float("inf")


def fail(message: str, value: Column) -> Column:
    """Raises with the value when a row reaches it."""
    return F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(value.cast("string"), F.lit("null"))))


# Text -----------------------------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, the only text step without a builtin."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def normalized_text(c: Column) -> Column:
    """NFKC, then all white space removed."""
    return without_space(nfkc(c))


HIRAGANA = "".join(chr(x) for x in range(0x3041, 0x3097))
KATAKANA = "".join(chr(x + 0x60) for x in range(0x3041, 0x3097))


def search_form(c: Column, unicode_form: bool = True) -> Column:
    """Comparison form for searching: NFKC, lower case, hiragana as katakana, no white space."""
    return without_space(F.translate(F.lower(nfkc(c) if unicode_form else c), HIRAGANA, KATAKANA))


def search_key(*cols: Column, unicode_form: bool = True) -> Column:
    """The search form of several fields in a row; a query can match across their borders."""
    return search_form(F.concat_ws(" ", *cols), unicode_form)


def folded_mark(c: Column) -> Column:
    """A mark column: empty stays empty, U+3007 counts as a circle, circles stay, anything else raises."""
    t = F.translate(c, "〇", "○")
    return F.when(t.isin("", "○", "◎"), t).otherwise(fail("unknown mark", c))


def mark_flag(c: Column, mark: str) -> Column:
    """1 if the mark is there, 0 for null or another known mark; unknown ones raise."""
    return F.when(c.isNull() | c.isin("○", "◎"), F.coalesce((c == mark).cast("int"), F.lit(0))).otherwise(fail("unknown mark", c))


def dashed_number(c: Column) -> Column:
    """A count as printed: dashes and empty are 0, thousands separators go."""
    t = F.trim(c)
    return F.when(t.isin("-", "－", "―", ""), F.lit(0)).otherwise(F.regexp_replace(t, ",", "").cast("long")).cast("long")


def digits_or_zero(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).when(c.rlike(r"^\d+$"), c.cast("int")).otherwise(fail("not digits", c)).cast("int")


def era_year(c: Column) -> Column:
    """Gregorian year of a date like S29.10.30 (eras S, H, R); anything else raises."""
    pattern = r"^([SHR])(\d{1,2})\.(\d{1,2})\.(\d{1,2})$"
    base = F.element_at(F.create_map(*[F.lit(x) for x in ("S", 1925, "H", 1988, "R", 2018)]), F.regexp_extract(c, pattern, 1))
    return F.when(c.rlike(pattern), base + F.regexp_extract(c, pattern, 2).cast("int")).otherwise(fail("not an era date", c)).cast("int")


def mapped(c: Column, values: dict[str, str]) -> Column:
    """A closed vocabulary; unknown values raise."""
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), fail("unknown value", c))


def member(c: Column, groups: tuple[str, ...], known: tuple[str, ...]) -> Column:
    """1 if the value is among ``groups``, 0 for null or another known value; unknown ones raise."""
    return F.when(c.isNull() | c.isin(*known), F.coalesce(c.isin(*groups).cast("int"), F.lit(0))).otherwise(fail("unknown value", c)).cast("int")


def measured(c: Column, least: float) -> Column:
    """A length: 0 stands for missing; negative ones and those from 0 to ``least`` raise."""
    return F.when(c == 0, F.lit(None)).when(c >= least, c).when(c.isNotNull(), fail("not a length", c).cast("double"))


def rounded_rings(rings: Column, digits: int = 6) -> Column:
    """Rings (arrays of points) with every coordinate rounded."""
    return F.transform(rings, lambda ring: F.transform(ring, lambda point: F.transform(point, lambda v: F.round(v, digits))))


def size_bytes(c: Column) -> Column:
    """KB, MB and GB text as bytes; other units raise."""
    pattern = r"^\s*([\d.,]+)\s*(KB|MB|GB)\s*$"
    power = F.element_at(F.create_map(*[F.lit(x) for x in ("KB", 1024.0, "MB", 1024.0**2, "GB", 1024.0**3)]), F.regexp_extract(c, pattern, 2))
    return F.when(c.rlike(pattern), F.round(F.regexp_replace(F.regexp_extract(c, pattern, 1), ",", "").cast("double") * power).cast("long")).otherwise(fail("not a size", c))


def stem(c: Column, endings: str) -> Column:
    """Without any of these characters at the end."""
    return F.rtrim(c, F.lit(endings))


def short_name(c: Column, whole: str) -> Column:
    """Without the last character, but for one name."""
    return F.when(c == whole, c).otherwise(F.substring(c, F.lit(1), F.char_length(c) - 1))


def unescaped(c: Column) -> Column:
    """The five character references that HTML needs, ampersand last."""
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(char))
    return c


def stripped_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(c, r"<[^>]*>", " ")), r"\s+", " "))


def plain_number(c: Column) -> Column:
    """A double without a trailing .0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


# Labels of half-open intervals ---------------------------------------------------------------------------------------

#: A label is a lower bound, an upper bound or both. These are the shapes that bounds take, with # for a number, by what they give.
_LOWER, _UPPER = ("#m以上", "#以上"), ("#m未満", "#未満")
LOW_SHAPES = (*_LOWER, "#m~")
HIGH_SHAPES = (*_UPPER, *(f"~{u}" for u in _UPPER), "~#m")
BOTH_SHAPES = (*(f"{lo}{tie}{up}" for lo in _LOWER for tie in ("~", "") for up in _UPPER), "#~#m", "#m~#m")


def label_form(c: Column) -> Column:
    """A label in NFKC with one kind of tilde and no white space."""
    return F.translate(without_space(nfkc(c)), "〜～", "~~")


def label_bounds(c: Column, strict: bool = True) -> Column:
    """struct(low, high) of a label's interval, high infinite where open; else raises, or null if not strict.

    The label's shape, its numbers taken out, tells which bounds it has; the first number is the lower one, the last the upper one.
    """
    t = label_form(c)
    number = r"\d+(?:\.\d+)?"
    shape, numbers = F.regexp_replace(t, number, "#"), F.regexp_extract_all(t, F.lit(number), F.lit(0))
    low = F.when(shape.isin(*LOW_SHAPES, *BOTH_SHAPES), F.try_element_at(numbers, F.lit(1)).cast("double")).otherwise(0.0)
    high = F.when(shape.isin(*HIGH_SHAPES, *BOTH_SHAPES), F.try_element_at(numbers, F.lit(-1)).cast("double")).otherwise(INF)
    known = shape.isin(*LOW_SHAPES, *HIGH_SHAPES, *BOTH_SHAPES) & (low < high)
    kind = "struct<low:double,high:double>"
    otherwise = F.struct(fail("not a label", c).cast("double").alias("low"), F.lit(0.0).alias("high")) if strict else F.lit(None).cast(kind)
    return F.when(known, F.struct(low.alias("low"), high.alias("high"))).otherwise(otherwise)


def canonical_label(low: Column, high: Column) -> Column:
    return F.when(low == 0, F.concat(F.lit("〜"), plain_number(high), F.lit("m"))).when(high == INF, F.concat(plain_number(low), F.lit("m〜"))).otherwise(F.concat(plain_number(low), F.lit("〜"), plain_number(high), F.lit("m")))


def depth_bin(low: Column, bounds: tuple[float, ...] = (0.3, 1.0, 3.0, 10.0)) -> Column:
    """How many of the bounds are reached."""
    return sum(((low >= b).cast("int") for b in bounds[1:]), (low >= bounds[0]).cast("int"))


# Dates and planes ----------------------------------------------------------------------------------------------------


def day_of_cycle(d: Column) -> Column:
    """Day 0 to 364 of a year without leap day; 29 February counts as the 28th."""
    day = F.when((F.month(d) == 2) & (F.day(d) == 29), F.lit(28)).otherwise(F.day(d))
    return (F.dayofyear(F.make_date(F.lit(2001), F.month(d), day)) - 1).cast("long")


LAT_METRES, LON_METRES = 110574.0, 111320.0


def local_x(lon: Column, lon0: Column, lat0: Column) -> Column:
    """Metres east of a point in its own plane."""
    return (lon - lon0) * F.cos(F.radians(lat0)) * LON_METRES


def local_y(lat: Column, lat0: Column) -> Column:
    return (lat - lat0) * LAT_METRES


def box_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """From a point to an axis-aligned box, 0 inside."""
    dx = F.greatest(x0 - x, F.lit(0.0), x - x1)
    dy = F.greatest(y0 - y, F.lit(0.0), y - y1)
    return F.sqrt(dx * dx + dy * dy)


def in_range(lat: Column, lon: Column, box: tuple[float, float, float, float] = (20.0, 46.0, 122.0, 154.0)) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def in_margin(lat: Column, lon: Column, lat0: Column, lat1: Column, lon0: Column, lon1: Column, margin: float) -> Column:
    """Inside a box and a margin; no box, no."""
    return F.coalesce(lat.between(lat0 - margin, lat1 + margin) & lon.between(lon0 - margin, lon1 + margin), F.lit(False))


# Formats -------------------------------------------------------------------------------------------------------------


def signed_slope(c: Column) -> Column:
    """Sign and three decimals; the minus is U+2212."""
    return F.concat(F.when(c < 0, "−").otherwise("+"), F.format_string("%.3f", F.abs(c)))


def p_text(c: Column) -> Column:
    return F.when(c < 1e-6, "< 0.000001").when(c < 0.001, F.regexp_replace(F.format_string("%.1e", c), "e-0", "e-")).otherwise(F.format_string("%.3f", c))


def known_items(c: Column, known: tuple[str, ...], separator: str = ",") -> Column:
    """The items of a list in a text that are known ones, in order."""
    return F.filter(F.split(c, separator), lambda x: x.isin(*known))


def valued(c: Column) -> Column:
    """struct(value, status): empty and null have no value, 0 is one."""
    empty = c.isNull() | (c.cast("string") == "")
    return F.struct(F.when(~empty, c).alias("value"), F.when(empty, "not_available").otherwise("observed").alias("status"))

