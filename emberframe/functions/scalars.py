"""Scalar expressions: dates, numbers, labels, identifiers, ladders. Column in, Column out; nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .unicode import ascii_letters, casefolded

#: Accented letters and their plain forms, for labels and for slugs (which know ten only).
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüçñÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN"
SLUG_FROM, SLUG_TO = "áàéèíóòúüç", "aaeeioouuc"
PROVINCES = ("alicante", "castellon", "valencia")


def is_missing(c: Column) -> Column:
    """Null or white space only."""
    return c.isNull() | (F.trim(c) == "")


def text_of(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def int_of(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("int")


def source_date(c: Column) -> Column:
    """day/month/year, else year-month-day, padded or not; else null."""
    t = F.trim(c)
    return F.coalesce(F.try_to_date(t, "d/M/yyyy"), F.try_to_date(t, "yyyy-M-d"))


def date_error(c: Column) -> Column:
    """Why a date is not read; null for dates and blanks."""
    return F.when(~is_missing(c) & source_date(c).isNull(), F.concat(F.lit("unparsed date: "), F.trim(c)))


def spanish_date(c: Column) -> Column:
    return F.try_to_date(F.trim(c), "d/M/yyyy")


def perimeter_date(c: Column) -> Column:
    """The first ten characters as year-month-day."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-M-d")


def instant(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), "Z$", "+00:00"))


def spanish_decimal(c: Column) -> Column:
    """1.000,5 is 1000.5."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\.", ""), ",", ".").try_cast("double")


def plain_number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def comma_decimal(c: Column) -> Column:
    """Comma as point, exact; the last step gives a double."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("decimal(18,4)").cast("double")


def typed_key(c: Column, kind: str) -> Column:
    """Values of different types differ: int:1 is not str:"1"."""
    return F.concat(F.lit(f"{kind}:"), F.to_json(F.struct(c.alias("v")))) if kind == "str" else F.concat(F.lit(f"{kind}:"), c.cast("string"))


def percent_encoded(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def namespaced_id(space: str, c: Column) -> Column:
    return F.concat(F.lit(space), percent_encoded(c))


def _words_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def label(c: Column) -> Column:
    """Compatibility forms in plain ASCII, other characters dropped, lower case, runs of anything else one space."""
    return _words_only(F.lower(ascii_letters(c)))


def alias(c: Column) -> Column:
    """Case folded, without accents; letters that have no plain form part words."""
    return _words_only(casefolded(c))


def alias_parts(c: Column) -> Column:
    """The aliases of a name's forms around slashes, blank ones left out."""
    return F.filter(F.transform(F.split(casefolded(c), "/"), _words_only), lambda x: x != "")


def folded(c: Column) -> Column:
    """Accents off, lower case, all else kept."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def slug(c: Column) -> Column:
    """Null and empty are unknown."""
    body = F.regexp_replace(F.translate(F.lower(c), SLUG_FROM, SLUG_TO), "[^a-z0-9]+", "-")
    return F.when(c.isNull() | (c == ""), "unknown").otherwise(F.btrim(body, F.lit("-")))


def province_partition(c: Column) -> Column:
    s = slug(c)
    named = "|".join(PROVINCES)
    return F.when(s.rlike(f"^({named})(-|$)"), F.regexp_extract(s, f"^({named})", 1)).otherwise(s)


def province_key(c: Column) -> Column:
    """Alicante before Castellon before Valencia, else null."""
    f = label(c)
    return F.when(F.contains(f, F.lit("alicante")) | F.contains(f, F.lit("alacant")), "alicante").when(F.contains(f, F.lit("castell")), "castellon").when(F.contains(f, F.lit("val")), "valencia")


def canonical_province(c: Column, keep: bool = False) -> Column:
    """Castellon before Valencia before Alicante, on lower-case text; keep: other texts stay instead of null."""
    t = F.lower(c)
    out = F.when(F.contains(t, F.lit("castell")), "castellon").when(F.contains(t, F.lit("val")), "valencia").when(F.contains(t, F.lit("alicante")) | F.contains(t, F.lit("alacant")), "alicante")
    return out.otherwise(c) if keep else out


def temporal_block(year: Column) -> Column:
    decade = (F.floor(year / 10) * 10).cast("int")
    return F.when(year < 2000, "1993-1999").otherwise(F.concat(decade, F.lit("-"), F.when(decade + 9 < 2024, decade + 9).otherwise(2024)))


def year_prefix(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int")


#: Fixed value: a date with or without a time and an offset, as ISO 8601 writes it with hyphens and colons.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def lexical_type(c: Column) -> Column:
    t = F.trim(c)
    a_day = t.rlike(ISO_TIME) & F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    return (
        F.when(is_missing(c), "null").when(t.isin("True", "False", "true", "false"), "boolean").when(t.rlike(r"^[+-]?\d+$"), "integer")
        .when(t.rlike(r"^[+-]?(\d+\.\d*|\d*\.\d+)$"), "decimal").when(a_day, "datetime").otherwise("string")
    )


def clock_invalid(c: Column) -> Column:
    """Not H:MM or HH:MM of a day; blanks are not judged."""
    shape = F.trim(c).rlike(r"^\d{1,2}:\d{2}$")
    hour, minute = (F.regexp_extract(F.trim(c), r"^(\d{1,2}):(\d{2})$", k).try_cast("int") for k in (1, 2))
    return ~is_missing(c) & (~shape | (hour > 23) | (minute > 59))


def year_ramp(year: Column, first: int, last: int, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """A colour between two, clamped."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year - first) / float(last - first)))
    return F.format_string("#%02x%02x%02x", *(F.round(a + part * (b - a)).cast("int") for a, b in zip(low, high, strict=True)))


def html_escaped(c: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def url_parameter(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&#]{name}=([^&#]*)", 1), F.lit(""))


def bounded_int(c: Column, low: int, high: int) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(low, high), n)


def bilingual_signature(c: Column) -> Column:
    """The sorted distinct aliases of a name with several forms; null with one."""
    parts = F.array_sort(F.array_distinct(alias_parts(c)))
    return F.when(F.size(parts) > 1, F.array_join(parts, "|"))


def label_words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(label(c), F.lit("")), " "), lambda x: x != "")


def words_meet(a: Column, b: Column) -> Column:
    """Whether two lists share a word; null if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b))


def labels_meet(a: Column, b: Column) -> Column:
    """Whether two labels share a word; null if a side has none."""
    return words_meet(label_words(a), label_words(b))


def forest_area(wooded: Column, other: Column) -> Column:
    """Sum; with one missing the other, where a wooded 0 beside nothing is nothing."""
    return F.when(wooded.isNotNull() & other.isNotNull(), wooded + other).when(wooded.isNotNull(), F.nullif(wooded, F.lit(0))).otherwise(other)


def total_area(*parts: Column) -> Column:
    some = F.array_compact(F.array(*parts))
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, x: s + x))


def cause_status(code: Column) -> Column:
    return F.when(F.coalesce(code, F.lit("0")).isin("0", "500"), "unknown").otherwise("known")


def area_similarity(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))


def hash_id(prefix: str, length: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256), 1, length))


def canonical_json(*columns: str) -> Column:
    """Fields in name order, nulls written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def name_ordered(c: Column, kind: T.DataType) -> Column:
    """The same value with the fields of structs and the keys of maps in name order, at any depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(name_ordered(c[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: name_ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), name_ordered(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return c


def canonical_rows(rows: DataFrame) -> Column:
    """Each row as JSON with its keys in name order at every depth, nulls written."""
    return F.to_json(name_ordered(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), rows.schema), {"ignoreNullFields": "false"})


#: The forms of reports by first and last year.
FORMS = [
    (1968, 1971, "historical_form_1"), (1972, 1979, "historical_form_2"), (1980, 1982, "historical_form_3"),
    (1983, 1988, "historical_form_4"), (1989, 1989, "historical_form_5"), (1990, 1992, "historical_form_6"),
]


def form_model(year: Column) -> Column:
    return F.coalesce(*(F.when(year.between(first, last), name) for first, last, name in FORMS), F.lit("unknown"))


def coverage_regime(year: Column) -> Column:
    """How completely reports of a year were collected."""
    return F.when(year <= 1979, "selective").when(year <= 1991, "transitional").when(year.isNotNull(), "systematic_or_near_systematic").otherwise("unknown")


def gif(source: Column, forest: Column, total: Column) -> Column:
    """Large fires: by forest area or reported total, 500 ha; satellite rows never."""
    return F.when(source == "effis", False).when(source == "sigif", F.coalesce(total, F.lit(0)) >= 500).otherwise(F.coalesce(forest, F.lit(0)) >= 500)


def zoom_level(zoom: Column) -> Column:
    return F.when(zoom <= 8, "overview").when(zoom <= 10, "regional").otherwise("local")


def location_quality(coordinates: Column, sheet: Column, municipality: Column, place: Column) -> Column:
    """The best of what tells where a report was, from flags."""
    return (
        F.when(coordinates, "raw_coordinate_unvalidated").when(sheet, "map_sheet_or_grid").when(municipality, "municipality")
        .when(place, "textual").otherwise("none")
    )
