"""Parsers and formatters of listing text, as column expressions.

Patterns use (?U) so that Java's classes cover all letters and blanks. Entities need Python's table, so
`unescape` alone is an Arrow-batched UDF; `clean_text` sends it the texts with an ampersand and null for all others.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, compact, filled

DASH = "—"


def unescape() -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(t))

    return run


_BLANKS = "\t\r\f\x0b\u00a0"


def clean_text(c: str | Column, entities: bool = True) -> Column:
    """Entities decoded, blanks made one, line indents and empty lines cut, trimmed; empty is null."""
    text = col(c)
    if entities:
        text = F.coalesce(unescape()(F.when(F.contains(text, F.lit("&")), text)), text)
    text = F.regexp_replace(F.translate(text, _BLANKS, " " * len(_BLANKS)), " {2,}", " ")
    lines = F.split(text, "\n", -1)
    rest = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.regexp_replace(x, "(?U)^\\s+", ""))
    text = F.array_join(F.concat(F.slice(lines, 1, 1), F.filter(rest, lambda x: x != "")), "\n")
    return filled(F.regexp_replace(F.regexp_replace(text, "(?U)^\\s+", ""), "(?U)\\s+$", ""))


def _first_number(text: Column) -> Column:
    """From the first digit on, up to what is neither digit, blank, comma nor point; empty without a digit."""
    return F.regexp_replace(F.regexp_replace(text, "(?Us)^\\D+", ""), "(?Us)[^\\d\\s,.].*$", "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\D", "")


def parse_int(c: str | Column) -> Column:
    """All digits of the first number, separators dropped ("44.5" gives 445)."""
    return filled(_digits(_first_number(col(c)))).try_cast("bigint")


def parse_float(c: str | Column) -> Column:
    """The first number; a comma or point with a digit after it starts its decimals, blanks inside are dropped."""
    parts = F.split(_first_number(col(c)), "[,.]", 3)
    decimals = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), "(?Us)\\D.*$", "")
    return F.concat(filled(_digits(parts[0])), F.lit("."), F.when(decimals == "", "0").otherwise(decimals)).try_cast("double")


def price_eur(c: str | Column) -> Column:
    """The number before the euro sign."""
    return parse_int(F.substring_index(col(c), "€", 1))


def price_per_m2(c: str | Column) -> Column:
    """The number of "(... € / m" in parentheses."""
    opened = F.slice(F.split(col(c), "\\("), F.lit(2), F.greatest(F.size(F.split(col(c), "\\(")) - 1, F.lit(0)))
    bare = lambda x: F.regexp_replace(x, "(?U)\\s", "")
    number = lambda x: F.substring_index(bare(x), "€", 1)
    fits = F.filter(opened, lambda x: F.startswith(bare(x), F.concat(number(x), F.lit("€/m"))) & (F.translate(number(x), "0123456789,.", "") == "") & (number(x) != ""))
    return parse_float(F.substring_index(F.try_element_at(fits, F.lit(1)), "€", 1))


def floors(c: str | Column) -> Column:
    """struct(floor, total): the numbers on both sides of a slash, else one number and null."""
    sides = F.split(F.regexp_replace(col(c), "(?U)\\s*/\\s*", "/"), "/")
    pairs = F.zip_with(sides, F.slice(sides, F.lit(2), F.greatest(F.size(sides) - 1, F.lit(0))), lambda x, y: F.struct(F.regexp_replace(x, "(?Us)^.*\\D", "").alias("a"), F.regexp_replace(y, "(?Us)\\D.*$", "").alias("b")))
    pair = F.try_element_at(F.filter(pairs, lambda p: (p["a"] != "") & (p["b"] != "")), F.lit(1))
    return F.struct(F.when(pair.isNotNull(), pair["a"].try_cast("bigint")).otherwise(parse_int(c)).alias("floor"), pair["b"].try_cast("bigint").alias("total"))


#: Fixed value: the word of the link to a map behind an address.
MAP_WORD = "karte"


def address_parts(c: str | Column, entities: bool = False) -> Column:
    """struct(street, number): a trailing "[Karte]" is cut; a last word that starts with a digit is the number."""
    text = clean_text(c, entities)
    bracket = F.lower(F.regexp_replace(F.substring_index(text, "[", -1), "(?U)\\s", ""))
    mapped = F.contains(text, F.lit("[")) & (bracket == MAP_WORD + "]")
    text = F.when(mapped, F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, "[", -1)) - 1), "(?U)\\s+$", "")).otherwise(text)
    words = F.split(text, "(?U)\\s+")
    last = F.try_element_at(words, F.lit(-1))
    numbered = (F.size(words) > 1) & F.regexp_like(last, F.lit("(?U)^\\d")) & (F.regexp_replace(last, "(?U)[\\w./-]", "") == "")
    street = F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - F.length(last)), "(?U)\\s+$", "")
    return F.struct(F.when(numbered, street).otherwise(filled(text)).alias("street"), F.when(numbered, last).alias("number"))


def stable_hash(c: str | Column) -> Column:
    return F.sha2(col(c), 256)


def page_number(c: str | Column) -> Column:
    """Number of an address whose path ends in page<n>.html, else 1."""
    name = F.substring_index(F.substring_index(F.substring_index(col(c), "#", 1), "?", 1), "/", -1)
    number = F.substr(name, F.lit(5), F.length(name) - 9)
    named = F.startswith(name, F.lit("page")) & F.endswith(name, F.lit(".html")) & F.contains(col(c), F.lit("/")) & (F.translate(number, "0123456789", "") == "")
    return F.coalesce(F.when(named, number.try_cast("int")), F.lit(1))


def thousands(c: str | Column) -> Column:
    """Whole number with blanks between thousands."""
    return F.replace(F.format_number(col(c), 0), F.lit(","), F.lit(" "))


def money(c: str | Column, missing: str = "unknown", unit: str = " EUR") -> Column:
    return F.coalesce(F.concat(thousands(c), F.lit(unit)), F.lit(missing))


def fixed(c: str | Column, digits: int) -> Column:
    """A number with so many decimals, rounded on its exact binary value with halves to even, as printf does in C, Python and SQL; Java's %f is not."""
    return F.replace(F.format_number(col(c), digits), F.lit(","), F.lit(""))


def area(c: str | Column, missing: str = "unknown", unit: str = " m2") -> Column:
    """Whole areas without decimals, others with one."""
    v = col(c)
    text = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(fixed(v, 1))
    return F.when(v.isNull(), F.lit(missing)).otherwise(F.concat(text, F.lit(unit)))


def distance(c: str | Column, missing: str = DASH) -> Column:
    """Metres, or kilometres with one decimal from 1000 m on."""
    v = col(c)
    return F.when(v.isNull(), F.lit(missing)).when(v >= 1000, F.concat(fixed(v / 1000, 1), F.lit(" km"))).otherwise(F.concat(fixed(v, 0), F.lit(" m")))


def compact_number(c: str | Column) -> Column:
    v = col(c)
    return F.when(v >= 1000, F.concat(fixed(v / 1000, 1), F.lit("k"))).otherwise(fixed(v, 0))


def or_unknown(c: str | Column, missing: str = "unknown") -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(missing))


def rooms_label(rooms: str, kitchen_living: str) -> Column:
    """Private rooms by analysis: "2 private", with "+ kitchen-living"; null rooms are unclear."""
    tail = F.when(F.coalesce(col(kitchen_living), F.lit(False)), F.lit(" + kitchen-living")).otherwise(F.lit(""))
    return F.coalesce(F.concat(col(rooms).cast("string"), F.lit(" private"), tail), F.lit("unclear"))


def short_rooms(rooms: str, kitchen_living: str) -> Column:
    tail = F.when(F.coalesce(col(kitchen_living), F.lit(False)), F.lit("+K")).otherwise(F.lit(""))
    return F.coalesce(F.concat(col(rooms).cast("string"), tail), F.lit(DASH))


def title(c: dict[str, str]) -> Column:
    """District, street, rooms by analysis and as declared, area and price, with what is said where one lacks."""
    rooms = F.concat(F.lit("AI: "), rooms_label(c["private_rooms"], c["kitchen_living"]), F.lit(" / SS: "), or_unknown(c["declared_rooms"]))
    return F.concat_ws(
        " - ", F.coalesce(filled(c["district"]), F.lit("Unknown district")), F.coalesce(filled(c["street"]), F.lit("Unknown street")),
        rooms, area(c["area"], "area unknown"), money(c["price"], "price unknown"),
    )


def first_text(*candidates: str) -> Column:
    """The first text that is not blank, trimmed; empty if there is none."""
    return F.coalesce(*(filled(F.trim(c)) for c in candidates), F.lit(""))


def profile_slug(c: str | Column) -> Column:
    """custom_<name>: lower case, other than letters and digits made one underscore, trimmed of them."""
    body = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "(?U)[^\\p{Alnum}]+", "_"), "^_+|_+$", "")
    return F.when(body == "", F.lit("custom_profile")).otherwise(F.concat(F.lit("custom_"), body))


def date_part(c: str | Column) -> Column:
    """The date of an ISO time as text."""
    return F.substring_index(col(c), "T", 1)


def exact_round(c: str | Column, digits: int = 0) -> Column:
    """Rounded halves to even, on the number's shortest decimal form; SQL's round() has halves up."""
    return F.bround(col(c).cast("decimal(38,18)"), digits).cast("double")


def translated(c: str | Column, language: str | Column, table: dict[str, dict[str, str]], names: dict[str, str] | None = None, default: str = "en") -> Column:
    """Text of an id in a language, else in the default one, else as it is; names: ids by an older name (the default's own text).

    table: {language: {id: text}}, a bounded resource that becomes a literal map.
    """
    flat = F.create_map(*(F.lit(x) for lang, texts in table.items() for k, v in texts.items() for x in (f"{lang}/{k}", v)))
    alias = F.create_map(*(F.lit(x) for kv in (names or {"": ""}).items() for x in kv))
    key = F.coalesce(F.try_element_at(alias, col(c)), col(c))
    said = lambda lang: F.try_element_at(flat, F.concat(lang, F.lit("/"), key))
    return F.coalesce(said(col(language) if isinstance(language, Column) else F.lit(language)), said(F.lit(default)), col(c))


def lines(*items: Column) -> Column:
    return compact(*items)
