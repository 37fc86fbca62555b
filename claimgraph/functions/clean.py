"""Claim cleaning as column functions; clean_claim applies them in their fixed order (all JVM-side, one projection)."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases dropped from claims, in order.
TURNOVERS = ("по меньшей мере", "по крайней мере", "однако", "однако же", "например", "по существу", "наоборот", "в частности", "в свою очередь")
#: Entities that are decoded.
ENTITIES = {
    "&nbsp;": " ", "&shy;": "", "&lt;": "<", "&gt;": ">", "&laquo;": "«", "&raquo;": "»", "&lsaquo;": "‹", "&rsaquo;": "›", "&quot;": '"', "&prime;": "′", "&Prime;": "″",
    "&lsquo;": "‘", "&rsquo;": "’", "&sbquo;": "‚", "&ldquo;": "“", "&rdquo;": "”", "&bdquo;": "„", "&#10076;": "❜", "&#10075;": "❛", "&amp;": "&", "&apos;": "'", "&sect;": "§",
    "&copy;": "©", "&not;": "¬", "&reg;": "®", "&macr;": "¯", "&deg;": "°", "&plusmn;": "±", "&sup1;": "¹", "&sup2;": "²", "&sup3;": "³", "&frac14;": "¼", "&frac12;": "½", "&frac34;": "¾",
    "&acute;": "´", "&micro;": "µ", "&para;": "¶", "&middot;": "·", "&iquest;": "¿", "&fnof;": "ƒ", "&trade;": "™", "&bull;": "•", "&hellip;": "…", "&oline;": "‾", "&ndash;": "–", "&mdash;": "—",
    "&permil;": "‰", "&#125;": "}", "&#123;": "{", "&#61;": "=", "&ne;": "≠", "&cong;": "≅", "&asymp;": "≈", "&le;": "≤", "&ge;": "≥", "&ang;": "∠", "&perp;": "⊥", "&radic;": "√", "&sum;": "∑",
    "&int;": "∫", "&#8251;": "※", "&divide;": "÷", "&infin;": "∞", "&#64;": "@", "&#91;": "[", "&#93;": "]",
}
#: Further ones, by their standard names and numbers.
ENTITIES |= {f"&{n};": chr(name2codepoint[n]) for n in "times alpha beta gamma delta epsilon lambda mu pi rho sigma tau phi psi omega minus".split()}
ENTITIES |= {f"&#{n};": chr(n) for n in (176, 215, 8211, 8212)} | {"&#160;": " "}
ENTITY = r"&#?[a-z0-9]+;"
SPLIT_PHRASES = (r", отличающ[а-я]+ тем, что", r", характеризующ[а-я]+ тем, что")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clear_turnovers(c: Column, phrases: tuple[str, ...] = TURNOVERS) -> Column:
    """Drop ", phrase," and then " phrase " (which leaves a space), phrase by phrase."""
    for phrase in phrases:
        c = F.replace(F.replace(c, F.lit(f", {phrase},"), F.lit("")), F.lit(f" {phrase} "), F.lit(" "))
    return c


def clear_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"\([^)]*\)(, \([^)]*\))*", "")


def clear_reference_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"\([0-9]+\)", "")


def clear_first_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^[0-9]+\.?\s?", "")


def clear_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<.*?>", " ")


def merge_commas(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(\s,)+", ","), r",\s?\.", ".")


def clear_quotes(c: Column) -> Column:
    return F.regexp_replace(c, r"([а-я])' ", "$1 ")


def correct_slashes(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([0-9]+) (/)", "$1$2"), r"([а-я]+)/([а-я]+)", "$1 / $2")


def correct_dashes(c: Column) -> Column:
    return F.regexp_replace(c, r"([0-9]+) (-[0-9]+)", "$1$2")


def replace_entities(c: Column, table: dict[str, str] | None = None) -> Column:
    """Decode the entities found, one after the other; unknown ones stay (see unknown_entities)."""
    table = ENTITIES if table is None else table
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.aggregate(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)), c, lambda text, e: F.replace(text, e, F.coalesce(F.try_element_at(known, e), e)))


def unknown_entities(c: Column) -> Column:
    known = F.array(*[F.lit(e) for e in ENTITIES])
    return F.array_except(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)), known)


def merge_conjunctions(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(", и,"), F.lit(", и")), F.lit("а именно,"), F.lit("а именно"))


def single_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"\s{2,}", " ")


def space_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*([,.;:!?()])\s*", " $1 ")


def clean_claim(c: Column) -> Column:
    """Every cleaning step, in order."""
    for step in (strip, clear_turnovers, clear_brackets, clear_first_number, clear_tags, merge_commas, clear_quotes, correct_slashes, correct_dashes, replace_entities, merge_conjunctions, single_spaces):
        c = step(c)
    return c


def split_parts(c: Column, phrases: tuple[str, ...] = SPLIT_PHRASES) -> Column:
    """Array of one or two parts, cut once at the first phrase that occurs."""
    out = F.array(c)
    for phrase in reversed(phrases):
        out = F.when(c.rlike(phrase), F.split(c, phrase, 2)).otherwise(out)
    return out


def all_or_null(*parts: Column, sep: str = "_") -> Column:
    """The parts joined, null if any is null (concat_ws alone would pass over nulls)."""
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, F.concat_ws(sep, *parts))


def node_label(c: Column, most: int = 20) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def around_verb(c: Column, verb: Column) -> Column:
    """(left, right) of a verb's first occurrence, trimmed and lower-case; what a later occurrence cuts off is not in either."""
    parts = F.split_part
    return F.struct(F.lower(F.trim(parts(c, verb, F.lit(1)))).alias("left"), F.lower(F.trim(parts(c, verb, F.lit(2)))).alias("right"))
