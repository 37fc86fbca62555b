"""Personal data (DataFrame operations only): patterns propose spans, checksums confirm them, nearby words adjust the score.

Patterns are written with possessive repeats and look-behinds, so that they match exactly what the plain forms beside
them match but take time in proportion to the text. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, without

#: Characters that mark a match; none of the patterns matches them, and a text's own are swapped for \x03 first.
OPEN, CLOSE = "\x01", "\x02"
_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind: (pattern, score before checks, context words); in the order in which spans are listed.
KINDS: dict[str, tuple[str, float, str]] = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|kontakt|correo|courriel|write to"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.5, "ip|address|host|server|login|adresse|direcci"),
    # [0-9]([\x20-]?[0-9])+, whole runs of 13 to 19 digits only: others fail the check, and a run is never tried again
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", 0.3, "card|visa|credit|karte|carte|tarjeta|payment|pay"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax|anruf|llama|appel"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.3, "iban|account|bank|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social security|taxpayer"),
    "secret": (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,256}+(?![A-Za-z0-9_-])", 0.3, "token|secret|api|key|password|passwd|credential|bearer"),
}
BASE = ("email", "ip", "card", "phone")
#: What a passed checksum and a context word add, and the score from which a kind outside BASE counts.
CHECKED, NEARBY, LEAST = 0.5, 0.2, 0.5
BEFORE, AFTER = 40, 20
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
OUTPUTS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "found")


#: Texts are cut into pieces of so many code points, so that what stands at a place is read without counting from the start.
CHUNK = 1024


def running(values: Column, op) -> Column:
    """All prefixes of an array column folded by op (associative), by doubling: n log n steps, nothing appended one by one."""
    strides = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(values))
    return F.aggregate(strides, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, op(x, F.get(acc, i - d))).otherwise(x)))


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The text [start, end) of which parts are the chunks; what lies outside is empty."""
    start = F.greatest(start, F.lit(0))
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    part = lambda i, at, n: F.coalesce(F.substring(F.get(parts, i), at + 1, n), F.lit(""))
    across = F.concat(part(first, start % CHUNK, F.lit(CHUNK)), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), part(last, F.lit(0), end - last * CHUNK))
    return F.when(end <= start, "").when(first == last, part(first, start % CHUNK, end - start)).otherwise(across)


def marked(text: Column, pattern: str) -> Column:
    """The text cut before every leftmost match that does not overlap an earlier one; CLOSE ends the matches."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN)


def ends(pieces: Column) -> Column:
    """Where each of marked()'s pieces ends in the text."""
    return running(F.transform(pieces, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0)), lambda a, b: a + b)


def matches(pieces: Column, ended: Column) -> Column:
    """Array of (start, end, s) from marked() pieces and their ends()."""
    found = F.transform(pieces, lambda p, i: F.struct(F.get(ended, i - 1).alias("start"), F.substring_index(p, CLOSE, 1).alias("s")))
    return F.transform(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["s"])).alias("end"), m["s"].alias("s")))


def luhn(digits: Column) -> Column:
    """True if a string of digits passes Luhn's check."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN without spaces has remainder 1."""
    turned = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97) == 1


def _confirmed(kind: str, s: Column) -> tuple[Column, Column]:
    """(the match counts, its checksum passed)."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "ip":
        return s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"), F.lit(False)
    if kind == "card":
        ok = F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
        return ok, ok
    if kind == "phone":
        return F.length(digits).between(9, 15), F.lit(False)
    if kind == "iban":
        ok = F.when(F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34), mod97(F.replace(s, F.lit(" "), F.lit("")))).otherwise(False)
        return ok, ok
    if kind == "secret":
        return s.rlike("[0-9]") & s.rlike("[A-Za-z]"), F.lit(False)
    return F.lit(True), F.lit(False)


def _scored(kind: str, kept: Column, parts: Column) -> Column:
    """The confirmed matches with their scores, those outside BASE only from LEAST on."""
    _, score, context = KINDS[kind]

    def scored(m: Column) -> Column:
        near = ascii_lower(F.concat(cut(parts, m["start"] - BEFORE, m["start"]), F.lit(" "), cut(parts, m["end"], m["end"] + AFTER)))
        value = F.lit(score) + F.when(_confirmed(kind, m["s"])[1], CHECKED).otherwise(0.0) + F.when(near.rlike(rf"(?:^|[^a-z])(?:{context})"), NEARBY).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.least(value, F.lit(1.0)).alias("score"))

    spans = F.transform(kept, scored)
    return (spans if kind in BASE else F.filter(spans, lambda x: x["score"] >= LEAST)).cast(SPAN)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with OUTPUTS; input columns of these names are replaced.

    found: every span with its score, by kind as in KINDS, then start; spans: the same as text; n_spans: their number. The
    other n_* and base_sha256 cover the kinds of BASE. A null text is empty: no spans, and the digest of the empty string. Repeated rows each get theirs;
    an empty table gives no rows. A text with very many matches takes time in proportion to them and the logarithm of their number.
    """
    base = without(docs, *OUTPUTS)
    safe, parts, *each = fresh(base, "safe", "parts", *KINDS)
    own = [F.col(f"`{c}`") for c in base.columns]
    by = dict(zip(KINDS, each, strict=True))
    df = base.select(*own, F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), OPEN + CLOSE, "\x03\x03").alias(safe))
    signs = {"email": "@", "phone": "+", "ssn": "-"}
    worth = {k: F.contains(F.col(safe), F.lit(signs[k])) if k in signs else F.col(safe).rlike(r"[0-9]") for k in KINDS}
    df = df.select(*own, safe, *[F.when(worth[k], marked(F.col(safe), KINDS[k][0])).alias(by[k]) for k in KINDS])
    # A column for each step: within a lambda an expression would be worked out again for every element.
    df = df.select(*own, safe, *[F.struct(F.col(by[k]).alias("p"), F.when(F.size(by[k]) > 1, ends(F.col(by[k]))).alias("e")).alias(by[k]) for k in KINDS])
    df = df.select(*own, safe, *[F.when(F.col(by[k])["e"].isNotNull(), F.filter(matches(F.col(by[k])["p"], F.col(by[k])["e"]), lambda m: _confirmed(k, m["s"])[0])).alias(by[k]) for k in KINDS])  # noqa: B023
    some = reduce(lambda a, b: a | b, [F.coalesce(F.size(by[k]) > 0, F.lit(False)) for k in KINDS])
    df = df.select(*own, F.when(some, chunks(F.col(safe))).alias(parts), *[F.col(by[k]) for k in KINDS])
    df = df.select(*own, *[F.coalesce(_scored(k, F.col(by[k]), F.col(parts)), F.array().cast(SPAN)).alias(by[k]) for k in KINDS])
    listed = lambda kinds: F.array_join(F.transform(F.flatten(F.array(*[F.col(by[k]) for k in kinds])), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return df.select(
        *own,
        *[F.size(by[k]).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
        F.size(F.flatten(F.array(*[F.col(by[k]) for k in KINDS]))).cast("long").alias("n_spans"),
        F.flatten(F.array(*[F.col(by[k]) for k in KINDS])).alias("found"),
    )


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets, and chars_col (if there is one) the new length.

    Where spans overlap, what the earlier one leaves of the later goes without a mark of its own. Texts without spans,
    null ones among them, stay as they are. Repeated rows each stay; an empty table stays empty.
    """
    held, cuts, parts, reached = fresh(docs, "held", "cuts", "parts", "reached")
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(held), F.col(f"`{text_col}`").alias("text"))
    df = find(packed).select(held, "text", F.sort_array(F.transform("found", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind")))).alias(cuts))
    df = df.select(held, "text", cuts, F.when(F.size(cuts) > 0, chunks(F.col("text"))).alias(parts), F.transform(cuts, lambda x: -x["back"]).alias(reached))
    df = df.withColumn(reached, running(F.col(reached), F.greatest))

    def kept(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(reached, i - 1), F.lit(0))
        return F.when(x["start"] >= before, F.concat(cut(F.col(parts), before, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

    tail = cut(F.col(parts), F.get(reached, F.size(cuts) - 1), F.length("text"))
    df = df.withColumn("text", F.when(F.size(cuts) > 0, F.concat(F.array_join(F.transform(cuts, kept), ""), tail)).otherwise(F.col("text")))
    out = []
    for c in columns:
        value = F.col(held).getField(c)
        if c == text_col:
            value = F.col("text")
        elif c == chars_col:
            value = F.when(F.size(cuts) > 0, F.length("text").cast(dict(docs.dtypes)[c])).otherwise(value)
        out.append(value.alias(c))
    return df.select(*out)
