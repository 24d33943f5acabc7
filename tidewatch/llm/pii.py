"""Operator 1: personal data by patterns, checksums and context words (column expressions only).

A pattern proposes spans, leftmost first and without overlap within its kind; a validator confirms
them (octet range, Luhn, digit count, mod-97, number blocks that are never issued); words within
``NEAR`` characters move the score.  The base kinds (email, ip, card, phone) stay whatever their
score; the added kinds (iban, ssn) are kept from ``THRESHOLD`` up.

Positions come from the text cut at the matches: a match starts where the pieces and matches before
it end, so one pass over a row's pieces gives every offset in code points.  The patterns are written
with possessive quantifiers and look-behind guards that leave the matches as they are but keep
matching linear and free of deep recursion on very long runs.

Defined results: a null text counts as empty and has no spans; matches that fail their validator
are dropped and not retried; rows are independent, so repeated rows, null ids, further columns and
empty tables need no special case.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

NEAR = 40
THRESHOLD = 0.5
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
IP_VALID = rf"^{_OCTET}(\.{_OCTET})(\.{_OCTET})(\.{_OCTET})$"
SSN_NEVER = "^(000|666|9[0-9][0-9])-|-00-|-0000$"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # as run here
    plain: str  # the same matches without guards, for other engines
    may_have: Callable[[Column], Column]  # cheap test of the whole text
    valid: Callable[[Column], Column]
    score: float
    context: str  # words that raise the score
    joined: str = ""  # a neighbouring character of this class lowers the score
    base: bool = True


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _mod97(v: Column) -> Column:
    s = F.translate(v, " ", "")
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def step(a, c):
        value = F.ascii(c)
        return F.when(value <= 57, a * 10 + value - 48).otherwise(a * 100 + value - 55) % 97

    return F.length(s).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def _has(regex: str):
    return lambda t: F.rlike(t, F.lit(regex))


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: F.contains(t, F.lit("@")),
         lambda v: F.lit(True), 0.9, "mail|contact|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _has(r"[0-9]\.[0-9]"),
         lambda v: F.rlike(v, F.lit(IP_VALID)), 0.6, "address|host|server|ip"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9]([\x20-]?[0-9])+", _has("[0-9][ -]?[0-9]"),
         lambda v: F.length(_digits(v)).between(16, 19) & F.call_function("luhn_check", _digits(v)),
         0.7, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _has(r"\+[0-9]"),
         lambda v: F.length(_digits(v)).between(8, 15), 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
         r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?", _has("[A-Z]{2}[0-9]{2}"),
         _mod97, 0.5, "iban|account|bank|konto|compte|cuenta", "[A-Za-z0-9]", base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _has("[0-9]-[0-9]{2}-[0-9]"),
         lambda v: ~F.rlike(v, F.lit(SSN_NEVER)), 0.4, "ssn|social security", "[0-9-]", base=False),
)
RAISE, LOWER_BY = 0.2, 0.3


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
    score = F.lit(kind.score) + F.when(F.rlike(near, F.lit(kind.context)), RAISE).otherwise(0.0)
    if kind.joined:
        ends = F.concat(F.right(before, F.lit(1)), F.left(after, F.lit(1)))
        score = score - F.when(F.rlike(ends, F.lit(kind.joined)), LOWER_BY).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 3)


def _spans(kind: Kind, matches: Column, pieces: Column) -> Column:
    """array<struct<kind, start, end, score>> of one kind, by start."""
    proposed = F.transform(matches, lambda v, i: F.struct(
        v.alias("v"), F.get(pieces, i).alias("before"), F.get(pieces, i + 1).alias("after")))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")

    def step(s, m):
        start = s["at"] + F.length(m["before"])
        end = start + F.length(m["v"])
        score = _score(kind, m["before"], m["after"])
        keep = kind.valid(m["v"]) if kind.base else kind.valid(m["v"]) & (score >= THRESHOLD)
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"),
                        score.alias("score"))
        return F.struct(end.alias("at"),
                        F.when(keep, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    found = F.aggregate(proposed, zero, step, lambda s: s["out"])
    return F.when(F.size(matches) > 0, found).otherwise(empty)


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``docs`` with ``spans_col``: a struct with one span array a kind."""
    names = docs.columns
    t = docs.toDF(*[f"c{i}" for i in range(len(names))])
    t = t.withColumn("t", text_or_empty(f"c{names.index(text_col)}"))
    none = F.array().cast("array<string>")
    t = t.withColumns({f"m_{k.name}": F.when(k.may_have(F.col("t")), F.regexp_extract_all(
        "t", F.lit(k.pattern), F.lit(0))).otherwise(none) for k in KINDS})
    t = t.withColumns({f"p_{k.name}": F.when(F.size(f"m_{k.name}") > 0, F.split("t", k.pattern, -1))
                       .otherwise(none) for k in KINDS})
    spans = F.struct(*[_spans(k, F.col(f"m_{k.name}"), F.col(f"p_{k.name}")).alias(k.name) for k in KINDS])
    return t.select(*[f"c{i}" for i in range(len(names))], spans.alias("pii")).toDF(*names, spans_col)


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
