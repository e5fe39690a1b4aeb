"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

Per kind the pattern is applied leftmost and without overlap. Offsets come from
splitting the text at the matches: the lengths of what lies between and of the
matches themselves add up to code-point offsets, so no Python and no exploded rows are
needed and each text stays in its row. Patterns use possessive repetition and may
start only where a run of their characters starts or the last match ended, which
matches the same spans as the plain patterns in time linear in the text.

Kinds: email, ip, card and phone are the base, kept as the contract defines them. The
method adds ``iban`` (account numbers confirmed by mod 97) and ``ssn`` (nine grouped
digits, only where nearby words speak of it). Every span carries a score.

Null texts are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import packed, unpacked

_LOCAL = "[A-Za-z0-9._%+-]"
#: Characters before a span that are searched for context words.
CONTEXT = 48
#: Spans folded at a time; a fold copies what it has, so long ones are cut.
BLOCK = 128
#: Matches that fill a context, of four characters at least.
LEAD = CONTEXT // 4
SPAN = "array<struct<start:int,end:int,text:string,before:string>>"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; ``rank`` is its place among spans with one start."""

    name: str
    rank: int
    pattern: str
    hint: str
    context: str
    prior: float
    base: bool


KINDS = (
    Kind("email", 0, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|correo|courriel", 0.8, True),
    Kind("ip", 1, r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", "ip|host|server|address|addr", 0.5, True),
    Kind("card", 2, r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9]){13,}+", "", "card|visa|credit|karte|carte|tarjeta|payment", 0.3, True),
    Kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|tel|call|mobile|fax", 0.5, True),
    Kind("iban", 4, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", "iban|account|bank|konto|compte|cuenta", 0.3, False),
    Kind("ssn", 5, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "ssn|social security|taxpayer", 0.3, False),
)
#: Spans of added kinds need this score.
THRESHOLD = 0.5


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def proposals(text: Column, pattern: str) -> Column:
    """Spans (start, end, text, before) of the leftmost non-overlapping matches; code points, end exclusive.

    Running sums are folded in blocks, so that a span costs the same however many a text has;
    ``before``, the characters in front of a span, is carried along and never cut out of the text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def part(gap: Column, hit: Column) -> Column:
        return F.struct(F.char_length(gap).alias("gap"), F.right(gap, F.lit(CONTEXT)).alias("near"), hit.alias("hit"))

    parts = F.zip_with(F.split(text, pattern, -1), found, part)  # what follows the last match has no hit
    return _let(F.filter(parts, lambda x: x["hit"].isNotNull()), _placed)


def _add(acc: Column, x: Column) -> Column:
    begin = acc["at"] + x["gap"]
    end = begin + F.char_length(x["hit"])
    before = F.right(F.concat(acc["tail"], x["near"]), F.lit(CONTEXT))
    span = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("text"), before.alias("before"))
    return F.struct(end.alias("at"), F.right(F.concat(before, x["hit"]), F.lit(CONTEXT)).alias("tail"), F.concat(acc["out"], F.array(span)).alias("out"))


def _placed(parts: Column) -> Column:
    """The spans of (gap, near, hit) in order."""
    last = F.floor((F.size(parts) - 1) / BLOCK).cast("int")
    blocks = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(parts, b * BLOCK + 1, BLOCK)))
    length = lambda acc, x: acc + x["gap"] + F.char_length(x["hit"])

    def led(block: Column, b: Column) -> Column:
        lead = F.transform(F.slice(parts, b * BLOCK + 1 - LEAD, LEAD), lambda x: F.concat(x["near"], F.right(x["hit"], F.lit(CONTEXT))))
        tail = F.when(b > 0, F.right(F.array_join(lead, ""), F.lit(CONTEXT))).otherwise(F.lit(""))
        return F.struct(block.alias("block"), F.aggregate(block, F.lit(0), length).alias("long"), tail.alias("tail"))

    def start(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["long"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def spans(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(blocks, zero, start, lambda acc: acc["out"])

        def of(x: Column, at: Column) -> Column:
            return F.aggregate(x["block"], F.struct(at.alias("at"), x["tail"].alias("tail"), F.array().cast(SPAN).alias("out")), _add, lambda acc: acc["out"])

        return F.flatten(F.zip_with(blocks, starts, of))

    return _let(F.transform(blocks, led), spans)


def luhn(span: Column) -> Column:
    digits = F.regexp_replace(span, "[^0-9]", "")
    return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)


def mod97(span: Column) -> Column:
    """Account number check: first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(span, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def confirmed(kind: str, span: Column) -> Column:
    """Whether a proposed span is valid for its kind."""
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(span, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return luhn(span)
    if kind == "phone":
        return F.length(F.regexp_replace(span, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        return mod97(span)
    return F.lit(True)


SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double,base:boolean,text:string>>"


def _scored(kind: Kind):
    """A span with its score: prior, what its check adds, and a bonus for context words before it."""

    def of(x: Column) -> Column:
        bonus = F.when(F.lower(x["before"]).rlike(rf"\b(?:{kind.context})"), 0.2).otherwise(0.0)
        checked = 0.4 if kind.name in ("card", "iban") else 0.1
        return F.struct(
            x["start"].alias("start"),
            F.lit(kind.rank).alias("rank"),
            x["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            F.round(F.lit(kind.prior + checked) + bonus, 2).alias("score"),
            F.lit(kind.base).alias("base"),
            x["text"].alias("text"),
        )

    return of


def _confirming(kind: Kind):
    return lambda x: confirmed(kind.name, x["text"])


def found(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``spans``: array of (start, rank, end, kind, score, base, text) by start, then kind.

    Spans that fail their check are gone. One narrow pass over the texts.
    """
    out = packed(docs, _text=text).withColumn("_body", F.coalesce("_text", F.lit("")))
    body, kinds = F.col("_body"), []
    for kind in KINDS:
        likely = body.contains(kind.hint) if kind.hint else F.lit(True)
        spans = F.when(likely & body.rlike(kind.pattern), proposals(body, kind.pattern))
        kept = F.transform(F.filter(spans, _confirming(kind)), _scored(kind))
        if not kind.base:
            kept = F.filter(kept, lambda x: x["score"] >= THRESHOLD)
        kinds.append(F.coalesce(kept, F.array().cast(SPANS)))
    return unpacked(out, docs.columns, {"spans": F.sort_array(F.concat(*kinds))})


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
