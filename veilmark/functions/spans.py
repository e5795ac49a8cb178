"""Span extraction with code-point offsets, without user functions.

Matches and the text between them come from two regular-expression passes; offsets are running sums of their
lengths. Every pattern gets the flag that makes classes and case folding follow Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<entity_type:string,start:int,end:int,text:string,recognizer:string,confidence:double,ord:int>>"


def unicode_pattern(pattern: str) -> str:
    return "(?U)" + pattern


_PLACES = "cast(array() as array<struct<start:int,end:int,text:string>>)"
#: Matches whose offsets are summed at once: a text of k matches takes about k * BLOCK steps, not k * k.
BLOCK = 64


def matches(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """array<struct<start, end, text>> of the non-overlapping matches; empty for null text.

    Offsets are summed in blocks, then the blocks' own offsets. hint is a cheaper condition that every text with a match meets.
    """
    text = F.coalesce(text, F.lit(""))
    rx = unicode_pattern(pattern)
    def walk(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), F.expr(_PLACES).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["n"]).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["m"].alias("text"))).alias("out"),
            ),
        )

    def join(blocks: Column) -> Column:
        whole = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_PLACES[16:-1]}>)").alias("out")),
            lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], F.transform(b["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["text"].alias("text")))).alias("out")),
        )
        return F.flatten(whole["out"])

    def places(found: Column, gaps: Column) -> Column:
        lengths = F.slice(F.zip_with(found, gaps, lambda m, g: F.struct(F.length(m).alias("n"), F.length(g).alias("gap"), m.alias("m"))), F.lit(1), F.size(found))
        first = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(F.array(lengths), lambda every: F.transform(first, lambda i: walk(F.slice(every, i, F.lit(BLOCK)))))
        return F.when(F.size(found) <= BLOCK, walk(lengths)["out"]).otherwise(join(F.flatten(blocks)))

    # Both regular-expression passes are bound as the only element of an array, so that no use repeats them.
    passes = F.array(F.struct(F.regexp_extract_all(text, F.lit(rx), F.lit(0)).alias("m"), F.split(text, rx, -1).alias("g")))
    hit = text.rlike(rx) if hint is None else hint & text.rlike(rx)
    return F.when(hit, F.get(F.transform(passes, lambda p: places(p["m"], p["g"])), F.lit(0))).otherwise(F.expr(_PLACES))


def right_trimmed(spans: Column, chars: str) -> Column:
    """Spans without trailing characters of a set; their ends move."""

    def cut(s: Column) -> Column:
        text = F.regexp_replace(s["text"], f"[{chars}]+$", "")
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(text)).alias("end"), text.alias("text"))

    return F.transform(spans, cut)


def labelled(spans: Column, entity: str, recognizer: str, confidence: float, layer: int) -> Column:
    return F.transform(spans, lambda s, i: F.struct(F.lit(entity).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(recognizer).alias("recognizer"), F.lit(float(confidence)).alias("confidence"), (F.lit(layer * 100000) + i).alias("ord")))


def boundary_trimmed(spans: Column) -> Column:
    """Spans without punctuation and brackets at their ends; empty ones go."""

    def cut(s: Column) -> Column:
        right = F.regexp_replace(s["text"], "[:,;.\"'()\\[\\]{}]+$", "")
        text = F.regexp_replace(right, "^[\"'()\\[\\]{} ]+", "")
        start = s["start"] + F.length(right) - F.length(text)
        return s.withField("start", start).withField("end", start + F.length(text)).withField("text", text)

    return F.filter(F.transform(spans, cut), lambda s: (s["end"] > s["start"]) & s["text"].rlike("(?U)\\S"))
