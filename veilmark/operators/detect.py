"""Detection: candidates of every layer, trimming, precedence and greedy overlap resolution, one row a paragraph.

Everything is array expressions on the paragraph's row, so detection needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions import validators as V

EMPTY = f"cast(array() as {S.SPAN})"


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike("(?U)\\S"), F.lit(False))


def heading(text: Column) -> Column:
    """Whether a text equals or starts with a heading term."""
    return F.coalesce(text.rlike(f"(?U)^\\s*(?i:{P.HEADINGS})"), F.lit(False))


def emails(text: Column) -> Column:
    return S.labelled(S.right_trimmed(S.matches(text, P.EMAIL, F.contains(text, F.lit("@"))), ".:,;"), "EMAIL_ADDRESS", "regex_email", 1.0, 1)


def _digit(text: Column) -> Column:
    return text.rlike("(?U)\\d")


def phone_candidates(text: Column) -> Column:
    """Phone-shaped spans with 7 to 15 digits."""
    return F.filter(S.matches(text, P.PHONE, _digit(text)), lambda s: F.length(V.digits(s["text"])).between(7, 15))


def phones(text: Column) -> Column:
    return S.labelled(F.filter(S.matches(text, P.PHONE, _digit(text)), lambda s: V.phone(s["text"])), "PHONE_NUMBER", "regex_phone", 0.95, 2)


def version_context(text: Column, start: Column) -> Column:
    """Whether the ten characters before a position speak of a version number."""
    before = F.lower(F.substring(text, F.greatest(start - 9, F.lit(1)), F.least(F.lit(10), start)))
    return F.contains(before, F.lit("version")) | before.endswith("v") | before.endswith("v.")


def ipv4s(text: Column) -> Column:
    return F.filter(S.right_trimmed(S.matches(text, P.IPV4, F.contains(text, F.lit(".")) & _digit(text)), ".:,;"), lambda s: V.ipv4(s["text"]) & ~version_context(text, s["start"]))


def ipv6s(text: Column) -> Column:
    return F.filter(S.matches(text, P.IPV6, F.contains(text, F.lit(":"))), lambda s: V.ipv6(s["text"]) & ~version_context(text, s["start"]))


def ips(text: Column) -> Column:
    return S.labelled(F.concat(ipv4s(text), ipv6s(text)), "IP_ADDRESS", "regex_ip", 1.0, 3)


def cards(text: Column) -> Column:
    return S.labelled(F.filter(S.matches(text, P.CARD, _digit(text)), lambda s: V.luhn(s["text"])), "CREDIT_CARD", "luhn_credit_card", 1.0, 4)


def ssns(text: Column) -> Column:
    return S.labelled(F.filter(S.matches(text, P.SSN, _digit(text)), lambda s: V.ssn(s["text"])), "SSN", "regex_ssn", 1.0, 5)


def birth_dates(text: Column, reach: int = 60) -> Column:
    """Dates near the first keyword of a paragraph that has one."""
    keyword = F.get(S.matches(text, P.DOB_KEYWORD), F.lit(0))["start"]
    near = F.filter(S.matches(text, P.DATE), lambda s: F.abs(s["start"] - keyword) <= reach)
    return F.when(text.rlike(S.unicode_pattern(P.DOB_KEYWORD)), S.labelled(near, "DATE_OF_BIRTH", "context_dob", 0.9, 6)).otherwise(F.expr(EMPTY))


def addresses(text: Column) -> Column:
    enough = F.filter(S.matches(text, P.ADDRESS), lambda s: F.size(F.filter(F.split(s["text"], "\\s+"), lambda w: w != "")) >= 2)
    return F.when(text.rlike(S.unicode_pattern(P.ADDRESS_KEYWORD)), S.labelled(enough, "ADDRESS", "context_address", 0.85, 7)).otherwise(F.expr(EMPTY))


def organizations(text: Column) -> Column:
    found = F.filter(S.matches(text, P.ORGANIZATION, text.rlike(P.ORGANIZATION_HINT)), lambda s: ~heading(s["text"]))
    return F.when(~heading(text), S.labelled(found, "ORGANIZATION", "corp_suffix", 0.92, 8)).otherwise(F.expr(EMPTY))


def persons(text: Column) -> Column:
    """Capitalised pairs after a cue word: a plain stand-in where no entity model is plugged in."""

    def name(s: Column) -> Column:
        bare = F.regexp_extract(s["text"], P.NAME, 0)
        return F.struct((s["end"] - F.length(bare)).alias("start"), s["end"].alias("end"), bare.alias("text"))

    found = F.filter(F.transform(S.matches(text, P.CUE_PERSON), name), lambda s: ~s["text"].isin(P.PERSON_STOP) & ~heading(s["text"]))
    return F.when(~heading(text), S.labelled(found, "PERSON", "cue_person", 0.7, 9)).otherwise(F.expr(EMPTY))


#: Recogniser registry: name to a function from the text column to an array of spans.
LAYERS = {"email": emails, "phone": phones, "ip": ips, "card": cards, "ssn": ssns, "dob": birth_dates, "address": addresses, "organization": organizations, "person": persons}


ENTITIES = "array<struct<label:string,start:int,end:int,text:string>>"


def model_entities(found: Column, text: Column) -> Column:
    """Spans of an entity model's found (label, start, end, text), by the rules for its labels; headings have none.

    PERSON: not a stop word nor a heading. ORG: not in the stop list. GPE and LOC: two words or a digit, as addresses. All: longer than one character.
    """
    value = lambda e: F.trim(e["text"])
    words = lambda e: F.size(F.filter(F.split(e["text"], "(?U)\\s+"), lambda w: w != ""))
    long = F.filter(F.coalesce(found, F.expr(f"cast(array() as {ENTITIES})")), lambda e: F.length(value(e)) > 1)
    people = F.filter(long, lambda e: (e["label"] == "PERSON") & ~value(e).isin(P.PERSON_STOP) & ~heading(e["text"]))
    orgs = F.filter(long, lambda e: (e["label"] == "ORG") & ~F.lower(value(e)).isin(P.ORG_STOP))
    places = F.filter(long, lambda e: e["label"].isin("GPE", "LOC") & ((words(e) >= 2) | e["text"].rlike("(?U)\\d")))
    spans = F.concat(S.labelled(people, "PERSON", "model_person", 0.88, 10), S.labelled(orgs, "ORGANIZATION", "model_org", 0.85, 11), S.labelled(places, "ADDRESS", "model_loc", 0.75, 12))
    return F.when(~heading(text), spans).otherwise(F.expr(EMPTY))


def gazetteer(names: dict[str, list[str]]) -> Callable[[Column], Column]:
    """An entity model made of word lists by label; a function from the text to its entities, without user functions."""

    def labelled(label: str, words: list[str], text: Column) -> Column:
        pattern = r"\b(?:" + "|".join(re.escape(n) for n in sorted(words, key=lambda w: (-len(w), w))) + r")\b"
        return F.transform(S.matches(text, pattern), lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))

    def found(text: Column) -> Column:
        parts = [labelled(label, words, text) for label, words in names.items() if words]
        return F.concat(*parts) if parts else F.expr(f"cast(array() as {ENTITIES})")

    return found


def entity_model(load: Callable[[], Callable[[str], list[tuple[str, int, int]]] | None]) -> Callable[[Column], Column]:
    """A plugged-in model: load() runs once in each Python worker and gives a function from a text to (label, start, end) triples.

    A model that can't be loaded (None or an ImportError or OSError) finds nothing, so organisations keep their suffix rule only.
    """

    @F.pandas_udf(ENTITIES)
    def entities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except (ImportError, OSError):
            model = None
        for texts in batches:
            yield pd.Series([[{"label": label, "start": a, "end": b, "text": t[a:b]} for label, a, b in model(t)] if model and t else [] for t in texts])

    return entities


def candidates(text: Column, layers: list[str] | None = None, entities: Column | None = None) -> Column:
    found = [LAYERS[k](text) for k in (layers or LAYERS)] + ([] if entities is None else [model_entities(entities, text)])
    return F.when(not_blank(text), S.boundary_trimmed(F.concat(*found))).otherwise(F.expr(EMPTY))


def in_order(spans: Column) -> Column:
    """Precedence: category rank, confidence, length, start, then the order found."""
    rank = F.create_map(*[x for k, v in P.PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    keyed = F.transform(spans, lambda s: F.struct(rank[s["entity_type"]].alias("a"), (-s["confidence"]).alias("b"), (s["start"] - s["end"]).alias("c"), s["start"].alias("d"), s["ord"].alias("e"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def _greedy(spans: Column) -> Column:
    """Spans accepted in order unless they overlap one accepted before, by start."""
    kept = F.aggregate(in_order(spans), F.expr(EMPTY), lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), acc).otherwise(F.array_append(acc, x)))
    return by_start(kept)


def by_start(spans: Column) -> Column:
    return F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("k"), s.alias("s")))), lambda k: k["s"])


def resolved(spans: Column) -> Column:
    """Spans accepted in order unless they overlap one accepted before, by start.

    Spans that touch nothing between them decide apart, so the sorted spans are cut into clusters and each is resolved by itself.
    """
    none = F.expr(EMPTY)
    settle = lambda open_: F.when(F.size(open_) <= 1, open_).otherwise(_greedy(open_))

    def step(acc: Column, x: Column) -> Column:
        inside = x["start"] < acc["end"]
        return F.struct(
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], settle(acc["open"]))).alias("out"),
            F.when(inside, F.array_append(acc["open"], x)).otherwise(F.array(x)).alias("open"),
            F.when(inside, F.greatest(acc["end"], x["end"])).otherwise(x["end"]).alias("end"),
        )

    start = F.struct(none.alias("out"), none.alias("open"), F.lit(-1).alias("end"))
    walked = F.aggregate(by_start(spans), start, step, lambda acc: F.concat(acc["out"], settle(acc["open"])))
    return F.when(F.size(spans) <= 1, spans).otherwise(walked)


def run_indices(runs: Column, start: Column, end: Column) -> Column:
    """Indices of the runs that a span overlaps."""
    return F.transform(F.filter(runs, lambda r: F.greatest(r["start_offset"], start) < F.least(r["end_offset"], end)), lambda r: r["run_index"])


def annotate(paragraphs: DataFrame, layers: list[str] | None = None, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """paragraphs with spans, the detections of each text: null and blank texts have none."""
    text = F.col("text")
    return paragraphs.withColumn("found", candidates(text, layers, None if model is None else model(text))).withColumn("spans", resolved(F.col("found"))).drop("found")


def exploded(annotated: DataFrame) -> DataFrame:
    """One row a detection of annotated paragraphs: doc_id, paragraph_index and the span's fields."""
    return annotated.where(F.size("spans") > 0).select("doc_id", "paragraph_index", F.inline("spans"))


def detect(paragraphs: DataFrame, layers: list[str] | None = None, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row a detection: doc_id, paragraph_index and the span's fields. Null and blank texts give none."""
    text = F.col("text")
    rows = paragraphs.select("doc_id", "paragraph_index", candidates(text, layers, None if model is None else model(text)).alias("found")).where(F.size("found") > 0)
    return rows.select("doc_id", "paragraph_index", F.inline(resolved(F.col("found"))))
