"""Entity mapping: one consistent replacement for each distinct value of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import validators as V
from ..functions import values as G
from ..scratch import held


def keyed(detections: DataFrame) -> DataFrame:
    return detections.withColumn("normalized", G.normalized(F.col("text"), F.col("entity_type")))


def distinct_keys(detections: DataFrame) -> DataFrame:
    """Distinct keys of each document: at, their first occurrence, its text as original, and how often they occur."""
    at = F.struct("paragraph_index", "start", "ord")
    return keyed(detections).groupBy("doc_id", "entity_type", "normalized").agg(F.min(at).alias("at"), F.min_by("text", at).alias("original"), F.count("*").alias("occurrences"))


def first_seen(detections: DataFrame) -> DataFrame:
    """Distinct keys of each document with person, the one an email names, and creation_index, the rank of their first occurrence.

    A person named by an email that stands before it is created with that email, just before it.
    """
    keys = held(distinct_keys(detections), "keys")
    links = link_persons(keys)
    keys = keys.join(links.withColumn("entity_type", F.lit("EMAIL_ADDRESS")), ["doc_id", "entity_type", "normalized"], "left")
    named = keys.where("person is not null").groupBy("doc_id", F.col("person").alias("normalized")).agg(F.min("at").alias("mail_at")).withColumn("entity_type", F.lit("PERSON"))
    keys = keys.join(named, ["doc_id", "entity_type", "normalized"], "left").withColumn("created", F.least("at", F.coalesce("mail_at", "at")))
    order = Window.partitionBy("doc_id").orderBy("created", F.when(F.col("entity_type") == "PERSON", 0).otherwise(1), "entity_type", "normalized")
    return keys.withColumn("creation_index", F.row_number().over(order) - 1).drop("mail_at", "created")


def _words(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), "(?U)\\W+"), lambda t: F.length(t) > 2)


def link_persons(keys: DataFrame) -> DataFrame:
    """(doc_id, normalized, person) for emails whose local part names a person of the document.

    A token equals one of the person's, or is longer than three and inside one; the first person seen wins. keys has at, the first occurrence.
    """
    local = F.split(F.col("normalized"), "@")[0]
    mails = keys.where("entity_type = 'EMAIL_ADDRESS'").where(~local.isin(P.GENERIC_LOCAL_PARTS)).select("doc_id", "normalized", _words(local).alias("mail_words"))
    people = keys.where("entity_type = 'PERSON'").select(F.col("doc_id").alias("d"), F.col("normalized").alias("person"), "at", _words(F.col("normalized")).alias("person_words"))
    alike = F.exists("mail_words", lambda m: F.exists("person_words", lambda p: (m == p) | ((F.length(m) > 3) & F.contains(p, m))))
    both = mails.join(people, (F.col("doc_id") == F.col("d")) & alike)
    return both.groupBy("doc_id", "normalized").agg(F.min_by("person", F.struct("at", "person")).alias("person"))


def entity_map(detections: DataFrame) -> DataFrame:
    """Keys with seed hash, collision rank and a safe replacement unique within document and category."""
    keys = first_seen(detections).withColumn("seed_hash", G.seed_hash(F.col("normalized"), F.col("entity_type")))
    plain = G.replacement(F.col("entity_type"), F.col("normalized"), F.col("seed_hash"))
    linked = G.linked_email(G.person(G.seed_hash(F.col("person"), F.lit("PERSON"))))
    keys = keys.withColumn("candidate", F.when(F.col("person").isNotNull(), linked).otherwise(plain))
    rank = Window.partitionBy("doc_id", "entity_type", "candidate").orderBy("creation_index")
    keys = keys.withColumn("collision_rank", F.row_number().over(rank))
    keys = keys.withColumn("replacement", spread(F.col("entity_type"), F.col("normalized"), F.col("candidate"), F.col("collision_rank"), F.col("seed_hash")))
    return distinct_and_safe(keys)


#: How often a replacement that repeats or is unsafe is drawn anew in its format.
REDRAWS = 3


def distinct_and_safe(keys: DataFrame, redraws: int = REDRAWS) -> DataFrame:
    """Keys whose replacements repeat or are unsafe get new ones.

    A repeated or unsafe value is drawn anew in its format up to redraws times, earlier draws keeping theirs. What is
    unsafe then takes the fallback of its category, and so does what still repeats where a format has to be kept; other
    repeats take a suffix with their creation_index, which no drawn value and no other key of the document ends with.
    """
    entity, value = F.col("entity_type"), F.col("replacement")
    rank = F.row_number().over(Window.partitionBy("doc_id", "entity_type", "replacement").orderBy("draws", "creation_index"))
    is_safe = safe(entity, value, F.col("original"))
    keys = keys.withColumn("draws", F.when(F.col("collision_rank") > 1, 1).otherwise(0))
    for k in range(redraws):
        keys = keys.withColumn("again", (rank > 1) | ~is_safe)
        drawn = G.replacement(entity, F.col("normalized"), F.sha2(F.concat(F.col("seed_hash"), F.lit(f"_v{k + 1}")), 256))
        keys = keys.withColumn("replacement", F.when(F.col("again"), drawn).otherwise(value)).withColumn("draws", F.when(F.col("again"), k + 2).otherwise(F.col("draws")))
    keys = keys.withColumn("replacement", F.when(is_safe, value).otherwise(fallback(entity, F.col("creation_index"))))
    keys = keys.withColumn("again", rank > 1)
    index = F.col("creation_index").cast("string")
    suffixed = F.when(entity == "EMAIL_ADDRESS", F.concat_ws("@", F.concat(F.split(value, "@")[0], F.lit("."), index), F.split(value, "@")[1])).when(entity.isin(FORMATTED), fallback(entity, F.col("creation_index"))).otherwise(F.concat(value, F.lit(" "), index))
    return keys.withColumn("replacement", F.when(F.col("again"), suffixed).otherwise(value)).drop("again", "draws")


#: Categories whose values must keep their format.
FORMATTED = ["PHONE_NUMBER", "SSN", "CREDIT_CARD", "IP_ADDRESS"]


def fallback(entity: Column, index: Column) -> Column:
    """A synthetic value without any token of an original."""
    i = index.cast("string")
    named = F.when(entity == "PERSON", F.concat(F.lit("Synthetic Person "), i)).when(entity == "ORGANIZATION", F.concat(F.lit("Nexgen Solutions "), i, F.lit(" Corp"))).when(entity == "ADDRESS", F.concat(F.lit("Plot "), i, F.lit(", Synthetic Avenue, Test City")))
    named = named.when(entity == "EMAIL_ADDRESS", F.concat(F.lit("contact."), i, F.lit("@example.com"))).when(entity == "PHONE_NUMBER", F.concat(F.lit("+1-212-555-"), F.format_string("%04d", index)))
    return named.otherwise(F.concat(F.lit("SYNTHETIC_"), entity, F.lit("_"), i))


def spread(entity: Column, key: Column, candidate: Column, rank: Column, hashed: Column) -> Column:
    """The candidate for rank 1; later ranks draw anew from a seed that holds the rank, in the same format."""
    again = G.replacement(entity, key, F.sha2(F.concat_ws("#", hashed, rank.cast("string")), 256))
    named = F.when(entity == "PERSON", F.concat(candidate, F.lit(" "), rank.cast("string"))).when(entity == "EMAIL_ADDRESS", F.concat(F.split(candidate, "@")[0], rank.cast("string"), F.lit("@"), F.split(candidate, "@")[1])).when(entity == "ORGANIZATION", F.concat(F.lit("Unit "), rank.cast("string"), F.lit(" "), candidate))
    return F.when(rank == 1, candidate).otherwise(F.coalesce(named, again))


def safe(entity: Column, value: Column, original: Column) -> Column:
    """Whether a replacement is non-empty, differs from its original, shares no distinctive token with it, and has its category's format.

    A placeholder of the category counts as its format; a fallback phone counts by its prefix.
    """
    generic = [*P.GENERIC_WORDS, "enterprise"]
    shared = F.exists(_words(original), lambda t: ~t.isin(generic) & F.array_contains(_words(value), t))
    good = F.when(entity.isin("PERSON", "ORGANIZATION"), ~shared).when(entity == "CREDIT_CARD", V.luhn(value)).when(entity == "IP_ADDRESS", V.ipv4(value) | V.ipv6(value)).when(entity == "SSN", V.ssn(value))
    good = good.when(entity == "PHONE_NUMBER", V.phone(value) | value.startswith("+1-212-555-")).when(entity == "EMAIL_ADDRESS", F.substring_index(value, "@", -1).isin(P.SAFE_DOMAINS)).otherwise(F.lit(True))
    return (F.length(F.trim(value)) > 0) & (F.lower(F.trim(value)) != F.lower(F.trim(original))) & (good | F.startswith(value, F.concat(F.lit("SYNTHETIC_"), entity)))
