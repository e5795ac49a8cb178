import pytest
from pyspark.sql import functions as F

from veilmark.functions import values as G
from veilmark.functions import validators as V
from veilmark.operators import detect as D
from veilmark.operators import evaluate as E
from veilmark.operators import mapping as M
from veilmark.operators import redact as X

CASES = [
    ("EMAIL_ADDRESS", "Contact Alice at ALICE@EXAMPLE.COM.", ["ALICE@EXAMPLE.COM"]),
    ("EMAIL_ADDRESS", "user@@example.com and user@", []),
    ("PHONE_NUMBER", "Call +91 9876543210 immediately.", ["+91 9876543210"]),
    ("PHONE_NUMBER", "Refer to page 123 or section 456.", []),
    ("IP_ADDRESS", "Server IP is 192.0.2.10 and version 1.2.3.4 is software.", ["192.0.2.10"]),
    ("IP_ADDRESS", "IPv6 host: 2001:db8::1.", ["2001:db8::1"]),
    ("IP_ADDRESS", "999.999.999.999", []),
    ("CREDIT_CARD", "Card details: 4111 1111 1111 1111 and order 1234 5678 9012 3456.", ["4111 1111 1111 1111"]),
    ("SSN", "US Citizen SSN is 123-45-6789.", ["123-45-6789"]),
    ("DATE_OF_BIRTH", "Date of Birth: 15/08/1990 for John Doe.", ["15/08/1990"]),
    ("DATE_OF_BIRTH", "Document filed on 15/08/1990 by company.", []),
    ("ADDRESS", "Mailing address: 123 MG Road, Sector 4, Bangalore 560001, India.", None),
    ("ORGANIZATION", "Contract signed with Apex Solutions Inc and Acme Corp Pvt Ltd.", None),
    ("PERSON", "Interview conducted by Rashi Patil and Rohan Dey.", ["Rashi Patil", "Rohan Dey"]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(1, k, text) for k, (_, text, _) in enumerate(CASES)] + [(1, 90, None), (1, 91, "  "), (1, 92, "é😀 a@b.co x")], "doc_id long, paragraph_index int, text string")
    return rows, D.detect(rows).cache()


def test_cases(found):
    got = [(r.paragraph_index, r.entity_type, r.text) for r in found[1].collect()]
    for k, (entity, _, want) in enumerate(CASES):
        texts = [t for i, e, t in got if i == k and e == entity]
        assert (sorted(texts) == sorted(want)) if want is not None else texts, (entity, CASES[k][1], texts)


def test_spans_hold_their_text_and_do_not_overlap(found):
    rows, det = found
    both = det.join(rows.withColumnRenamed("text", "whole"), ["doc_id", "paragraph_index"])
    for r in both.collect():
        assert r.whole[r.start : r.end] == r.text
    spans = sorted((r.paragraph_index, r.start, r.end) for r in det.collect())
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))


def test_validators(spark):
    rows = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("000-12-3456",), ("987-65-4321",), (None,)], "v string")
    got = [tuple(r) for r in rows.select(V.luhn(F.col("v")), V.ssn(F.col("v"))).collect()]
    assert got == [(True, False), (False, False), (False, False), (False, True), (False, False)]


def test_mapping_is_unique_and_text_is_rewritten(spark):
    rows = spark.createDataFrame([(1, i, f"Reach Synthetic {i} Labs or 10.0.{i % 250}.{i // 250 + 1} and rohan{i}@corp.com") for i in range(900)], "doc_id long, paragraph_index int, text string")
    det = D.detect(rows)
    mapping = M.entity_map(det).cache()
    orgs = mapping.where("entity_type <> 'IP_ADDRESS'")
    assert orgs.count() == orgs.select("entity_type", "replacement").distinct().count()
    out = X.redact(rows, det, mapping)
    assert X.residual(out, mapping).count() == 0
    assert out.agg(F.sum("applied")).first()[0] == det.count()


def test_generated_cards_pass_the_checksum(spark):
    h = spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    assert h.where(~V.luhn(G.card(F.col("h"))) | ~V.ssn(G.ssn(F.col("h"))) | ~V.ipv4(G.ip(F.col("h")))).count() == 0


def test_linked_email(spark):
    rows = spark.createDataFrame([(1, 0, "Signed by Rohan Dey today. rohan.dey@gmail.com and support@example.test")], "doc_id long, paragraph_index int, text string")
    mapping = {r.normalized: r.replacement for r in M.entity_map(D.detect(rows)).collect()}
    assert mapping["rohan.dey@gmail.com"] == mapping["rohan dey"].lower().replace(" ", ".") + "@example.com"


def test_metrics_known_answer(spark):
    schema = "doc_id long, entity_type string, paragraph_index int, start int, end int, {} long"
    truth = spark.createDataFrame([(1, "PERSON", 0, 0, 10, 1), (1, "EMAIL_ADDRESS", 0, 15, 30, 2)], schema.format("gt_id"))
    pred = spark.createDataFrame([(1, "PERSON", 0, 0, 10, 1), (1, "PERSON", 0, 40, 50, 2)], schema.format("pred_id"))
    got = {r.entity_type: r for r in E.category_metrics(truth, pred).collect()}
    assert len(got) == 9 and (got["PERSON"].tp, got["PERSON"].fp, got["EMAIL_ADDRESS"].fn, got["PERSON"].f1) == (1, 1, 1, 0.6667)
    assert E.micro_macro(E.category_metrics(truth, pred)).first().tp == 1


def test_mapping_has_no_repeats_and_is_safe(spark):
    values = {"IP_ADDRESS": lambda i: f"10.0.{i % 250}.{i // 250 + 1}", "SSN": lambda i: f"123-45-{1000 + i}", "DATE_OF_BIRTH": lambda i: f"{i % 28 + 1:02}/{i // 28 % 12 + 1:02}/{1950 + i // 336}", "PHONE_NUMBER": lambda i: f"+1 415 555 {1000 + i}", "ORGANIZATION": lambda i: f"Kingfisher Labs {i} Inc", "PERSON": lambda i: f"Parker Quarry{i}", "EMAIL_ADDRESS": lambda i: f"mail{i}@corp.com", "NEW_KIND": lambda i: f"value {i}"}
    rows = [(1, entity, value(i), i, k, 0) for k, (entity, value) in enumerate(values.items()) for i in range(900)]
    det = spark.createDataFrame(rows, "doc_id long, entity_type string, text string, paragraph_index int, start int, ord int")
    mapping = M.entity_map(det).cache()
    assert mapping.count() == len(rows) == mapping.select("entity_type", "replacement").distinct().count()
    assert mapping.where(~M.safe(F.col("entity_type"), F.col("replacement"), F.col("original"))).count() == 0
