"""Whole documents: nine made files from scan to redacted file, refusals, downloads and reports."""

import json

import pytest
from pyspark.sql import functions as F

from veilmark.operators import detect as D
from veilmark.operators import document as X
from veilmark.operators import service
from veilmark.sources import docx, ground_truth

PEOPLE = D.gazetteer({"PERSON": ["Alice Example"], "ORG": ["PII", "Globex"], "GPE": ["Delhi", "New Delhi"]})


def made() -> dict[str, bytes]:
    one = lambda *runs: docx.build([list(runs)])
    return {
        "single.docx": one("Contact Alice Example today for details."),
        "split.docx": one("Alice ", "Example"),
        "link.docx": docx.build([["Email us at ", {"text": "alice@example.test", "link": "rId7", "color": "0000FF"}]], links={"rId7": "mailto:alice@example.test?subject=x"}),
        "table.docx": docx.build([["Staff"]], tables=[[[["Employee Name"], ["Contact Phone"]], [["Alice Example"], ["+91 9000000000"]]]]),
        "sides.docx": docx.build([["Body content."]], headers=[["Header Confidential - Alice Example"]], footers=[["Footer Contact: alice@example.test"]]),
        "formats.docx": one({"text": "Alice ", "bold": True}, {"text": "Example ", "italic": True}, {"text": "is here.", "underline": True}, {"text": " Red.", "color": "FF0000"}),
        "several.docx": one("Contact Alice Example at alice@example.test or call +91 9000000000."),
        "twice.docx": one("Alice Example appeared here and Alice Example appeared there."),
        "field.docx": docx.build([["Write: ", {"instruction": ' HYPERLINK "mailto:ALICE@example.test" '}, {"text": "alice@example.test"}]]),
        "broken.docx": b"PK\x03\x04 nothing",
        "text.docx": b"plain",
    }


@pytest.fixture(scope="module")
def batch(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "in").mkdir()
    for name, content in made().items():
        (root / "in" / name).write_bytes(content)
    truth = {"document": "several.docx", "annotations": [{"entity_type": "PERSON", "start": 8, "end": 21, "paragraph_index": 0}, {"entity_type": "EMAIL_ADDRESS", "start": 25, "end": 43}, {"entity_type": "SSN", "start": 0, "end": 4}]}
    (root / "truth.json").write_text(json.dumps(truth))
    rows = X.redact_documents(spark, str(root / "in"), str(root / "out"), {"Several.docx": str(root / "truth.json")}, PEOPLE)
    return root, rows, {r.doc_id.rsplit("/", 1)[-1]: r for r in rows.collect()}


def test_every_file_has_a_response(batch):
    _, _, got = batch
    assert {n: r.http_status for n, r in got.items()} == {n: 400 if n in ("broken.docx", "text.docx") else 200 for n in made()}
    assert json.loads(got["text.docx"].error)["error"] == "Invalid document"
    for name, r in got.items():
        if r.http_status == 200:
            assert r.validation.document_valid and r.validation.original_pii_residual_check and r.validation.original_file_hash_unchanged, name
            assert r.validation.replacement_consistency and len(r.download_id) == 36


def test_originals_are_gone_and_runs_stay(batch):
    root, _, got = batch
    for name, content in made().items():
        if got[name].http_status != 200:
            continue
        new = (root / "out" / f"redacted_{name}").read_bytes()
        before, after = docx.read_document(content)[0], docx.read_document(new)[0]
        assert len(before) == len(after) and [len(r["runs"]) for r in before] == [len(r["runs"]) for r in after]
        assert docx.residuals(new, ["Alice Example", "alice@example.test", "+91 9000000000", "9000000000"]) == []
        assert [[{k: v for k, v in x.items() if k in ("bold", "italic", "underline", "color")} for x in r["runs"]] for r in before] == [[{k: v for k, v in x.items() if k in ("bold", "italic", "underline", "color")} for x in r["runs"]] for r in after]
    assert got["twice.docx"].total_detections == 2 and got["table.docx"].total_detections == 2
    assert got["link.docx"].replacements_applied == 2 and got["field.docx"].replacements_applied == 2
    target = docx.read_document((root / "out" / "redacted_link.docx").read_bytes())[0][0]["relationships"][0]["target"]
    assert target.startswith("mailto:") and target.endswith(("@example.com", "@example.org", "@example.test"))


def test_same_input_gives_the_same_files(spark, batch):
    root, _, _ = batch
    X.redact_documents(spark, str(root / "in"), str(root / "again"), None, PEOPLE)
    names = sorted(p.name for p in (root / "out").iterdir())
    assert names == sorted(p.name for p in (root / "again").iterdir()) and len(names) == len(made()) - 2
    for name in names:
        assert docx.read_document((root / "out" / name).read_bytes()) == docx.read_document((root / "again" / name).read_bytes())


def test_empty_content_is_refused(spark):
    files = spark.createDataFrame([("a.docx", 0, b""), ("a.txt", 5, b"PK\x03\x04x"), ("b.DOCX", 99, b"PK\x03\x04x"), ("c.docx", 5, b"PK\x03\x04x"), (None, 5, b"PK\x03\x04x")], "path string, length long, content binary")
    assert [r.status for r in docx.gate(files, 50).collect()] == [400, 400, 413, 200, 400]


def test_target_must_lie_apart(spark, batch):
    root, _, _ = batch
    for target in (root / "in", root / "in" / "below"):
        with pytest.raises(ValueError):
            X.redact_documents(spark, str(root / "in"), str(target))


def test_evaluation_and_responses(spark, batch):
    root, rows, got = batch
    scored = json.loads(got["several.docx"].evaluation)
    assert scored["available"] and (scored["tp"], scored["fp"], scored["fn"]) == (2, 1, 1)
    assert scored["fp_by_category"] == {"PHONE_NUMBER": 1} and scored["fn_by_category"] == {"SSN": 1}
    assert [c["entity_type"] for c in scored["per_category"]][:2] == ["PERSON", "EMAIL_ADDRESS"]
    assert not json.loads(got["single.docx"].evaluation)["available"]
    said = " ".join(r.response for r in X.response_json(rows).collect())
    assert "alice" not in said.lower().replace("alice@example.test", "alice") or "Alice" not in said
    X.write_responses(rows, str(root / "json"))
    assert spark.read.text(str(root / "json")).count() == len(made())


def test_downloads(spark, batch):
    _, rows, got = batch
    token = got["single.docx"].download_id
    asked = spark.createDataFrame([(token,), ("../../etc/passwd",), ("0" * 36,)], "download_id string")
    records = X.download_records(rows)
    now = records.agg(F.max("created_at").cast("string")).first()[0]
    assert {r.download_id: r.status for r in service.download(asked, records, now).collect()} == {token: 200, "../../etc/passwd": 404, "0" * 36: 404}
    late = records.agg(F.expr("cast(max(created_at) + interval 601 seconds as string)")).first()[0]
    assert {r.status for r in service.download(asked, records, late).collect()} == {404}


def test_structure_and_reports(spark, batch):
    root, rows, _ = batch
    counts = {r.doc_id.rsplit("/", 1)[-1]: r for r in docx.structure(docx.scan(spark, str(root / "in"))).collect()}
    f = counts["formats.docx"]
    assert (f.paragraphs, f.runs, f.bold, f.italic, f.underline, f.coloured) == (1, 4, 1, 1, 1, 1)
    assert (counts["sides.docx"].paragraphs, counts["sides.docx"].runs, counts["sides.docx"].headers, counts["sides.docx"].footers) == (3, 1, 1, 1)
    assert "Bold: 1" in service.structure_report(f, "formats.docx", 10)
    assert (counts["table.docx"].tables, counts["link.docx"].hyperlinks) == (1, 1)
    known = ground_truth.registry(spark, {"A.docx": "t"})
    files = spark.createDataFrame([("x/Redacted_a.DOCX",), ("b.docx",)], "doc_id string")
    assert [r.truth_path for r in ground_truth.lookup(files, known).orderBy("doc_id").collect()] == [None, "t"]


def test_header_parts_by_section_and_number(spark):
    content = docx.build([["x"]], headers=[["one"]], footers=[["two"]])
    places = [(r["region"], r["section_index"], r["kind"], r["text"]) for r in docx.read_document(content)[0]]
    assert places == [("body", None, None, "x"), ("header", 0, "primary", "one"), ("footer", 0, "primary", "two")]


def test_model_labels(spark):
    rows = spark.createDataFrame([(1, 0, "Globex met PII staff in Delhi and New Delhi"), (1, 1, "Order: Globex")], "doc_id long, paragraph_index int, text string")
    assert sorted((r.entity_type, r.text) for r in D.detect(rows, ["email"], PEOPLE).collect()) == [("ADDRESS", "New Delhi"), ("ORGANIZATION", "Globex")]


def test_plugged_in_model(spark):
    rows = spark.createDataFrame([(1, 0, "Zed Zulu is here")], "doc_id long, paragraph_index int, text string")
    found = D.detect(rows, ["email"], D.entity_model(lambda: lambda t: [("PERSON", 0, 8)])).collect()
    assert [(r.entity_type, r.text, r.recognizer) for r in found] == [("PERSON", "Zed Zulu", "model_person")]

    def missing():
        raise ImportError

    assert D.detect(rows, ["email"], D.entity_model(missing)).count() == 0


def test_many_spans_in_one_paragraph(spark):
    text = " ".join(f"mail{i}@corp{i}.com" for i in range(4000))
    got = D.detect(spark.createDataFrame([(1, 0, text)], "doc_id long, paragraph_index int, text string")).collect()
    assert len(got) == 4000 and all(text[r.start : r.end] == r.text for r in got)


def test_display_forms(spark):
    row = spark.range(1).select(service.display_category(F.lit("CREDIT_CARD")), service.display_percent(F.lit(0.9431)), service.display_bytes(F.lit(1536)), service.display_bytes(F.lit(0)), service.display_bytes(F.lit(5 * 1024**3))).first()
    assert tuple(row) == ("Credit Card", "94.3%", "1.5 KB", "0 Bytes", "5 GB")
