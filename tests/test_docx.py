import io
import zipfile

from veilmark.sources import docx, ground_truth
from veilmark.streaming.files import detect_stream

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
BODY = f'<w:document {NS}><w:body><w:p><w:r><w:t xml:space="preserve">Mail alice@</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>example.test now</w:t></w:r></w:p><w:p><w:hyperlink r:id="rId1"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="hyperlink" Target="mailto:alice@example.test" TargetMode="External"/></Relationships>'
HEADER = f'<w:hdr {NS}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>'


def make():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", BODY)
        z.writestr("word/_rels/document.xml.rels", RELS)
        z.writestr("word/header1.xml", HEADER)
    return out.getvalue()


def test_scan_and_rewrite(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(make())
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    rows = docx.scan(spark, str(tmp_path))
    got = sorted((r.paragraph_index, r.region, r.text, len(r.runs)) for r in rows.where("status = 'ok'").collect())
    assert got == [(0, "body", "Mail alice@example.test now", 2), (1, "body", "link", 1), (2, "table", "Cell", 1), (3, "header", "Head", 1)]
    assert rows.where("status <> 'ok'").count() == 1
    assert docx.hyperlinks(rows).first().target == "mailto:alice@example.test"
    content, applied = docx.rewrite(make(), {0: [(5, 23, "x@example.com")]}, {"mailto:alice@example.test": "mailto:x@example.com"})
    again, state = docx.read_document(content)
    assert (applied, state, again[0]["text"], again[1]["relationships"][0]["target"]) == (1, "ok", "Mail x@example.com now", "mailto:x@example.com")


def test_ground_truth(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"document": "d", "annotations": [{"entity_type": "SSN", "start": 1, "end": 3}, {"entity_type": "NOPE", "start": 1, "end": 2}]}')
    assert [tuple(r) for r in ground_truth.read(spark, str(tmp_path / "g.json")).collect()] == [("d", "gt_1", "SSN", 0, 1, 3)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id": 1, "paragraph_index": 0, "text": "SSN 123-45-6789"}\n')
    detect_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().entity_type == "SSN"
