"""Files of every format in and out, the second look, publishing, reports, model candidates, configuration, command line."""

import io
import json
import os
import stat
import zipfile

import pytest
from pyspark.sql import functions as F
from test_office import DOCX, HWPX, PPTX, XLSX, package

from veilframe import cli, config, scoring
from veilframe.operators import audit, candidates, gate, pipeline
from veilframe.sinks import office as sink
from veilframe.sinks import publish, text
from veilframe.sources import formats, office, xmltext

MD = "# 계획\r\n담당자: 최하나\n| 성명 | 연락처 |\n|---|---|\n| 최하나 | 010-1234-5678 |\n최 하 나 씨의 메일 hana@x.co.kr\n"


def test_markup():
    x = "<w:p a='1>2'><w:r><w:t>홍길</w:t></w:r><w:r><w:t>동 &amp; 김</w:t><w:tab/><w:t>010</w:t></w:r><!-- <w:t>no</w:t> --></w:p><w:p><w:t><![CDATA[a<b]]></w:t></w:p>"
    p = xmltext.paragraphs(x)
    assert [q.text for q in p] == ["홍길동 & 김\t010", "a<b"]
    made, refused = xmltext.edits(p[0], [(0, 3, "[<A>]"), (6, 9, "no"), (8, 11, "[n]")])
    assert refused == [(6, 9)] and xmltext.patched(x, made).startswith("<w:p a='1>2'><w:r><w:t>[&lt;A&gt;]</w:t></w:r><w:r><w:t> &amp; 김</w:t><w:tab/><w:t>[n]</w:t>")
    assert xmltext.edits(p[0], [(6, 9, "yes", True)])[1] == []
    assert [(n, v) for n, v, _, _ in xmltext.attribute_values(x)] == [("a", "1>2")] and "a<b" in xmltext.chunks(x)


def test_office_is_written_back():
    edit = lambda member, t: [(t.index("홍길동"), t.index("홍길동") + 3, "[연구자A]")] if "홍길동" in t else [(0, len(t), "[휴대전화1]")] if t == "01012345678" else []
    for name, body in (("a.xlsx", XLSX), ("b.docx", DOCX)):
        done = sink.rewrite(body, edit, [("홍길동", "[연구자A]")])
        texts = [r[5] for r in office.read(name, done.content)]
        assert "[연구자A]" in texts and not any("홍" in (t or "") for t in texts) and done.blocks == []
    assert "[휴대전화1]" in [r[5] for r in office.read("a.xlsx", sink.rewrite(XLSX, edit).content)]
    dirty = package(word__document_X="<w:document><w:p><w:r><w:t>가</w:t></w:r><w:ins w:author='홍길동'><w:r><w:t>나</w:t></w:r></w:ins><wp:docPr descr='홍길동 사진'/></w:p></w:document>", word__comments_X="<w:comments/>", docProps__core_X="<cp:coreProperties><dc:creator>홍길동</dc:creator></cp:coreProperties>")
    done = sink.rewrite(dirty, edit, [("홍길동", "[연구자A]")])
    with zipfile.ZipFile(io.BytesIO(done.content)) as z:
        assert "word/comments.xml" not in z.namelist() and "<dc:creator></dc:creator>" in z.read("docProps/core.xml").decode() and "descr='[연구자A] 사진'" in z.read("word/document.xml").decode()
    assert done.blocks == ["tracked changes"] and sink.identifier("[연구자 A]") == "연구자A" and sink.identifier("[]") == "가명"
    for name, body in (("c.pptx", PPTX), ("d.hwpx", HWPX)):
        assert [r[5] for r in office.read(name, sink.rewrite(body, lambda m, t: []).content)] == [r[5] for r in office.read(name, body)]


def test_hidden_and_embedded_text():
    inner = DOCX
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:p><w:r><w:t>겉</w:t></w:r><wp:docPr xmlns:wp='q' id='1' descr='숨은 이름'/></w:p></w:document>")
        z.writestr("word/embeddings/in.docx", inner)
        z.writestr("docProps/core.xml", "<c><creator>Jane Doe</creator></c>")
    rows = {r[1]: (r[4], r[5]) for r in office.read("x.docx", outer.getvalue())}
    assert ("hidden", "숨은 이름") in rows.values() and ("hidden", "Jane Doe") in rows.values() and any(k.startswith("word/embeddings/in.docx>") and v[1] == "홍길동" for k, v in rows.items())
    with zipfile.ZipFile(outer, "a") as z:
        z.writestr("word/embeddings/bad.xlsx", b"no zip")
    assert office.read("x.docx", outer.getvalue())[0][-1] == "BadZipFile"
    assert [office.orientation(g) for g in ([["성명", "1"], ["소속", "2"]], [["성명", "소속"], ["a", "b"]], [["a"]], [["가나", "12"], ["다라", "34"], ["마바", "56"]])] == ["row", "col", "", "row"]


def test_text_files_and_second_look(spark):
    files = spark.createDataFrame([("a.md", MD.encode()), ("b.csv", "﻿성명,비고\r\n최하나,\"메모, hana@x.co.kr\"\r\n".encode()), ("c.pdf", b"%PDF"), ("d.txt", b"")], "path string, content binary")
    parts = formats.segments(files).cache()
    assert {r.doc_id: r.error for r in parts.filter("error is not null").collect()} == {"c.pdf": "Unsupported: library absent"}
    run = pipeline.run(parts.filter("error is null and seg_id is not null"))
    out = {r.doc_id: (bytes(r.content).decode(), r.blocks) for r in formats.written(files, parts, run.plans, run.mapping).collect()}
    a, b = "[연구자A]", "[이메일1]"
    assert out["a.md"][0] == f"# 계획\r\n담당자: {a}\n| 성명 | 연락처 |\n|---|---|\n| {a} | [휴대전화1] |\n{a} 씨의 메일 {b}\n"
    assert out["b.csv"][0] == f'﻿성명,비고\r\n{a},"메모, {b}"\r\n' and out["c.pdf"][1] and out["d.txt"][0] == ""
    originals = spark.createDataFrame([("a.md", "최하나"), ("x", "010-1234-5678")], "doc_id string, original string")
    rows = [("a.md", "a.md", out["a.md"][0].encode()), ("x", "x.zip", package(deep_X="<t>010 1234 5678</t>")), ("y", "y.zip", b"PK\x03\x04broken")]
    got = {r.doc_id: (r.passed, r.leaks > 0, r.error is not None) for r in gate.looked(spark.createDataFrame(rows, "doc_id string, path string, content binary"), originals).collect()}
    assert got == {"a.md": (True, False, False), "x": (False, True, False), "y": (False, False, True)}
    nested = b"text"
    for _ in range(5):
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as z:
            z.writestr("m", nested)
        nested = box.getvalue()
    assert gate.look("n.zip", nested, [])["error"] == "Unopened"


def test_reassembled_lines(spark):
    docs = spark.createDataFrame([("d", "가나다\n라마바"), ("e", None)], "doc_id string, text string")
    edits = spark.createDataFrame([("d", 0, 1, 2, "[X]"), ("d", 0, 0, 2, "[Y]"), ("d", 1, 2, 3, ""), ("d", 7, 0, 1, "no")], "doc_id string, line int, start_pos int, end_pos int, replacement string")
    assert {r.doc_id: r.rewritten for r in text.reassembled(docs, edits).collect()} == {"d": "[Y]다\n라마", "e": None}


def test_publish_and_reports(spark, tmp_path):
    from test_mentions import segments

    run = pipeline.run(segments(spark, [("a", "담당자: 최하나"), ("a", "최하나 010-1234-5678"), ("b", "값 없음")]))
    where = publish.publish(run, str(tmp_path / "out"), str(tmp_path / "private"), "r1")
    assert {r.rewritten for r in spark.read.parquet(where["published"]).collect()} == {"담당자: [연구자A]", "[연구자A] [휴대전화1]", "값 없음"}
    assert {r.original for r in publish.load_mapping(spark, where["mapping"]).collect()} == {"최하나", "010-1234-5678"}
    with pytest.raises(Exception):
        publish.publish(run, str(tmp_path / "out"), str(tmp_path / "private"), "r1")
    report = publish.summary(run.findings, run.verdicts)
    page, levels = publish.html(run.findings, "t"), audit.guard(run.rewritten, run.findings)
    for public in (publish.as_json(report), publish.as_text(report), page, publish.guard_text(levels, run.findings)):
        assert "최하나" not in public and "1234-5678" not in public
    assert report["gate"] == {"documents": 2, "passed": 2, "rescans": 0, "leaks": 0, "blocks": 0} and "attention" in publish.guard_text(levels, run.findings)
    assert "<mark" in publish.html(run.findings, "t", True, run.rewritten) and publish.highlighted("<ab>", [(1, 2, "x"), (1, 3, "y")]) == '&lt;<mark title="x">a</mark>b&gt;'
    copy = {r.doc_id: r.markdown for r in text.markdown(run.rewritten, run.mapping).collect()}
    assert copy["a"] == "담당자: [연구자A]\n[연구자A] [휴대전화1]"
    publish.private_file(str(tmp_path / "p" / "f"), "x")
    assert stat.S_IMODE(os.stat(tmp_path / "p" / "f").st_mode) == 0o600


def test_model_candidates(spark):
    from test_mentions import segments

    assert candidates.loopback("http://127.0.0.1:1/x") and candidates.minus(0, 10, [(2, 4), (8, 12)]) == [(0, 2), (4, 8)]
    for bad in ("https://127.0.0.1", "http://example.com", "http://u:p@localhost", "ftp://localhost"):
        with pytest.raises(candidates.Refused):
            candidates.loopback(bad)
    for bad in ("", "no", "{}", '[{"type":"x","text":"a"}]', '[{"type":"person"}]'):
        with pytest.raises(candidates.Unusable):
            candidates.parsed(bad)
    items = candidates.parsed(json.dumps([{"type": "person", "text": t} for t in ("하늘이", "없는 말", "a1", "[연구자A]", "x")]))
    assert candidates.believed(items, "하늘이 왔다 a1 [연구자A]") == [{"type": "person", "text": "하늘이"}]
    s = segments(spark, [("a", "하늘이 왔다 010-1234-5678"), ("a", "바람연구회 모임"), ("b", "고장")])
    found = pipeline.run(s, quick=True).findings

    def provider(chunk: str) -> str:
        assert "010" not in chunk
        return "no" if "고장" in chunk else json.dumps({"items": [{"type": "person", "text": "하늘이"}, {"type": "org", "text": "바람연구회"}, {"type": "quasi", "text": "모임"}]})

    new, failed = candidates.candidates(s, found, provider)
    assert {(r.value, r.grade, tuple(r.detectors)) for r in new.collect()} == {("하늘이", "추정", ("L4",)), ("바람연구회", "검토", ("L4",))}
    assert [(r.doc_id, r.level) for r in failed.collect()] == [("b", "block")]


def test_configuration(tmp_path):
    (tmp_path / "settings.yaml").write_text("categories: {title: true, org: false}\nstrict_only: true\n")
    (tmp_path / "allowlist.txt").write_text("# kept\n하나  둘\n")
    (tmp_path / "denylist.txt").write_text("짧\n긴 말,org\n", encoding="utf-8")
    (tmp_path / "confidential_rules.yaml").write_text("- {name: r, category: budget, pattern: '\\d+원', literals: [금액], grade: 추정}\n")
    c = config.load(str(tmp_path))
    assert "title" in c.categories and "org" not in c.categories and c.strict_only and c.allow == ("하나 둘",) and c.deny == (("긴 말", "org"), ("짧", "confidential")) and c.rules[0].grade == "추정"
    assert config.load(str(tmp_path / "none")) == config.Config()
    for name, body in (("settings.yaml", "other: 1"), ("settings.yaml", "categories: {nope: true}"), ("denylist.txt", "a,nope"), ("confidential_rules.yaml", "- {pattern: x}"), ("confidential_rules.yaml", "- {name: r, pattern: '('}"), ("settings.yaml", "a: [")):
        bad = tmp_path / "bad"
        bad.mkdir(exist_ok=True)
        for f in bad.iterdir():
            f.unlink()
        (bad / name).write_text(body)
        with pytest.raises(config.ConfigError):
            config.load(str(bad))


def test_selftest_and_scores(spark):
    rows = {r["class"]: r for r in scoring.selftest(spark).collect()}
    assert len(rows) == 16 and all(r.removed == 1 for r in rows.values()), {k for k, r in rows.items() if not r.removed}
    gold = spark.createDataFrame([("d", "P", "홍길동"), ("d", "P", "김구"), ("d", "O", "한국")], "doc_id string, class string, value string")
    outs = spark.createDataFrame([("d", "[A]와 김구")], "doc_id string, text string")
    found = spark.createDataFrame([("d", "홍길동이"), ("d", "무관")], "doc_id string, value string")
    assert {(r["class"], r.n, r.removed) for r in scoring.scored(gold, outs, found).collect()} == {("P", 2, 1), ("O", 1, 1), ("false", 1, None)}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(MD)
    (tmp_path / "in" / ".hidden.md").write_text("010-9999-8888")
    private, out = ["--private", str(tmp_path / "p")], str(tmp_path / "out")
    source = str(tmp_path / "in")
    assert cli.main(["guard", *private, source]) == 1 and cli.main(["scan", "--json", *private, source]) == 1
    assert cli.main(["apply", "--out", out, *private, source]) == 0
    shown = capsys.readouterr().out
    assert "최하나" not in shown and os.listdir(out) == ["a.md"] and "[연구자A]" in (tmp_path / "out" / "a.md").read_text()
    assert cli.main(["verify", *private, out]) == 0 and cli.main(["verify", *private, source]) == 1
    assert cli.main(["restore", *private, str(tmp_path / "out" / "a.md")]) == 0
    assert "최하나" in (tmp_path / "p" / "restored" / "a.md").read_text()
    assert cli.main(["guard"]) == 2 and cli.main(["guard", *private, str(tmp_path / "absent")]) == 3 and (tmp_path / "p" / "error.log").exists()
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF")
    assert cli.main(["apply", "--out", str(tmp_path / "out2"), *private, source]) == 1 and not os.path.exists(tmp_path / "out2")
