"""Pseudonyms, rewriting, auditing, structure and sources on small rows."""

import unicodedata

from pyspark.sql import functions as F

from veilframe.functions import checks
from veilframe.config import Config
from veilframe.operators import audit, mapping, meet, pipeline, rewrite, structure
from veilframe.sources import text


def alpha(n):
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def test_tags_and_masks(spark):
    got = [r.t for r in spark.range(20_000).select("id", checks.alpha_tag(F.col("id")).alias("t")).orderBy("id").collect()]
    assert got == [alpha(i) for i in range(20_000)]
    rows = [("홍길동", "person", "홍*동"), ("김구", "person", "김*"), ("900101-1234567", "rrn", "90****-*******"), ("010-1234-5678", "phone", "*******5678"), ("1234", "tel", "****"), ("공일공", "phone", "***"),
            ("hong@daum.net", "email", "h***@d***.net"), ("4111111111111111", "card", "************1111"), ("110-123-456789", "account", "*********789"), ("서울시 종로구 1", "address", "서울시 ******"), ("행복아파트", "address", "행****"), (" ", "x", "")]
    df = spark.createDataFrame(rows, "v string, c string, want string")
    assert [r.m for r in df.select(checks.masked(F.col("v"), F.col("c")).alias("m")).collect()] == [r[2] for r in rows]


def test_keys(spark):
    rows = [("010-1234-5678", "01012345678"), ("1979년 3월 15일생", "1979년 3월 15일생"), (" A  B\xa0c​", "a b c"), ("각", "각"), ("12", "12"), (None, None)]
    assert [r.k for r in spark.createDataFrame(rows, "v string, want string").select(checks.mapping_key(F.col("v")).alias("k")).collect()] == [r[1] for r in rows]


def test_issue_and_continue(spark):
    rows = [("person", f"이름{i % 40}", i) for i in range(200)] + [("tel", "02-111-2222", 0), ("tel", "02 111 2222", 3), (None, "x", 0), ("tel", " ", 0), ("tel", None, 0)]
    df = spark.createDataFrame(rows, "category string, value string, ord int")
    out = {(r.category, r.map_key): r for r in mapping.issue(df, ["ord"]).collect()}
    assert len(out) == 41 and out["tel", "021112222"].pseudonym == "[유선전화1]" and out["tel", "021112222"].n_used == 2
    assert [out["person", f"이름{i}"].idx for i in range(40)] == list(range(40)) and out["person", "이름27"].pseudonym == "[연구자AB]"
    old = spark.createDataFrame([("person", "이름3", 7), ("person", "없음", 99)], "category string, map_key string, idx long")
    more = {r.map_key: r.idx for r in mapping.issue(df, ["ord"], old).collect() if r.category == "person"}
    assert "이름3" not in more and min(more.values()) == 100 and len(set(more.values())) == 39


def test_apply_and_restore(spark):
    texts = spark.createDataFrame([(1, "ab345x7z"), (2, "손대지 않음"), (3, None), (4, "😀홍길동님")], "id long, text string")
    plans = spark.createDataFrame([(1, 5, 7, "[B1]"), (1, 0, 2, "[연구자A]"), (1, 1, 3, "[no]"), (1, 7, 99, "[out]"), (4, 1, 4, "[연구자B]")], "id long, start_pos int, end_pos int, replacement string")
    out = rewrite.apply_plans(texts, plans, ["id"])
    got = {r.id: r.rewritten for r in out.collect()}
    assert got == {1: "[연구자A]345[B1]z", 2: "손대지 않음", 3: None, 4: "😀[연구자B]님"}
    m = spark.createDataFrame([("[연구자A]", "ab"), ("[B1]", "x7"), ("[연구자B]", "홍길동")], "pseudonym string, original string")
    assert {r.id: r.restored for r in rewrite.restore(out, m, "id", "rewritten").collect()} == {r.id: r.text for r in texts.collect()}


def test_contains_pairs(spark):
    texts = [(i, f"글 {i} 홍길동 값{i % 7}") for i in range(50)] + [(99, None), (98, ""), (97, "X")]
    values = ["홍길동", "값3", "없다", "X", "글 4", None, ""]
    got = {tuple(r) for r in meet.contains(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(v,) for v in values], "v string"), "id", "t", "v", 1).collect()}
    assert got == {(i, v) for i, t in texts for v in values if t and v and v in t}


def test_leaks_and_verdict(spark):
    texts = spark.createDataFrame([(1, "전화 010.1234.5678 로"), (2, "깨끗함"), (3, "홍길동 옴")], "id long, text string")
    orig = spark.createDataFrame([("010-1234-5678",), ("홍길동",), ("김",)], "original string")
    assert {tuple(r) for r in audit.leaks(texts, orig, "id", "text").collect()} == {(1, "010-1234-5678"), (3, "홍길동")}
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    hit = lambda *ids: spark.createDataFrame([(i, "block") for i in ids], "doc_id string, level string")
    v = audit.verdict(docs, hit(), hit("a"), hit("b"))
    assert {r.doc_id: r.passed for r in v.collect()} == {"a": False, "b": False, "c": True}
    assert [r.doc_id for r in audit.published(docs, v).collect()] == ["c"]


def test_leaks_in_other_spellings(spark):
    nfd = lambda s: unicodedata.normalize("NFD", s)
    texts = [(1, "원 영 해 참석"), (2, nfd("담당 원영해")), (3, "원영희 해"), (4, "한·국 화\u00a0학 소재"), (5, "J a n e  D o e"), (6, "JaneDoe"), (7, "a.b\\\\E c 와 a1b 5"), (8, nfd("원 영 해")), (9, None), (10, "원영해"), (11, "이 상 없음"), (12, "12 3가"), (13, "화학 소재")]
    orig = [("원영해",), ("한국화학",), ("Jane Doe",), ("a.b\\\\Ec",), (nfd("화학"),), ("이상",), ("123가",), (None,)]
    got = {tuple(r) for r in audit.leaks(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(orig, "original string"), "id", "text").collect()}
    assert got == {(1, "원영해"), (2, "원영해"), (4, "한국화학"), (5, "Jane Doe"), (7, "a.b\\\\Ec"), (8, "원영해"), (10, "원영해"), (13, nfd("화학"))}


def test_guard_keeps_unchecked(spark):
    docs = spark.createDataFrame([("a", None), ("b", "unreadable"), ("c", None)], "doc_id string, error string")
    found = spark.createDataFrame([("a", "org"), ("a", "rrn")], "doc_id string, category string")
    got = {r.doc_id: (r.level, r.checked, r.total) for r in audit.guard(docs, found, error="error").collect()}
    assert got == {"a": ("위험", True, 2), "b": ("없음", False, 0), "c": ("없음", True, 0)}


CTX = "struct<table_id:string,row_no:int,col_no:int,header_text:string,header_axis:string,is_header:boolean>"


def test_structure(spark):
    rows = [("d", "1", 0, "b", "성명", ("T", 0, 0, "", "", True)), ("d", "2", 1, "b", "홍길동", ("T", 1, 0, "성명", "col", False)), ("d", "3", 2, "b", "한국 연구원(주)", ("T", 1, 1, "소속 기관", "col", False)),
            ("d", "4", 3, "b", "어제 홍길동은 왔다. 홍길동네 홍*동", None), ("d", "5", 4, "b", "홍 박사와 김 박사", None), ("d", "6", 5, "b", "# 참고문헌", None), ("d", "7", 6, "b", None, None), ("e", "1", 0, "b", "홍길동", None)]
    s = spark.createDataFrame(rows, f"doc_id string, seg_id string, ord int, part string, text string, table_ctx {CTX}")
    names = structure.harvested(s)
    assert {(r.category, r.value) for r in names.collect()} == {("person", "홍길동"), ("org", "한국 연구원(주)")}
    assert [r.value for r in structure.registered(names).orderBy("nth").collect()] == ["홍길동", "한국 연구원(주)"]
    (row,) = structure.row_attributes(s).collect()
    assert row.attributes == {"person": "홍길동", "org": "한국 연구원(주)"}


def test_text_sources(spark):
    md = "# T\r\n| 성명 | 소속 |\n|---|:--|\n| 홍 | A |\n| 김 |\n끝\n|--|--|\n| x | y |\n|---|---|"
    df = spark.createDataFrame([("d", md), ("e", None), ("f", "")], "doc_id string, text string")
    assert text.lines(df).filter("doc_id = 'd'").count() == 9 and text.lines(df).filter("doc_id = 'e'").count() == 0
    got = {(r.seg_id, r.table_no, r.row_no, r.header_text, r.is_header, r.text) for r in text.markdown_cells(df).collect()}
    assert got == {("L00002C00", 1, 0, "", True, " 성명 "), ("L00002C01", 1, 0, "", True, " 소속 "), ("L00004C00", 1, 1, "성명", False, " 홍 "), ("L00004C01", 1, 1, "소속", False, " A "),
                   ("L00005C00", 1, 2, "성명", False, " 김 "), ("L00008C00", 2, 0, "", True, " x "), ("L00008C01", 2, 0, "", True, " y ")}
    csv = spark.createDataFrame([("c", '﻿성명,비고\n"홍, 길동","두\n줄"\n,'), ("n", None)], "doc_id string, text string")
    assert {(r.seg_id, r.header_text, r.text) for r in text.separated_cells(csv).collect()} == {("R00000C000", "", "성명"), ("R00000C001", "", "비고"), ("R00001C000", "성명", "홍, 길동"), ("R00001C001", "비고", "두\n줄")}
    segs = spark.createDataFrame([("d", str(i), i, "x" * n) for i, n in enumerate([300, 150, 100, 900, 10])], "doc_id string, seg_id string, ord int, text string")
    assert [r.chunk for r in text.chunks(segs).orderBy("seg_id").collect()] == [0, 0, 1, 2, 3]


def test_chunks_against_the_plain_way(spark):
    import random

    r = random.Random(2)
    rows = [("a", f"{i:05d}", i, "x" * r.randint(0, 240), i % 50 == 0) for i in range(3500)] + [("b", "0", 0, None, False), (None, "0", 0, "y" * 700, False)]
    segs = spark.createDataFrame(rows, "doc_id string, seg_id string, ord int, text string, is_header boolean")
    want, c, total = {}, 0, 0
    for _, seg, _, t, head in rows[:3500]:
        if t and not head:
            if total and total + len(t) > 500:
                c, total = c + 1, 0
            total += len(t)
            want[seg] = c
    got = {x.seg_id: x.chunk for x in text.chunks(segs, skip=F.col("is_header"), block=100).filter("doc_id = 'a'").collect()}
    assert got == want and text.chunks(segs).filter("doc_id is null").count() == 1


def test_sweep():
    v = lambda value, category="person": {"value": value, "pseudonym": f"[{category}]", "category": category}
    swept = lambda t, *vs, taken=(): [t[s["start_pos"] : s["end_pos"]] for s in rewrite.sweep_spans(t, list(vs), list(taken))]
    assert swept("발표자홍길동과 홍길동", v("홍길동")) == ["홍길동", "홍길동"]
    assert swept("강산은 강산성 토양", v("강산")) == ["강산"]  # two letters: only as a word of its own
    assert swept("홍 길 동이 홍·길·동", v("홍길동")) == ["홍 길 동", "홍·길·동"] and swept("이홍 길 동", v("홍길동")) == []
    assert swept("누리연구원과 누리연구원장", v("누리연구원", "org"), v("누리", "org")) == ["누리연구원", "누리연구원"]
    assert swept("[연구자A] 연구자A", v("연구자A")) == ["연구자A"] and swept("홍길동", v("홍길동"), taken=[(1, 2)]) == []
    assert rewrite.sweep_text("홍길동과 홍 길 동", [v("홍길동")]) == "[person]과 [person]" and swept("김", v("김")) == []


def test_whole_way(spark):
    from test_mentions import segments

    rows = [
        ("a", "담당자: 최하나"), ("a", "최하나의 전화는 010-1234-5678, 메일 hana@x.co.kr"), ("a", "과제는 최 하 나와 함께"), ("a", "제목은 그대로"), ("b", "전화 010-9999-8888"), ("b", "최하나도 왔다"), ("c", "아무 값도 없다"), ("d", None),
    ]
    s = segments(spark, rows)
    run = pipeline.run(s)
    out = {r.seg_key: r.rewritten for r in run.rewritten.collect()}
    assert out[0] == "담당자: [연구자A]" and out[1].startswith("[연구자A]의 전화는 [휴대전화1], 메일 [이메일1]") and "hana" not in out[1] and out[2] == "과제는 [연구자A]와 함께" and out[3] == rows[3][1] and out[5] == "[연구자A]도 왔다" and out[7] is None
    assert {r.doc_id: r.passed for r in run.verdicts.collect()} == {"a": True, "b": True, "c": True, "d": True}
    assert {r.seg_key for r in pipeline.published(run).collect()} == set(range(8)) and pipeline.quarantined(run).count() == 0
    # the same text again: nothing more is found
    again = pipeline.run(run.rewritten.drop("text").withColumnRenamed("rewritten", "text"))
    assert again.findings.count() == 0
    # put back
    back = rewrite.restore(run.rewritten, run.mapping, "seg_key", "rewritten")
    assert {r.seg_key: r.restored for r in back.collect() if r.seg_key != 2} == {i: r[1] for i, r in enumerate(rows) if i != 2}
    # what is left out by a setting is not asked for again, and one failing document is held back alone
    strict = pipeline.run(segments(spark, [("a", "참석: 홍길동, 김철수, 박나래"), ("b", "전화 010-9999-8888")]), Config(strict_only=True))
    assert {r.doc_id: r.passed for r in strict.verdicts.collect()} == {"a": True, "b": True} and strict.plans.count() == 1
    bad = spark.createDataFrame([("z",)], "doc_id string")
    judged = pipeline.run(segments(spark, [("a", "가")]), failed=bad).verdicts
    assert {r.doc_id: r.passed for r in judged.collect()} == {"a": True, "z": False}
    masked = pipeline.run(segments(spark, [("a", "전화 010-9999-8888")]), Config(mask="*"))
    assert [r.rewritten for r in masked.rewritten.collect()] == ["전화 *************"]
