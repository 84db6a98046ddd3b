"""People, organisations and departments by context, and what only the whole document decides."""

import pytest
from pyspark.sql import functions as F

from veilframe.config import Config, Rule
from veilframe.operators import context, documents, rules
from veilframe.queries import QUERIES

cut = lambda t, found: [t[f[0] : f[1]] for f in found]


@pytest.mark.parametrize(("text", "want"), [
    ("참석: 홍길동(서울대), 김철수, 이 / 장소", ["홍길동", "김철수"]), ("참석: 홍길동, 김철수, 강산", ["홍길동", "김철수", "강산"]), ("참석: 홍길동, 강산", ["홍길동"]), ("예금주 박영희", ["박영희"]),
    ("Dr. Jane Doe and Prof. Data Science (Dr. Kim Lee, 2020)", ["Jane Doe"]), ("담당자: 최하나, 소속: 누리연구소", ["최하나"]), ("회의에 Josephine Caliskov 위원이 왔다", ["Josephine Caliskov"]),
    ("Alexander Torundberg 책임연구원님께서", ["Alexander Torundberg"]), ("박사과정 Elena Marsh-Kent 발표", ["Elena Marsh-Kent"]), ("마이클 첸(Michael Chen) 박사", ["마이클 첸", "Michael Chen"]),
    ("연구센터 (Data Science) 교수", []), ("Jane Doe 시장 조사", []), ("Jane Doe 위원회", []), ("From: Jane Doe 교수", ["Jane Doe"]), ("Jane D. 교수", ["Jane D"]), ("From: Data Science", []), ("발표(Jane Doe) 자료", []), ("", []),
])
def test_people(text, want):
    assert cut(text, context.people(text)) == want


@pytest.mark.parametrize(("text", "want"), [
    ("영주시 보건소와 스타트업 '솔바람', KAIST, University of Oxford, 정책기획부", ["영주시 보건소", "솔바람", "KAIST", "University of Oxford", "정책기획부"]), ("누리대학교에서 ㈜하늘과 카이스트의", ["누리대학교", "하늘과", "카이스트"]),
    ("박사후연구원과 참여연구원, 정부출연연구기관, 연락처", []), ("Northern Coast Institute of Marine Data 와 UC Santa", ["Northern Coast Institute of Marine Data", "UC Santa"]), ("바람산업(주) 제공", ["바람산업(주)"]),
])
def test_organisations(text, want):
    assert cut(text, context.organisations(text)) == want


def test_departments_and_words():
    t = "누리대학교 산학협력단 기계공학과 총무과"
    assert cut(t, context.departments(t, 5)) == ["산학협력단", "기계공학과"]
    assert context.is_word("홍길동은", 0, 3) and not context.is_word("홍길동네", 0, 3) and not context.is_word("이홍길동", 1, 4)
    assert context.header_category("성명(한글)") == "person" and context.header_category("소속 기관") == "org" and context.header_category("비고") is None
    assert context.given_name_hits("민수는 김민수와 민수 씨", "김민수") == [(0, True), (9, True)] and context.given_name_hits("농민수당", "김민수") == [(1, False)]
    assert context.surname_titles("김 부장과 최하나 이사장, 남궁 박사") == [(0, 1, "김"), (15, 17, "남궁")]


def test_rules():
    config = Config(deny=(("비밀", "confidential"), ("비밀 사업", "confidential")), rules=(Rule("n", "budget", r"(\d+)원", ("금액",), "예산", "추정"),))
    t = "예산 금액 100원, 비밀 사업과 비밀"
    assert [(t[f[0] : f[1]], f[2], f[3]) for f in rules.find(t, config)] == [("비밀 사업", "confidential", "확실"), ("비밀", "confidential", "확실"), ("금액", "budget", "추정"), ("100", "budget", "추정")]
    assert rules.find("금액 100원", config) == []


CTX = "struct<table_id:string,row_no:int,col_no:int,row_span:int,col_span:int,header_text:string,header_axis:string,is_header:boolean>"
PIECES = "array<struct<node:string,slot:string,start_pos:int,length:int,editable:boolean,soft:boolean,node_offset:int>>"


def segments(spark, rows):
    cell = lambda h, head=False: ("t", 1, 0, 1, 1, h, "col", head)
    rows = [(i, *r[:1], f"s{i}", i, "p", "para", r[1], cell(*r[2]) if len(r) > 2 and r[2] else None, r[3] if len(r) > 3 else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, f"seg_key long, doc_id string, seg_id string, ord int, part string, kind string, text string, table_ctx {CTX}, pieces {PIECES}")


def test_documents(spark):
    s = segments(spark, [
        ("d", "담당자: 최하나"), ("d", "최하나는 최 과장"), ("d", "김두리", ("성명",)), ("d", "김 부장"), ("d", "작성자: 김세나"), ("d", "두리 씨와 세나는"), ("d", "소속: [기관A], 부서: 가나"), ("d", "성명", ("성명", True)),
        ("d", "홍길동 010-1234-5678", None, [("n", "s", 0, 3, False, False, 0)]), ("d", "# 참고문헌"), ("d", "참석: 강보배, 문하루"), ("e", "최하나"), ("d", None), ("d", " "), ("d", "누리대학교와 누리대 그리고 한국누리연구원 산학협력단"),
    ])
    found = {(r.seg_key, r.value, r.category, r.grade, "".join(r.detectors)) for r in documents.detected(s).collect()}
    assert {f for f in found if f[0] < 5} == {
        (0, "최하나", "person", "확실", "L2L3"), (1, "최하나", "person", "확실", "L2"), (1, "최", "person", "확실", "L3"), (2, "김두리", "person", "확실", "L2"), (3, "김", "person", "추정", "L3"), (4, "김세나", "person", "확실", "L2L3"),
    }
    assert {f[1:3] for f in found if f[0] == 5} == {("두리", "person"), ("세나", "person")} and {f[1:3] for f in found if f[0] == 8} == {("010-1234-5678", "phone")}
    assert not {f for f in found if f[0] in (6, 7, 10, 11, 12, 13)}
    assert {f[1:3] for f in found if f[0] == 14} == {("누리대학교", "org"), ("누리대", "org"), ("한국누리연구원", "org"), ("산학협력단", "dept")}
    quick = {r.value for r in documents.detected(s, layers=documents.LAYERS[:3]).collect()}
    assert "두리" not in quick and "김두리" in quick
    assert documents.detected(s.limit(0)).count() == 0
    on = Config(allow=("최하나",), categories=frozenset({"person"}))
    assert {r.value for r in documents.detected(s, on).collect()} & {"최하나", "010-1234-5678", "누리대학교"} == set()


def test_registry_holds_labelled_names(spark, tmp_path):
    s = segments(spark, [("d", "담당자: 최하나"), ("d", "최하나는 최 과장"), ("d", "김두리", ("성명",)), ("d", "김 부장"), ("d", "작성자: 김세나"), ("d", "소속: [기관A], 부서: 가나")])
    s.write.parquet(f"{tmp_path}/segments.parquet")
    got = lambda q, *c: {tuple(r) for r in QUERIES[q](spark, str(tmp_path)).select(*c).collect()}
    assert got("l2_registry", "category", "value", "nth") == {("person", "최하나", 1), ("person", "김두리", 2), ("person", "김세나", 3)}
    assert (1, "최하나", 0, 3) in got("l2_propagate", "seg_key", "value", "start_pos", "end_pos")
    assert got("l3_unique_surnames", "surname", "value") == {("최", "최하나")}
    assert got("l3_surname_mentions", "seg_key", "start_pos", "value") == {(1, 5, "최하나"), (3, 0, "김세나")}
