import pytest
from pyspark.sql import functions as F

from veilframe.llm import pii
from veilframe.llm.queries import QUERIES


def values(text, header="", recorded=""):
    return [(c, text[a:b]) for c, a, b in pii.find(text, header, recorded)]


@pytest.mark.parametrize(("text", "expected"), [
    ("서유이가 가람광역시 소금쟁이로31번길 40에 거주하며 016-069-8136 으로 연락 가능함", [("person", "서유이"), ("address", "가람광역시 소금쟁이로31번길 40"), ("phone", "016-069-8136")]),
    ("우편물은 새벽광역시 온새구 다섯우물로 327-3, 도담아파트 499호 로 보내고, 급하면 010.0716.1578 로", [("address", "새벽광역시 온새구 다섯우물로 327-3, 도담아파트 499호"), ("phone", "010.0716.1578")]),
    ("자세한 사항은 제갈명난 씨(+82-70-039-9135)에게 묻는다.", [("person", "제갈명난"), ("tel", "+82-70-039-9135")]),
    ("자세한 사항은 지건근 씨((051) 027-5729)에게 묻는다.", [("person", "지건근"), ("tel", "(051) 027-5729")]),
    ("외국인등록번호: 800719 - 7284607 / 성명: 정 예난", [("foreign_id", "800719 - 7284607"), ("person", "정 예난")]),
    ("운전면허번호 누리-73-205468-69 확인함. 차량 반납은 8층 회의실.", [("driver", "누리-73-205468-69")]),
    ("Please contact Dr. Zoé Fenömton at NO_MINON@Hub.Haesol.Example or +358 00 37 27 40.", [("person", "Zoé Fenömton"), ("email", "NO_MINON@Hub.Haesol.Example"), ("tel", "+358 00 37 27 40")]),
    ("남 궁 나 은이 다온시 도담구 다섯우물로 318-21, 본관 674호에 거주하며", [("person", "남 궁 나 은"), ("address", "다온시 도담구 다섯우물로 318-21, 본관 674호")]),
    ("mail goes to 다온시 미르구 별내울읍 126-2번지. [ref. 제25호]", [("address", "다온시 미르구 별내울읍 126-2번지")]),
    ("공일공-영삼사일-삼칠오오", [("phone", "공일공-영삼사일-삼칠오오")]),
    ("chu_ini [at] saebyeok [dot] re [dot] test", [("email", "chu_ini [at] saebyeok [dot] re [dot] test")]),
    ("Dagyeong So 책임연구원 한 명", [("person", "Dagyeong So")]),
    ("부품 010-K581-9402 규격 45.7 mm, 배포판 10.718.143", []),
    ("사업 코드 1711-5107-4961 · 올해 배정액 65,768만 원", []),
    ("642-42-50980", []),
    ("@jideul 게시판 참고. 오늘은 품질이 좋다.", []),
    ("장비를 조정하는 도구의 차이가 크다. 우리 주소", []),
    ("예가턴환경진흥원 공정개발센터와 은바윤계측센터가 시험 항목을 나누어 맡기로 함", []),
    ("m95757568", [("passport", "m95757568")]),
    ("990230-1234567", []),
])
def test_values(text, expected):
    assert values(text) == expected


def test_context_decides():
    assert values("도담해") == []
    assert values("도담해", recorded="person") == [("person", "도담해")]
    assert values("031", "전화") == []


def test_offsets_are_those_of_the_stored_text():
    text = "담당​ 배 \xad리욱 ０１６-０６９-８１３６ﾠ😀 aсе@nuri.ас.tеst"
    assert values(text) == [("person", "배 \xad리욱"), ("phone", "０１６-０６９-８１３６"), ("email", "aсе@nuri.ас.tеst")]
    import unicodedata

    nfd = unicodedata.normalize("NFD", "성명: 김솔지, 끝")
    ((c, a, b),) = pii.find(nfd)
    assert c == "person" and unicodedata.normalize("NFC", nfd[a:b]) == "김솔지"


def test_validators():
    assert pii.luhn_ok("4111111111111111") and not pii.luhn_ok("4111111111111112")
    assert pii.mod97_ok("GB82 WEST 1234 5698 7654 32") and not pii.mod97_ok("GB83 WEST 1234 5698 7654 32")
    assert ("card", "4111-1111-1111-1111") in values("카드 4111-1111-1111-1111 승인")
    assert values("카드 4111-1111-1111-1112 승인") == []


def test_redact_roundtrip():
    text = "담당자: 성로중 (010-0193-7563)"
    spans = pii.find(text)
    assert pii.redact(text, spans) == "담당자: [PERSON] ([PHONE])"
    assert pii.find(None) == pii.find("") == [] and pii.redact(None, []) is None


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "가" * 200_000 + " 성명: 김솔지", "x"), (4, "김솔지 위원", "x"), (4, "김솔지 위원", "x")]
    df = spark.createDataFrame(rows, "id long, text string, category string")
    got = sorted(map(tuple, pii.detect(df, "id", "text").collect()))
    assert got == [(3, "person", 200_005, 200_008), (4, "person", 0, 3), (4, "person", 0, 3)]
    assert pii.detect(df.limit(0), "id", "text").count() == 0
    out = {r.id: r.text2 for r in pii.placeholders(df, "text", "text2").collect()}
    assert out[1] is None and out[2] == "" and out[4] == "[PERSON] 위원"
    assert pii.detect(df, "id", "text", recorded=F.col("category")).count() == 3


def test_recorded_category_and_both_tables(spark, tmp_path):
    weak = "정리한"  # a name only if somebody recorded it as one
    df = spark.createDataFrame([(1, weak, "PERSON"), (2, weak, None), (3, None, "person")], "id long, text string, category string")
    assert {r.id: r.out for r in pii.placeholders(df, "text", "out", recorded=F.col("category")).collect()} == {1: "[PERSON]", 2: weak, 3: None}
    spark.createDataFrame([(1, "김솔지 위원", None), (1, "김솔지 위원", None)], "seg_key long, text string, table_ctx struct<header_text:string>").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([(1, weak, "person"), (1, weak, "person"), (2, None, None)], "finding_id long, text string, category string").write.parquet(f"{tmp_path}/findings.parquet")
    got = sorted(map(tuple, QUERIES["p2_redacted"](spark, str(tmp_path)).collect()))
    assert got == [("findings", 1, "[PERSON]"), ("findings", 2, None), ("segments", 1, "[PERSON] 위원")]
