import pytest
from pyspark.sql import functions as F

from veilframe.operators import detectors, values

CASES = [
    ("rrn", "번호 900101-1234568 끝", "", [("rrn", "900101-1234568")]),
    ("rrn", "991301-1234567 9001015234567", "", [("foreign_id", "9001015234567")]),
    ("phone", "010-1234-5678, (02) 123-4567", "", [("phone", "010-1234-5678"), ("tel", "(02) 123-4567")]),
    ("phone", "공일공-이삼사오-육칠팔구", "", [("phone", "공일공-이삼사오-육칠팔구")]),
    ("phone", "+47 55 50 01 42 내선: 1234", "", [("tel", "+47 55 50 01 42"), ("tel", "1234")]),
    ("phone", "02) 2023 2024년", "", []),
    ("email", "a.b@c.org; hong 골뱅이 daum 쩜 net; x at y.com", "", [("email", "a.b@c.org"), ("email", "hong 골뱅이 daum 쩜 net")]),
    ("card", "4111 1111 1111 1111 4111 1111 1111 1112", "", [("card", "4111 1111 1111 1111")]),
    ("account", "110-123-456789", "", []),
    ("account", "110-123-456789", "계좌", [("account", "110-123-456789")]),
    ("bizno", "120-81-47521 / 110111-0006249", "", [("bizno", "120-81-47521")]),
    ("passport", "여권 M12345678, XM12345678", "", [("passport", "M12345678")]),
    ("driver", "11-12-345678-90", "면허번호", [("driver", "11-12-345678-90")]),
    ("vehicle", "차량 12가 3456", "", [("vehicle", "12가 3456")]),
    ("address", "서울특별시 종로구 세종로 1 본관 302호에서", "", [("address", "서울특별시 종로구 세종로 1 본관 302호")]),
    ("address", "중심으로 3개, 임대아파트 모집", "", []),
    ("birth", "생년월일 1990. 2. 28. 1990-02-30", "", [("birth", "1990. 2. 28")]),
    ("handle", "카톡 ID: hong_99. 계정: plainword", "", [("handle", "hong_99")]),
    ("project_no", "과제번호: ABC-2024-01, RS-2023-00212345, 학번 20231234", "", [("project_no", "ABC-2024-01"), ("project_no", "RS-2023-00212345"), ("handle", "20231234")]),
]


def test_cases(spark):
    for name in detectors.DETECTORS:
        own = [(i, c[1], c[2]) for i, c in enumerate(CASES) if c[0] == name]
        if not own:
            continue
        df = spark.createDataFrame(own, "id long, text string, header string")
        got = {}
        for r in detectors.exploded(detectors.candidates(df, header=F.col("header"), only=(name,)), "id").orderBy("id", "seq").collect():
            got.setdefault(r.id, []).append((r.category, r.value))
        for i, *_ in own:
            assert got.get(i, []) == CASES[i][3], (name, CASES[i])


def test_offsets_are_code_points(spark):
    t = "😀\x01 a@b.co 가\x02나 c@d.co 010-1234-5678"
    df = spark.createDataFrame([(t,), (None,)], "text string")
    got = detectors.exploded(detectors.candidates(df)).collect()
    assert [(r.value, t[r.start_pos : r.end_pos]) for r in got] == [(v, v) for v in ("010-1234-5678", "a@b.co", "c@d.co")]


MORE = [
    ("phone", "+82 10 1234 5678, 82-10-1234-5678, (010) 1234-5678, 01012345678", "", ["+82 10 1234 5678", "82-10-1234-5678", "(010) 1234-5678", "01012345678"]),
    ("phone", "1010-1234-5678 010-12345-678 010-1234-56789", "", []), ("phone", "031-123-4567 ext. 345 구내 12", "", ["031-123-4567", "345"]),
    ("phone", "+821012345678 +1 (212) 555 0199", "", ["+821012345678", "+1 (212) 555 0199"]), ("email", "A.B_c+1@mail.x-y.co.kr. z@q", "", ["A.B_c+1@mail.x-y.co.kr"]),
    ("email", "user (at) host (dot) com / u [at] h.org / 골뱅이 없음", "", ["user (at) host (dot) com", "u [at] h.org"]), ("email", "kim at host dot com and meet at noon.", "", ["kim at host dot com"]),
    ("card", "4111111111111111, 4111-1111-1111-1111 41111111-11111111", "", ["4111111111111111", "4111-1111-1111-1111", "41111111-11111111"]),
    ("rrn", "900101–1234568 / 900101 1234568 / ９００１０１-１２３４５６８", "", ["900101–1234568", "９００１０１-１２３４５６８"]), ("bizno", "123-45-67890-1, 110111-0006249", "", ["123-45-67890"]),
    ("driver", "면허번호 서울 12-345678-90", "", ["서울 12-345678-90"]), ("address", "주소: 세종대로 110, 5층", "", ["세종대로 110, 5층"]), ("address", "전라남도 해남군 송지면 산정리 12-3번지", "", []),
    ("address", "해남군 송지면 12-3번지 근처, 푸른아파트 101동 202호, 공학관 302호", "", ["해남군 송지면 12-3번지", "푸른아파트 101동 202호", "공학관 302호"]),
    ("handle", "인스타 @sol_bat1, github: kim-99x. ID: park.01-", "", ["sol_bat1", "kim-99x", "park.01"]), ("project_no", "협약 번호 AB12-345, 2019R1A2C1234567, IITP 2021-0-01234", "", ["AB12-345", "2019R1A2C1234567", "2021-0-01234"]),
]


@pytest.mark.parametrize(("name", "text", "header", "want"), MORE)
def test_values(name, text, header, want):
    assert [text[a:b] for a, b, *_ in values.find(text, header, (name,))] == want


def test_pieces_hold_back(spark):
    pieces = "array<struct<start_pos:int,length:int,editable:boolean,soft:boolean>>"
    df = spark.createDataFrame([("a@b.co", [(0, 3, True, False), (3, 3, False, False)]), ("a@b.co", [(0, 6, False, True)]), ("a@b.co", None)], f"text string, pieces {pieces}")
    assert [len(r.candidates) for r in detectors.candidates(df, pieces=F.col("pieces")).collect()] == [0, 1, 1]


@pytest.mark.parametrize("rows", [[], [(None,)], [("",)]])
def test_nothing(spark, rows):
    df = detectors.candidates(spark.createDataFrame(rows, "text string"))
    assert detectors.exploded(df).count() == 0
