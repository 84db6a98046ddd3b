"""Invented rows that make every detector hit, as inline tables for Spark and as VALUES for SQL: what the given tables lack."""

from __future__ import annotations

from veilframe.sources.formats import CELL, PIECES

#: (text, header or None)
ROWS = (
    ("법인카드 4111 1111 1111 1111, 4111-1111-1111-1111 그리고 4111 1111 1111 1112", None), ("4111111111111111", "카드번호"), ("5500005555555559 5500 0055 5555 5559 1234", None),
    ("차량 12가 3456, 345나7890", None), ("12가3456", "차량번호"), ("12가3456", "품목"), ("1990. 2. 28. 그리고 1990-02-30, 2031-01-01", "생년월일"), ("생년월일 1985년 3월 1일생", None), ("연구기간 2020-01-01", None),
    ("카톡 ID: hong_99. 계정: plainword, ID: park.01-", None), ("인스타 @sol_bat1, github: kim-99x", None), ("여권 M12345678, XM12345678 S87654321", None), ("운전면허 11-12-345678-90 서울 12-345678-90", None),
    ("내선: 1234, ext. 345, 구내 77", None), ("+47 55 50 01 42 / +1 (212) 555 0199 / +82 10 1234 5678", None), ("공일공-이삼사오-육칠팔구, (02) 123-4567", None), ("900101-1234568 9001015234567 991301-1234567", None),
    ("120-81-47521 / 123-45-67890 / 110111-0006249", None), ("110-123-456789, 1234-56-789012-34", "입금 계좌"), ("과제번호: ABC-2024-01, RS-2023-00212345, 학번 20231234", None), ("hong@daum.net; a.b+c@x-y.co.kr, z@q", None), ("😀 a@b.co 와 010-1234-5678", None),
    ("국내 유일의 기관이 3명의 연구원을 둔다", None), ("단독 보유 기술", None), ("전담 2 명의 박사, 12명의 교수", None), ("# 참고문헌", None), ("홍길동(2020)", None), (None, None), (" ", None),
)
DDL = f"seg_key bigint, doc_id string, seg_id string, ord int, part string, kind string, text string, table_ctx {CELL}, pieces {PIECES}"


def table(spark):
    """The rows as a segments table; the last third is a document of its own."""
    rows = []
    for i, (text, header) in enumerate(ROWS):
        ctx = None if header is None else ("T1", 1, 0, 1, 1, header, "col", False)
        rows.append((i, f"d{i // 10}", f"s{i:03d}", i, "p", "para", text, ctx, None))
    return spark.createDataFrame(rows, DDL)


def sql() -> str:
    """The same as the relation ``seg``."""
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    pack = lambda h: "NULL" if h is None else f"struct_pack(table_id := 'T1', row_no := 1, col_no := 0, row_span := 1, col_span := 1, header_text := {q(h)}, header_axis := 'col', is_header := false)"
    rows = ", ".join(f"({i}, 'd{i // 10}', 's{i:03d}', {i}, 'p', 'para', {q(t)}, {pack(h)}, CAST(NULL AS STRUCT(start_pos INT, length INT, editable BOOLEAN, soft BOOLEAN)[]))" for i, (t, h) in enumerate(ROWS))
    return f"seg(seg_key, doc_id, seg_id, ord, part, kind, text, table_ctx, pieces) AS (SELECT CAST(c0 AS BIGINT), c1, c2, CAST(c3 AS INT), c4, c5, c6, c7, c8 FROM (VALUES {rows}) v(c0, c1, c2, c3, c4, c5, c6, c7, c8))"
