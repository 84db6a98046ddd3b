import io
import zipfile

from veilframe.sources import office


def package(**members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_X", ".xml"), body)
    return buf.getvalue()


XLSX = package(
    xl__sharedStrings_X="<sst xmlns='x'><si><t>성명</t></si><si><r><t>홍</t></r><r><t>길동</t></r></si><si><t> </t></si><si><t>연번</t></si></sst>",
    xl__worksheets__sheet1_X="<worksheet xmlns='x'><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>3</v></c></row><row><c r='A2' t='s'><v>1</v></c><c r='B2'><v>7</v></c>"
    "<c r='C2' t='inlineStr'><is><t>가</t></is></c><c r='D2'><v>01012345678</v></c><c r='E2' t='str'><f>A1</f><v>식</v></c></row></sheetData></worksheet>",
)
DOCX = package(
    word__document_X="<w:document xmlns:w='w'><w:body><w:p><w:r><w:t>첫</w:t><w:tab/><w:t>줄</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>성명</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>소속</w:t></w:r></w:p></w:tc></w:tr>"
    "<w:tr><w:tc><w:p><w:r><w:t>홍길동</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>",
    word__header1_X="<w:hdr xmlns:w='w'><w:p><w:r><w:t>머리</w:t></w:r></w:p></w:hdr>",
)
PPTX = package(**{f"ppt__slides__slide{i}_X": f"<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>장 {i}</a:t></a:r></a:p><a:p/></p:sld>" for i in (10, 2)})
HWPX = package(
    Contents__section0_X="<hs:sec xmlns:hs='s' xmlns:hp='p'><hp:p><hp:run><hp:t>본문</hp:t></hp:run></hp:p><hp:p><hp:run><hp:tbl><hp:tr><hp:tc><hp:subList><hp:p><hp:run><hp:t>칸</hp:t></hp:run></hp:p></hp:subList>"
    "<hp:cellAddr colAddr='2' rowAddr='1'/></hp:tc></hp:tr></hp:tbl></hp:run></hp:p></hs:sec>"
)


def test_formats(spark):
    files = [("a.xlsx", XLSX), ("b.docx", DOCX), ("c.pptx", PPTX), ("d.hwpx", HWPX), ("e.pdf", b"%PDF"), ("f.docx", b"broken"), ("g.docx", None), ("h.xlsx", package(x="y"))]
    got = {}
    for r in office.segments(spark.createDataFrame(files, "path string, content binary")).collect():
        got.setdefault(r.doc_id, []).append(r)
    s = {r.seg_id: (r.text, r.row_no, r.col_no, r.header_text, r.is_header) for r in got["a.xlsx"]}
    assert s["S000001"] == ("홍길동", 1, 0, "성명", False) and s["S000000"][4] and "S000002" not in s
    assert {k for k in s if ":" in k} == {"I:sheet1!C2", "N:sheet1!D2", "V:sheet1!E2"}
    assert [(r.text, r.kind, r.table_id, r.row_no, r.col_no, r.header_text) for r in sorted(got["b.docx"], key=lambda r: r.ord)] == [
        ("첫\t줄", "para", None, None, None, None), ("성명", "cell", "T1", 0, 0, ""), ("소속", "cell", "T1", 0, 1, ""), ("홍길동", "cell", "T1", 1, 0, "성명"), ("머리", "header", None, None, None, None)]
    assert [r.text for r in sorted(got["c.pptx"], key=lambda r: r.ord)] == ["장 2", "장 10"]
    assert [(r.seg_id, r.text, r.table_id, r.row_no, r.col_no) for r in got["d.hwpx"]] == [("section0:000000", "본문", None, None, None), ("section0:000002", "칸", "section0T1", 1, 2)]
    for bad in ("e.pdf", "f.docx", "g.docx"):
        assert len(got[bad]) == 1 and got[bad][0].error
    assert len(got["h.xlsx"]) == 1 and got["h.xlsx"][0].error is None and got["h.xlsx"][0].seg_id is None
