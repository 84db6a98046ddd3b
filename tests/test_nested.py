import json

import pytest

from veilframe.operators import nested

P = {"tag": "hp:p", "children": [{"tag": "hp:run", "children": {"tag": "{urn:x}t", "text": "a"}}]}


def tree(*kids, tag="hs:sec", **more):
    return {"tag": tag, "children": list(kids)} | more


def cell(*kids, addr=None, first=True):
    a = [] if addr is None else [{"tag": "hp:cellAddr", "attrib": addr}]
    return tree(*(a + list(kids) if first else list(kids) + a), tag="hp:tc")


TABLE = tree(
    tree(tree(P, tag="hp:subList"), tag="hp:caption"),
    tree(cell(P, addr={"rowAddr": "4", "colAddr": 7}, first=False), cell(P), tag="hp:tr"),
    tree(cell(tree(tree(tree(cell(P), tag="hp:tr"), tree(tree(P), tag="hp:caption"), tag="hp:tbl"), tag="hp:p"), addr=[{"name": "rowAddr", "value": 1}, {"name": "colAddr", "value": "0"}]), tag="hp:tr"),
    tag="hp:tbl",
)


def places(t, member="Contents/section0.xml"):
    return [r[4:9] for r in nested.walk(nested.read_tree(t), member) if r[0] == "paragraph"]


def test_places():
    got = places(json.dumps(tree(tree(TABLE, tag="hp:p"), P, None)))
    assert got == [
        ("section0:000000", "", -1, -1, ""),
        ("section0:000001", "", -1, -1, "section0:000000"),  # a caption is no cell
        ("section0:000002", "section0T1", 4, 7, "section0:000000"),
        ("section0:000003", "section0T1", 0, 1, "section0:000000"),
        ("section0:000004", "section0T1", 1, 0, "section0:000000"),
        ("section0:000005", "section0T2", 0, 0, "section0:000004"),
        ("section0:000006", "section0T1", 1, 0, "section0:000004"),  # the inner caption lies in the outer cell
        ("section0:000007", "", -1, -1, ""),
    ]


@pytest.mark.parametrize("wrap", [lambda s: "﻿" + s, json.dumps, lambda s: json.dumps(json.dumps(s)), lambda s: s.replace('"children": [', '"attrib": null, "children": [')])
def test_producers_agree(wrap):
    plain = json.dumps(tree(P, tree(TABLE, tag="hp:p")))
    assert places(wrap(plain)) == places(plain)


@pytest.mark.parametrize("bad", [None, "", "{", "[]", "3", "null", '{"a": 1}', '{"tag": "p"', '"x"'])
def test_unreadable(bad):
    with pytest.raises(nested.Unreadable):
        nested.read_tree(bad)


def test_any_depth():
    deep = 40_000
    t = '{"tag":"p","children":[' * deep + '{"tag":"p"}' + "]}" * deep
    rows = places(t)
    assert len(rows) == deep + 1 and rows[-1][4] == f"section0:{deep - 1:06d}"
    with pytest.raises(nested.Unreadable):
        nested.read_tree(t[:-1])


def test_flatten_and_link(spark):
    rows = [("d", "Contents/section0.xml", json.dumps(tree(P, tree(TABLE, tag="p"))), 1), ("d", "Contents/section1.xml", "{", 1), (None, None, None, 1)]
    parts = spark.createDataFrame(rows + rows[:1], "doc_id string, member string, tree string, kind int")
    nodes = nested.flatten(parts)
    assert nested.unreadable(nodes).count() == 2
    assert {(r.table_id, r.row_no, r.col_no) for r in nested.tables(nodes).collect()} == {("section0T1", -1, -1), ("section0T2", 1, 0)}
    assert nested.paragraphs(nodes).filter("text = 'a'").count() == 2 * 6
    packages = spark.createDataFrame([("d", {"section0:000000": "Contents/section0.xml", "section1:000000": "Contents/section1.xml"}), ("e", None)], "doc_id string, part_of map<string,string>")
    ctx = "struct<table_id string,row_no int,col_no int>"
    segments = spark.createDataFrame([("s", "x1", "body", ("T1", 0, None)), ("s", "x1", "body", ("T1", 0, None)), ("s", "x2", None, None)], f"doc_id string, seg_id string, part string, table_ctx {ctx}")
    got = [tuple(r) for r in nested.linked_paragraphs(parts, packages, segments).collect()]
    assert len(got) == len(set(got)) == 8 + 1 + 1
    assert ("d", "Contents/section1.xml", "section1:000000", "", -1, -1, "") in got
    assert ("s", "body", "x1", "T1", 0, None, "") in got
    assert nested.linked_paragraphs(parts.limit(0), packages.limit(0), segments.limit(0)).count() == 0
