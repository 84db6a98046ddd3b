import os

import pytest

from veilframe.llm import reading, tokens

SF = "/root/testdata/sf0.001"


def test_prose():
    text = "# 제목입니다.\n주소: 해솔시 물빛로 3.\n| 가 | 나 |.\n- 창문을 구경했다. 나는 논다.\n회의록 (2024.07.09)\nReply to: a@b.test.\nHe came.\n\n"
    assert reading.prose(text) == ["창문을 구경했다. 나는 논다.", "He came."]
    assert reading.Words().of("창문을 구경했다 Don't") == ["창문", "구경했다", "don't"]


def test_features_on_odd_texts():
    w = reading.Words()
    assert reading.features(None, {}, w) is None and reading.features("", {}, w) is None and reading.features("제목\n| 표 |", {}, w) is None
    lang, n, s, share, _, _ = reading.features("나는 논다. " * 50_000, {"ko": {"나"}}, w)
    assert (lang, n, s, share) == ("ko", 100_000, 50_000, 0.5)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lists = reading.frequent_words(reading.counted(docs))
    graded = [(r.band, r.text) for r in spark.read.parquet(f"{SF}/graded_passages.parquet").orderBy("passage_id").collect()]
    right, near = 0, 0
    for k in range(7):
        model = reading.fit([g for i, g in enumerate(graded) if i % 7 != k], lists)
        for i, (band, text) in enumerate(graded):
            if i % 7 == k:
                import numpy as np

                f = reading.features(text, lists, reading.Words())
                m = model[f[0]]
                z = np.append((np.array(f[3:]) - m[0]) / m[1], 1.0)
                right += (z @ m[3] > 0) == (band >= reading.DEMANDING)
                near += abs(z @ m[2] - band) < 1
    assert right / len(graded) >= 0.97 and near / len(graded) >= 0.95


def test_levels(spark):
    easy, hard = "나는 논다. 집이 좋다.", "비선형감쇠항에 기인한 탈경계화가 통약불가능성을 저해할 개연성이 상존하는바 이를 선결적으로 상정하고 이에 부수하는 다중공선성을 함께 상정하여야 할 것으로 사료된다."
    rows = [(1, easy, "a", "x"), (2, hard, "a", "x"), (3, None, None, "x"), (4, "", "a", "x"), (5, "| 표 |", "a", "x"), (1, easy, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, level string")
    graded = spark.createDataFrame([(1 + 4 * (i % 2), f"{easy if i % 2 == 0 else hard} {easy if i % 2 == 0 else hard}") for i in range(10)] + [(None, "x.")], "band int, text string")
    got = {r.doc_id: r for r in reading.levels(docs, graded).collect()}
    assert len(got) == 5 and not got[1].demanding and got[2].demanding and got[1].level < 2 < 4 < got[2].level
    assert all(got[i].level is None and not got[i].demanding for i in (3, 4, 5))
    assert reading.levels(docs.limit(0), graded).count() == 0


def test_tokens(spark):
    rows = [(1, "a  B", "s", "x"), (2, "A b", "s", "x"), (3, None, None, "x"), (4, "", "s", "x"), (1, "a  B", "s", "x")]
    got = {r.doc_id: r for r in tokens.measure(spark.createDataFrame(rows, "doc_id long, text string, source string, quality string")).collect()}
    assert len(got) == 4 and got[1].copy_key == got[2].copy_key != got[4].copy_key and got[3].copy_key is None
    assert got[3].n_tokens == got[4].n_tokens == 0 < got[1].n_tokens
    enc = tokens.encoder(tokens.VOCABULARY)
    assert enc.decode(enc.encode_ordinary("한글 text 12")) == "한글 text 12"
    assert tokens.quality("abc") == 1.0 and tokens.quality("12") == 0.05 and tokens.quality("a\na\na\na") == 0.25
