import random
import unicodedata

from veilframe.llm import canonical
from veilframe.llm.lookalike import decomposed
from veilframe.llm.queries import QUERIES


def brute(s):
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(map(decomposed, s))))


SAME = ["가나 12-3", "가나 12‐3", "가나　１２－３", unicodedata.normalize("NFD", "가나 12-3"), "가​나 １2−3﻿", "가나\xa012-3"]
OTHER = ["가나12-3", "가나 12-4", "가나 12-3ㄱ", "가나 12 3"]


def test_pairs(spark):
    rows = [(i, s, "a") for i, s in enumerate(SAME + OTHER)] + [(50, "Apple", "a"), (51, "Аррlе", "a"), (52, "apple", "a"), (53, "Аррlе", "b"), (54, None, "a"), (55, "", "a"), (56, "​", "a"), (0, SAME[0], "a")]
    df = spark.createDataFrame(rows, "id long, t string, scope string")
    got = [tuple(r) for r in canonical.lookalike_pairs(df, "id", "t", "scope").collect()]
    n = len(SAME)
    assert sorted(got) == sorted([(a, b) for a in range(n) for b in range(a + 1, n)] + [(50, 51), (55, 56)])
    assert canonical.lookalike_pairs(df.limit(0), "id", "t").count() == 0


def test_copies_pair_only_across_spellings(spark):
    df = spark.range(5000).selectExpr("id", "if(id < 4990, '상동', '상동​') as t")
    p = canonical.lookalike_pairs(df, "id", "t")
    assert p.count() == p.distinct().count() == 4990 * 10


def test_form_against_brute_force(spark):
    r = random.Random(5)
    signs = "aé가각각̧̣́̂̈ο​Ａ１ ㄱ㈜①ﬁ½😀Å①ｶﾞ각ͅ\xad"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(400)] + ["é" * 30_000 + "ẹ́", None]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "id long, t string, pos int, key string")
    out = {x.id: x.form2 for x in canonical.canonical(df, "t", "form2").collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i] == (None if t is None else brute(t)), (t, out[i])
    assert all(brute(brute(t)) == brute(t) for t in texts if t is not None)


def test_both_tables(spark, tmp_path):
    spark.createDataFrame([(i, s) for i, s in enumerate(SAME)] + [(0, SAME[0]), (90, None), (91, "")], "seg_key long, text string").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([(0, "person", SAME[2]), (1, None, SAME[3])], "rec_id long, category string, map_key string").write.parquet(f"{tmp_path}/mapping.parquet")
    got = [tuple(r) for r in QUERIES["p4_canonical"](spark, str(tmp_path)).collect()]
    assert len(got) == len(SAME) + 4
    assert set(got) == {("segments", i, None, SAME[0]) for i in range(len(SAME))} | {("segments", 90, None, None), ("segments", 91, None, ""), ("mapping", 0, "person", SAME[0]), ("mapping", 1, None, SAME[0])}
