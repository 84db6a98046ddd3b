from veilframe.llm import mixing


def items(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, n_tokens long, quality double, bucket string").select("doc_id", "source", "n_tokens", "quality", "bucket")


def run(spark, rows, targets):
    df = items(spark, rows).drop("bucket")
    plan = mixing.budgets(df, spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_repeats int"))
    sel = mixing.select(df, plan)
    return [r.asDict() for r in sel.collect()], {(r.mix_id, r.source): r for r in mixing.report(sel, plan).collect()}


def test_shares_and_caps(spark):
    rows = [(i, "big", 10 + i % 50, 0.5) for i in range(4000)] + [(10_000 + i, "small", 20, 1.0) for i in range(100)] + [(20_000, None, 5, 1.0), (20_001, "small", 0, 1.0)]
    sel, rep = run(spark, rows, [(1, "big", 0.75, 3), (1, "small", 0.25, 3), (2, "absent", 0.5, 2), (2, "big", 0.5, 2), (3, "absent", 1.0, 2)])
    assert abs(rep[1, "big"].share - 0.75) < 0.005 and abs(rep[1, "small"].share - 0.25) < 0.005
    assert all(r["repeats"] == 3 for r in sel if r["source"] == "small")  # complete epochs up to the cap
    assert max(r["repeats"] for r in sel if r["mix_id"] == 1) <= 3
    assert rep[2, "absent"].n_tokens == 0 and rep[2, "big"].share == 1.0 and rep[2, "big"].most_repeats == 2
    assert rep[3, "absent"].share == 0.0
    assert len({(r["mix_id"], r["doc_id"]) for r in sel}) == len(sel)
    total = sum(r["n_tokens"] * r["repeats"] for r in sel if r["mix_id"] == 1)
    assert abs(total - 4 * 3 * 100 * 20) < 60


def test_a_giant_leaves_no_gap(spark):
    rows = [(i, "a", 10, 1.0) for i in range(1000)] + [(5000, "a", 9000, 1.0), (6000, "b", 8000, 1.0)]
    _, rep = run(spark, rows, [(1, "a", 0.5, 1), (1, "b", 0.5, 1)])
    assert abs(rep[1, "a"].share - 0.5) < 0.01


def test_quality_weighs(spark):
    rows = [(i, "a", 10, 1.0 if i % 2 else 0.1) for i in range(4000)] + [(9000 + i, "b", 10, 1.0) for i in range(500)]
    sel, _ = run(spark, rows, [(1, "a", 0.5, 1), (1, "b", 0.5, 1)])
    good = [r["doc_id"] % 2 for r in sel if r["source"] == "a"]
    assert len(good) == 500 and sum(good) > 400


def test_empty(spark):
    sel, rep = run(spark, [], [(1, "a", 1.0, 2)])
    assert sel == [] and rep[1, "a"].n_docs == 0


def test_what_is_missing_is_less_than_any_document_left(spark):
    rows = [(i, "a", 7 + i % 13, 1.0) for i in range(300)] + [(1000 + i, "b", 90 + i, 1.0) for i in range(40)]
    sel, rep = run(spark, rows, [(1, "a", 0.9, 1), (1, "b", 0.1, 1)])
    used = {r["doc_id"] for r in sel}
    for (_, source), r in rep.items():
        rest = [n for i, s, n, _ in rows if s == source and i not in used]
        assert r.missing >= 0 and (not rest or r.missing < min(rest))
