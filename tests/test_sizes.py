"""No join sends a table without a bound to the driver, however small Spark takes it to be."""

from veilframe.operators import documents, meet


def broadcasts(df, spark):
    """The number of broadcasts in the plan that ran, with the default bound of Spark."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return plan.split("== Initial Plan ==")[0].count("BroadcastHashJoin")


def test_salted(spark):
    rows = spark.createDataFrame([(1, "d", "ab"), (2, "d", "cd"), (3, "e", "ab")], "seg_key long, doc_id string, _g string")
    known = spark.createDataFrame([("d", "ab", "x"), ("e", "zz", "y")], "doc_id string, _g string, v string").distinct()
    out = documents.salted(rows, known, ["doc_id", "_g"])
    assert broadcasts(out, spark) == 0
    assert [tuple(r) for r in out.select("seg_key", "v").collect()] == [(1, "x")]


def test_met(spark):
    texts = spark.createDataFrame([(1, "one two three"), (2, "four")], "id long, text string")
    values = spark.createDataFrame([("two",), ("fo",), ("two",)], "value string")
    out = meet.contains(texts, values, "id", "text", "value")
    assert broadcasts(out, spark) == 1  # the sieve, which is bounded
    assert {tuple(r) for r in out.collect()} == {(1, "two"), (2, "fo")}


def test_sieve(spark):
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(2000)], "id long, key string")
    known = spark.createDataFrame([(f"k{i}",) for i in range(0, 2000, 100)], "key string")
    kept = {r.key for r in meet.sifted(rows, known, "key").collect()}
    assert {f"k{i}" for i in range(0, 2000, 100)} <= kept and len(kept) < 100
