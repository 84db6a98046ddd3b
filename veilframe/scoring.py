"""How much of what should go is gone: gold values against rewritten documents, and a self-test with planted values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import pipeline
from veilframe.sources import formats


def scored(gold: DataFrame, outputs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Rows (class, n, removed, rate): gold values (doc_id, class, value) that no longer stand in their document's output (doc_id, text).

    With findings (doc_id, value) there is one more row, class ``false``: findings that no gold value of the document
    contains or is contained in; its n counts them.
    """
    from veilframe.operators import meet

    g = gold.select("doc_id", "class", "value").filter(F.length("value") > 0).distinct()
    texts = outputs.select("doc_id", "text")
    left = meet.contains(texts, g.select("value"), "doc_id", "text", "value", 1).withColumn("left", F.lit(1))
    out = g.join(left, ["doc_id", "value"], "left").groupBy("class").agg(F.count("*").alias("n"), F.sum(F.when(F.col("left").isNull(), 1).otherwise(0)).alias("removed"))
    out = out.withColumn("rate", F.col("removed") / F.col("n"))
    if findings is not None:
        f = findings.select("doc_id", F.col("value").alias("found")).distinct()
        # a document's gold values are a list; findings meet it once
        own = g.groupBy("doc_id").agg(F.collect_set("value").alias("vs"))
        bad = f.join(own, "doc_id", "left").filter(~F.exists(F.coalesce("vs", F.array().cast("array<string>")), lambda v: F.contains(F.col("found"), v) | F.contains(v, F.col("found"))))
        out = out.unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("false").alias("class"), "n", F.lit(None).cast("long").alias("removed"), F.lit(None).cast("double").alias("rate")))
    return out


# An invented document and the values planted in it.
PLANTED = {
    "person": "배도현", "second": "황보라온", "org": "늘봄해양연구원", "phone": "010-9182-7364", "tel": "041-555-0182", "email": "dohyun.bae@neulbom.example", "rrn": "830512-1234563", "birth": "1983년 5월 12일", "address": "서울특별시 강서구 공항대로 77",
    "account": "110-234-567890", "card": "4111 1111 1111 1111", "bizno": "120-81-47521", "project_no": "NB-2031-0042", "passport": "M87654321", "handle": "bae_dohyun", "driver": "11-19-834521-62",
}
DOCUMENT = """# 연구계획서

과제번호: {project_no}
연구책임자: {person}
계좌번호 {account} (예금주 {person})

| 성명 | 소속 | 생년월일 | 연락처 | 이메일 |
|---|---|---|---|---|
| {person} | {org} | {birth} | {phone} | {email} |
| {second} | {org} | 1990년 1월 2일 | {tel} | x@neulbom.example |

{person}은 {org}의 책임자이다. 주민등록번호 {rrn}, 여권 {passport}, 운전면허 {driver}.
법인카드 {card}, 사업자 {bizno}. 주소는 {address}이고 카카오톡 ID: {handle} 로 묻는다.
{second} 박사와 황 보 라 온 박사는 같은 사람이다."""


def selftest(spark: SparkSession) -> DataFrame:
    """Rows (class, n, removed, rate) for the planted values; all of them must be gone."""
    files = spark.createDataFrame([("plan.md", DOCUMENT.format(**PLANTED).encode())], "path string, content binary")
    parts = formats.segments(files).checkpoint()
    run = pipeline.run(parts.filter("error is null"))
    out = formats.written(files, parts, run.plans, run.mapping).select("doc_id", F.decode("content", "utf-8").alias("text"))
    gold = spark.createDataFrame([("plan.md", k, v) for k, v in PLANTED.items()], "doc_id string, class string, value string")
    return scored(gold, out)
