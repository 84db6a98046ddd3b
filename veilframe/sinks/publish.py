"""Results put where they belong: published copies only as a whole and only after the verdict, everything else private.

Outputs are first written under the private folder; what passed is then moved to the public one by a rename, what did
not stays behind. The mapping and anything that holds original values never leaves the private folder.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import checks
from veilframe.operators import audit, pipeline

VERSION = 2


def _fs(spark, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def move(spark, source: str, target: str) -> None:
    """A rename within one file system; the target must not exist."""
    fs, a = _fs(spark, source)
    _, b = _fs(spark, target)
    fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        raise OSError("the output folder is taken")


def publish(run: pipeline.Run, out: str, private: str, name: str) -> dict[str, str]:
    """Write a run: ``out``/name holds rewritten segments of the documents that passed, private folders the rest.

    Either the whole of it appears in ``out`` or nothing.
    """
    spark = run.verdicts.sparkSession
    stage = f"{private}/staging/{name}"
    pipeline.published(run).select("doc_id", "seg_id", "rewritten").write.mode("errorifexists").parquet(f"{stage}/published")
    pipeline.quarantined(run).select("doc_id", "seg_id", "rewritten").write.mode("errorifexists").parquet(f"{private}/failed/{name}")
    save_mapping(run.mapping, f"{private}/mapping/{name}")
    move(spark, f"{stage}/published", f"{out}/{name}")
    return {"published": f"{out}/{name}", "failed": f"{private}/failed/{name}", "mapping": f"{private}/mapping/{name}"}


def save_mapping(mapping: DataFrame, path: str) -> None:
    """The mapping as JSON lines, version by version; a folder of the private area."""
    mapping.select(F.lit(VERSION).alias("version"), "category", F.col("map_key").alias("key"), "original", "pseudonym", F.col("idx").cast("long").alias("idx")).write.mode("errorifexists").json(path)


def load_mapping(spark, path: str) -> DataFrame:
    """A saved mapping, to go on from."""
    m = spark.read.schema("version int, category string, key string, original string, pseudonym string, idx long").json(path)
    return m.filter(F.col("version") == VERSION).select("category", F.col("key").alias("map_key"), "original", "pseudonym", "idx")


def private_file(path: str, text: str) -> None:
    """A local file that only its owner reads, in a folder that only its owner enters."""
    os.makedirs(os.path.dirname(path), mode=0o700, exist_ok=True)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        f.write(text)


def summary(findings: DataFrame, verdicts: DataFrame | None = None) -> dict:
    """Counts by category and grade, three masked samples each, and the verdict: what a public summary may say.

    Every part is an aggregate of at most as many rows as there are categories.
    """
    counts = {r.category: {"certain": r.certain, "likely": r.likely, "review": r.review, "total": r.total} for r in audit.by_category(findings).collect()}
    order = [c for c in ("doc_id", "part", "seg_id", "start_pos") if c in findings.columns]
    for r in audit.samples(findings, order).orderBy("category", "rank").collect():
        counts[r.category].setdefault("samples", []).append(r.sample)
    out = {"categories": dict(sorted(counts.items())), "total": sum(c["total"] for c in counts.values())}
    if verdicts is not None:
        g = verdicts.agg(F.count("*").alias("documents"), F.sum(F.col("passed").cast("long")).alias("passed"), F.sum("rescans").alias("rescans"), F.sum("leaks").alias("leaks"), F.sum("blocks").alias("blocks")).first()
        out["gate"] = {k: int(v or 0) for k, v in g.asDict().items()}
    return out


def as_json(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True)


def as_text(report: dict) -> str:
    lines = [f"{'category':<14}{'certain':>9}{'likely':>9}{'review':>9}{'total':>9}"]
    for name, c in report["categories"].items():
        lines.append(f"{name:<14}{c['certain']:>9}{c['likely']:>9}{c['review']:>9}{c['total']:>9}  {', '.join(c.get('samples', ()))}".rstrip())
    if "gate" in report:
        g = report["gate"]
        lines.append(f"{g['passed']} of {g['documents']} documents passed ({g['rescans']} second findings, {g['leaks']} leaks, {g['blocks']} blocks)")
    return "\n".join(lines)


def guard_text(levels: DataFrame, findings: DataFrame, top: int = 6) -> str:
    """The risk of a run in words: how many documents have each level, its most frequent categories, what to do."""
    per = {r["level"]: r["n"] for r in levels.groupBy("level").agg(F.count("*").alias("n")).collect()}
    unchecked = levels.filter(~F.col("checked")).count()
    most = findings.groupBy("category").count().orderBy(F.desc("count"), "category").limit(top).collect()
    lines = [f"{name}: {per.get(name, 0)}" for name in reversed(audit.LEVELS)] + [f"{r['category']} {r['count']}" for r in most]
    if unchecked:
        lines.append(f"unchecked: {unchecked} (not to be taken for clean)")
    risky = per.get("위험", 0) + per.get("주의", 0)
    lines.append("attention required" if risky or unchecked else "no personal data found")
    return "\n".join(lines)


def html(findings: DataFrame, title: str, private: bool = False, texts: DataFrame | None = None) -> str:
    """A report as a page: masked values (at most 1,000 rows), or, for the private folder, texts with their findings marked (at most 600)."""
    from html import escape

    if not private:
        rows = findings.select("doc_id", "seg_id", "category", "grade", checks.masked(F.col("value"), F.col("category")).alias("shown")).orderBy("doc_id", "seg_id", "category", "shown").limit(1000).collect()
        body = "".join(f"<tr><td>{escape(r.doc_id or '')}</td><td>{escape(r.seg_id or '')}</td><td>{r.category}</td><td>{r.grade}</td><td>{escape(r.shown or '')}</td></tr>" for r in rows)
        body = f"<table><tr><th>document</th><th>segment</th><th>category</th><th>grade</th><th>value</th></tr>{body}</table>"
    else:
        per = findings.groupBy("seg_key").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "category"))).alias("f"))
        rows = texts.join(per, "seg_key").select("seg_key", "text", "f").orderBy("seg_key").limit(600).collect()
        body = "".join(f"<p>{highlighted(r.text, [(x.start_pos, x.end_pos, x.category) for x in r.f])}</p>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>{body}"


def highlighted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with its spans marked; one that overlaps an earlier one is left out."""
    from html import escape

    out, at = [], 0
    for a, b, category in sorted(spans):
        if a >= at:
            out += [escape(text[at:a]), f'<mark title="{escape(category)}">{escape(text[a:b])}</mark>']
            at = b
    return "".join(out) + escape(text[at:])
