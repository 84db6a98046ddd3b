"""Command line: guard, scan, apply, verify, restore, selftest.

Exit codes: 0 nothing to attend to, 1 something found or held back, 2 wrong use or configuration, 3 a run that failed.
Messages hold counts, masked values and names of files, never values of the text; a traceback goes to a private file.
"""

from __future__ import annotations

import argparse
import os
import sys
import traceback

FOUND, USAGE, FAILED = 1, 2, 3


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("veilframe").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def _config(args):
    from veilframe import config

    return config.load(args.config) if args.config else config.Config()


def _segments(args, spark):
    from veilframe.session import ensure_checkpoint_dir
    from veilframe.sources import formats

    ensure_checkpoint_dir(spark)
    found = formats.files(spark, *args.paths)
    return found, formats.segments(found).checkpoint()


def guard(args) -> int:
    """The risk of each file, nothing written."""
    from veilframe.operators import audit, documents
    from veilframe.sinks import publish

    spark = _spark()
    _, parts = _segments(args, spark)
    found = documents.detected(parts.filter("error is null"), _config(args), documents.LAYERS if args.deep else documents.LAYERS[:3]).checkpoint()
    levels = audit.guard(parts, found, error="error").checkpoint()
    if args.json:
        print(publish.as_json({r.doc_id: {"level": r.level, "total": r.total, "checked": r.checked} for r in levels.toLocalIterator()}))
    else:
        print(publish.guard_text(levels, found))
    return FOUND if levels.filter("total > 0 or not checked").count() else 0


def scan(args) -> int:
    """Findings as a summary, nothing changed."""
    from veilframe.operators import documents
    from veilframe.sinks import publish

    spark = _spark()
    _, parts = _segments(args, spark)
    found = documents.detected(parts.filter("error is null"), _config(args)).checkpoint()
    report = publish.summary(found)
    print(publish.as_json(report) if args.json else publish.as_text(report))
    if args.report:
        with open(args.report, "w", encoding="utf-8") as f:
            f.write(publish.html(found, "findings"))
    return FOUND if report["total"] or parts.filter("error is not null").count() else 0


def apply(args) -> int:
    """Pseudonymised copies in the output folder, if every one of them passes; the mapping and all else private."""
    from pyspark.sql import functions as F

    from veilframe.operators import gate, pipeline
    from veilframe.sinks import publish
    from veilframe.sources import formats

    spark, config = _spark(), _config(args)
    if args.mask:
        config = config.with_(mask=args.mask)
    found, parts = _segments(args, spark)
    saved = os.path.join(args.private, "mapping")
    runs = sorted(os.listdir(saved)) if os.path.isdir(saved) else []
    old = publish.load_mapping(spark, os.path.join(saved, runs[-1])).checkpoint() if runs else None
    failed = parts.filter("error is not null").select("doc_id")
    run = pipeline.run(parts.filter("error is null and seg_id is not null"), config, old, failed)
    out = formats.written(found, parts.filter("error is null"), run.plans, run.mapping).join(failed, "doc_id", "left_anti").checkpoint()
    used = run.plans.join(parts.select("seg_key", "doc_id"), "seg_key").select("doc_id", "original").distinct()
    looked = gate.looked(out.select("doc_id", F.col("doc_id").alias("path"), "content"), used, config).checkpoint()
    bad = looked.filter("not passed").select("doc_id").unionByName(out.filter(F.size("blocks") > 0).select("doc_id")).unionByName(run.verdicts.filter("not passed").select("doc_id")).distinct().checkpoint()
    name = f"run-{len(runs):05d}"
    stage, target, quarantine = (os.path.join(*x) for x in ((args.private, "staging", name), (args.out,), (args.private, "failed", name)))
    held = {r.doc_id for r in bad.toLocalIterator()}
    for folder in (args.private, stage):
        os.makedirs(folder, mode=0o700, exist_ok=True)
    passed = []
    for r in out.select("doc_id", "content").toLocalIterator():  # one file at a time
        file = os.path.basename(r.doc_id.split(":", 1)[-1])
        where = quarantine if r.doc_id in held else stage
        os.makedirs(where, mode=0o700, exist_ok=True)
        with open(os.path.join(where, file), "wb") as f:
            f.write(r.content)
        if where is stage:
            passed.append(file)
    publish.save_mapping(run.mapping, os.path.join(saved, name))
    if not held or args.partial:
        os.makedirs(target, exist_ok=True)
        for file in passed:
            os.replace(os.path.join(stage, file), os.path.join(target, file))
    print(publish.as_text(publish.summary(run.findings, run.verdicts)))
    print(f"{len(passed) if not held or args.partial else 0} files published, {len(held)} held back")
    return FOUND if held else 0


def verify(args) -> int:
    """A second look at finished files, with the values of the saved mappings."""
    from pyspark.sql import functions as F

    from veilframe.operators import gate
    from veilframe.sinks import publish
    from veilframe.sources import formats

    spark = _spark()
    found = formats.files(spark, *args.paths).select(F.col("path").alias("doc_id"), "path", "content")
    saved = os.path.join(args.private, "mapping")
    runs = sorted(os.listdir(saved)) if os.path.isdir(saved) else []
    values = publish.load_mapping(spark, os.path.join(saved, runs[-1])).select("original") if runs else spark.createDataFrame([], "original string")
    # Every file is searched for every value of the saved mapping; on a command line that is a list.
    known = [r.original for r in values.toLocalIterator()]
    looked = gate.looked_for(found, known, _config(args)).checkpoint()
    for r in looked.orderBy("path").toLocalIterator():
        print(f"{'passed' if r.passed else 'failed'} {os.path.basename(r.path)} second findings {r.rescans} leaks {r.leaks}{' error ' + r.error if r.error else ''}")
    return FOUND if looked.filter("not passed").count() else 0


def restore(args) -> int:
    """Text files with their originals again, in the private folder only."""
    from veilframe.operators.rewrite import put_back
    from veilframe.sinks import publish

    spark = _spark()
    saved = os.path.join(args.private, "mapping")
    runs = sorted(os.listdir(saved)) if os.path.isdir(saved) else []
    if not runs:
        print("no mapping is saved", file=sys.stderr)
        return USAGE
    pairs = [(r.pseudonym, r.original) for r in publish.load_mapping(spark, os.path.join(saved, runs[-1])).toLocalIterator()]
    for path in args.paths:
        if not path.endswith((".md", ".txt", ".markdown")):
            print(f"{os.path.basename(path)} is no text", file=sys.stderr)
            return USAGE
        with open(path, encoding="utf-8") as f:
            publish.private_file(os.path.join(args.private, "restored", os.path.basename(path)), put_back(f.read(), pairs))
    return 0


def selftest(args) -> int:
    """The planted values of an invented document, all of which must go."""
    from veilframe import scoring
    from veilframe.session import ensure_checkpoint_dir

    spark = _spark()
    ensure_checkpoint_dir(spark)
    rows = scoring.selftest(spark).collect()
    print(f"{sum(r.removed for r in rows)} of {sum(r.n for r in rows)} planted values removed")
    return 0 if all(r.removed == r.n for r in rows) else FOUND


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilframe", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    for run in (guard, scan, apply, verify, restore, selftest):
        c = sub.add_parser(run.__name__, help=run.__doc__)
        c.set_defaults(run=run)
        c.add_argument("--config", help="folder with settings and lists")
        c.add_argument("--private", default="_private", help="folder for mappings and whatever holds original values")
        if run is not selftest:
            c.add_argument("paths", nargs="+")
        if run in (guard, scan):
            c.add_argument("--json", action="store_true")
        if run is guard:
            c.add_argument("--deep", action="store_true", help="names by context too")
        if run is scan:
            c.add_argument("--report", help="HTML file with masked values")
        if run is apply:
            c.add_argument("--out", default="out")
            c.add_argument("--mask", help="mask character instead of pseudonyms")
            c.add_argument("--partial", action="store_true", help="publish what passed although something was held back")
    return p


def main(argv: list[str] | None = None) -> int:
    from veilframe.config import ConfigError

    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else 0
    try:
        return args.run(args)
    except ConfigError as e:
        print(str(e), file=sys.stderr)
        return USAGE
    except Exception as e:
        from veilframe.sinks.publish import private_file

        private_file(os.path.join(args.private, "error.log"), traceback.format_exc())
        print(f"the run failed ({type(e).__name__}); see error.log in the private folder", file=sys.stderr)
        return FAILED
