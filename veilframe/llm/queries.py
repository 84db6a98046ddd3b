"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.llm import canonical, copies, mixing, names, packing, pii, reading, tokens
from veilframe.llm.lookalike import mapping
from veilframe.session import ensure_checkpoint_dir, table


def p2_found(spark, sf_dir):
    """Every personal value of segments.text and findings.text; a repeated row counts once."""
    segments, findings = table(spark, sf_dir, "segments"), table(spark, sf_dir, "findings")
    a = pii.detect(segments, "seg_key", "text", header=F.col("table_ctx.header_text"))
    b = pii.detect(findings, "finding_id", "text", recorded=F.col("category"))
    both = a.withColumn("table_name", F.lit("segments")).unionByName(b.withColumn("table_name", F.lit("findings")))
    return both.filter(F.col("category").isin(*pii.CATEGORIES)).select("table_name", "row_id", "category", "start_pos", "end_pos").distinct()


def p2_redacted(spark, sf_dir):
    """Every text of segments and of findings (with its recorded category) with typed placeholders, once."""
    none = F.lit("")
    a = table(spark, sf_dir, "segments").select(F.lit("segments").alias("table_name"), F.col("seg_key").alias("row_id"), "text", F.col("table_ctx.header_text").alias("header"), none.alias("recorded"))
    b = table(spark, sf_dir, "findings").select(F.lit("findings").alias("table_name"), F.col("finding_id").alias("row_id"), "text", none.alias("header"), F.col("category").alias("recorded"))
    return pii.placeholders(a.unionByName(b), "text", "redacted", F.col("header"), F.col("recorded")).select("table_name", "row_id", "redacted").distinct()


def _linked(spark, sf_dir):
    return names.link(names.records(table(spark, sf_dir, "registry"), table(spark, sf_dir, "mapping")))


def p3_found(spark, sf_dir):
    """Every pair of records that stand for one person or organisation."""
    return names.pairs(_linked(spark, sf_dir))


def p3_entities(spark, sf_dir):
    """Every person and organisation record with its entity and the number of records in it."""
    linked = _linked(spark, sf_dir)
    return linked.join(linked.groupBy("entity").agg(F.count("*").alias("n_records")), "entity").select("rec_id", "entity", "n_records")


def p4_found(spark, sf_dir):
    """Every pair of segments, and of mapping entries of one category, that look the same but differ."""
    a = canonical.lookalike_pairs(table(spark, sf_dir, "segments"), "seg_key", "text")
    b = canonical.lookalike_pairs(table(spark, sf_dir, "mapping"), "rec_id", "map_key", "category")
    return a.select(F.lit("segments").alias("table_name"), "id_a", "id_b").unionByName(b.select(F.lit("mapping").alias("table_name"), "id_a", "id_b"))


def p4_canonical(spark, sf_dir):
    """Every segment's text, and every mapping entry's key with its category, in the one form."""
    a = table(spark, sf_dir, "segments").select(F.lit("segments").alias("table_name"), F.col("seg_key").alias("row_id"), F.lit(None).cast("string").alias("category"), F.col("text").alias("value"))
    b = table(spark, sf_dir, "mapping").select(F.lit("mapping").alias("table_name"), F.col("rec_id").alias("row_id"), "category", F.col("map_key").alias("value"))
    return canonical.canonical(a.unionByName(b), "value", "form").select("table_name", "row_id", "category", "form").distinct()


def _packed(spark, sf_dir, one_source=False):
    # pack_sizes is a small table of parameters.
    runs = sorted((r.run_id, r.capacity) for r in table(spark, sf_dir, "pack_sizes").distinct().collect())
    ensure_checkpoint_dir(spark)
    documents = table(spark, sf_dir, "documents")
    items = copies.clustered(tokens.measure(documents, near=True).checkpoint(), documents)
    return packing.pack(items, runs, one_source)


def p6_packed(spark, sf_dir):
    """Every document with tokens, in containers of each capacity."""
    return _packed(spark, sf_dir)


def p6_packed_by_source(spark, sf_dir):
    """The same with the source as a constraint too: a container holds documents of one source only."""
    return _packed(spark, sf_dir, one_source=True)


def p6_usage(spark, sf_dir):
    """How full the containers of each capacity are."""
    return packing.usage(_packed(spark, sf_dir))


def _mixed(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    items = tokens.measure(table(spark, sf_dir, "documents")).checkpoint()
    plan = mixing.budgets(items, table(spark, sf_dir, "mix_targets"))
    return mixing.select(items, plan), plan


def p7_selected(spark, sf_dir):
    """The documents of each mix and how often each is used."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark, sf_dir):
    """The share of all tokens that each source of each mix reaches."""
    return mixing.report(*_mixed(spark, sf_dir))


def _levels(spark, sf_dir):
    return reading.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "graded_passages"))


def p8_found(spark, sf_dir):
    """Every document whose prose is as demanding as the two upper bands."""
    return _levels(spark, sf_dir).filter("demanding").select("doc_id")


def p8_levels(spark, sf_dir):
    """The reading level of every document."""
    return _levels(spark, sf_dir)


def p8_levels_named(spark, sf_dir):
    """The reading level of every document by the two named terms alone, to hold against p8_levels."""
    return reading.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "graded_passages"), terms=reading.NAMED)


def p8_profile(spark, sf_dir):
    """Reading levels by source and language of the prose."""
    own = _levels(spark, sf_dir).filter("level is not null")
    return own.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.avg("level").alias("mean_level"), F.avg(F.col("demanding").cast("double")).alias("demanding_share"))


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p3_found, p3_entities, p4_found, p4_canonical, p6_packed, p6_packed_by_source, p6_usage, p7_selected, p7_shares, p8_found, p8_levels, p8_levels_named, p8_profile)}



def _forms_sql() -> str:
    """Relations signs (each code point that looks like others, made by rule) and form (of every text, in DuckDB)."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    signs = ", ".join(f"(chr({ord(ch)}), {q(to)})" for ch, to in mapping().items() if ord(ch))
    return f"""signs(ch, shown) AS (VALUES {signs}),
txt AS (SELECT DISTINCT 'segments' AS table_name, seg_key AS row_id, CAST(NULL AS VARCHAR) AS category, text AS t FROM segments UNION ALL SELECT DISTINCT 'mapping', rec_id, category, map_key FROM mapping),
one AS (SELECT DISTINCT t FROM txt WHERE t IS NOT NULL), pos AS (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM one), ch AS (SELECT t, i, substr(t, i, 1) AS c FROM pos),
shown AS (SELECT t, nfc_normalize(string_agg(coalesce(signs.shown, c), '' ORDER BY i)) AS form FROM ch LEFT JOIN signs ON signs.ch = c GROUP BY t UNION ALL SELECT '', '')"""


ORACLE: dict[str, str] = {
    "p4_canonical": f"WITH {_forms_sql()} SELECT DISTINCT table_name, row_id, category, form FROM txt LEFT JOIN shown USING (t)",
    "p4_found": f"""WITH {_forms_sql()}, f AS (SELECT DISTINCT table_name, row_id, coalesce(category, '') AS category, t, form FROM txt JOIN shown USING (t))
SELECT DISTINCT a.table_name, a.row_id AS id_a, b.row_id AS id_b FROM f a JOIN f b ON a.table_name = b.table_name AND a.category = b.category AND a.form = b.form AND a.row_id < b.row_id AND a.t <> b.t""",
}
