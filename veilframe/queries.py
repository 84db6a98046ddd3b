"""The core's registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import fixtures
from veilframe.config import SAMPLE_RULES, Config
from veilframe.functions import checks
from veilframe.functions.lexicon import HEADER_CATEGORY, HEADERS, NUMBERED, PARTICLES, SURNAMES, SURNAMES_2, TITLES, UNSURE_SURNAMES
from veilframe.operators import audit, context, detectors, documents, intervals, mapping, meet, merge, nested, pipeline, rewrite, structure
from veilframe.oracles import L1, RUNS, SEG, rule_rows
from veilframe.session import ensure_checkpoint_dir, table, unsized
from veilframe.sources import text


def p1_found(spark, sf_dir):
    return nested.linked_paragraphs(*(table(spark, sf_dir, t) for t in ("xml_parts", "hwpx_docs", "segments")))


def p1_tables(spark, sf_dir):
    """Every table of every readable tree, once, with its place in the table around it."""
    return nested.tables(nested.flatten(table(spark, sf_dir, "xml_parts"), ("table",), with_text=False)).distinct()


def p1_variants(spark, sf_dir):
    """How often each role occurs in each structural variant; repeated rows of a member count once."""
    nodes = nested.flatten(table(spark, sf_dir, "xml_parts"), with_text=False)
    return nodes.select("doc_id", "member", "kind", "variant", "node_no").distinct().groupBy("kind", "variant").count().withColumnRenamed("count", "n")


def p5_found(spark, sf_dir):
    return intervals.coverage(table(spark, sf_dir, "findings"), ["doc_id", "seg_id"], "start_pos", "end_pos")


def _segments(spark, sf_dir):
    """Every segment once: a repeated row differs by loaded_at alone.

    The shuffle that removes repeats has a set number of partitions, so that a plan which works hard on few bytes is
    not coalesced into a few tasks after it.
    """
    c = ["seg_key", "doc_id", "seg_id", "ord", "part", "kind", "text", "table_ctx", "pieces"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "segments").select(*c).repartition(n, "seg_key").distinct()


def _findings(spark, sf_dir):
    c = ["finding_id", "doc_id", "seg_id", "part", "start_pos", "end_pos", "text", "category", "grade", "detectors"]
    return table(spark, sf_dir, "findings").select(*c).dropDuplicates(["finding_id"]).withColumn("category", F.lower("category"))


def _mapping(spark, sf_dir):
    return table(spark, sf_dir, "mapping").select("rec_id", "category", "map_key", "original", "pseudonym", "n_used", "idx").dropDuplicates(["rec_id"])


def _detected(spark, sf_dir, *only):
    found = detectors.candidates(_segments(spark, sf_dir), header=F.col("table_ctx.header_text"), pieces=F.col("pieces"), only=only or None)
    return detectors.exploded(found, "seg_key").select("seg_key", "start_pos", "end_pos", "category", "grade", "note", "value")


def _detector_query(name):
    def query(spark, sf_dir):
        return _detected(spark, sf_dir, name)

    query.__name__ = f"l1_{name}"
    query.__doc__ = f"Candidates of the detector {name} in all segments."
    return query


def l1_email(spark, sf_dir):
    """Plain e-mail addresses in all segments."""
    return _detected(spark, sf_dir, "email").filter("note = ''")


def l1_spoken_email(spark, sf_dir):
    """E-mail addresses that are spelt out in words."""
    return _detected(spark, sf_dir, "email").filter("note <> ''")


def l1_email_values(spark, sf_dir):
    """Plain e-mail addresses of all segments, with how often each stands in a segment."""
    found = _detected(spark, sf_dir, "email").filter("note = ''")
    return found.groupBy("seg_key", "value").agg(F.count("*").alias("n"))


def src_lines(spark, sf_dir):
    return text.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def src_markdown_cells(spark, sf_dir):
    return text.markdown_cells(table(spark, sf_dir, "documents").select("doc_id", "text"))


def src_grid(spark, sf_dir):
    """Table rows of segments, put together again."""
    c = F.col("table_ctx")
    cells = _segments(spark, sf_dir).filter(c.isNotNull()).select("doc_id", "seg_id", c["table_id"].alias("table_id"), c["row_no"].alias("row_no"), c["col_no"].alias("col_no"), "text")
    return text.grid(cells)


def src_chunks(spark, sf_dir):
    return text.chunks(_segments(spark, sf_dir), skip=F.col("table_ctx.is_header"))


def val_resident(spark, sf_dir):
    """Shape and check digit of the mapping's resident numbers."""
    d = checks.digits(F.col("map_key"))
    return _mapping(spark, sf_dir).filter("category = 'rrn' and map_key is not null").select("rec_id", d.alias("digits"), checks.resident_shape(d).alias("shape_ok"), checks.resident_check(d).alias("check_ok"), checks.foreign_shape(d).alias("is_foreign"))


def val_business(spark, sf_dir):
    """Check digit of the registry's business numbers."""
    d = checks.digits(F.col("attributes")["bizno"])
    return table(spark, sf_dir, "registry").filter(F.col("attributes")["bizno"].isNotNull()).select("rec_id", d.alias("digits"), checks.business_check(d).alias("check_ok")).distinct()


def val_luhn(spark, sf_dir):
    """Luhn check of all runs of 13 to 19 digits in segments, separators aside."""
    runs = _segments(spark, sf_dir).select("seg_key", checks.digits(F.col("text")).alias("digits")).filter(F.length("digits").between(13, 19))
    return runs.select("seg_key", "digits", checks.luhn(F.col("digits")).alias("ok"))


def sc_mapping_key(spark, sf_dir):
    return _mapping(spark, sf_dir).filter("original is not null").select("rec_id", checks.mapping_key(F.col("original")).alias("key"))


def sc_context_text(spark, sf_dir):
    return _segments(spark, sf_dir).filter("text is not null").select("seg_key", detectors.context(F.col("text"), F.col("table_ctx.header_text")).alias("context"))


def psn_tag(spark, sf_dir):
    """The letters of each index."""
    return _mapping(spark, sf_dir).filter("idx is not null").select("rec_id", checks.alpha_tag(F.col("idx")).alias("tag"))


def psn_issue(spark, sf_dir):
    """Pseudonyms for the recorded findings, numbered over all documents."""
    f = _findings(spark, sf_dir).select("category", F.col("text").alias("value"), "doc_id", "seg_id", "start_pos", "finding_id")
    f = f.withColumn("start_pos", F.coalesce("start_pos", F.lit(-1)))
    return mapping.issue(f, ["doc_id", "seg_id", "start_pos", "finding_id"])


def psn_continue(spark, sf_dir):
    """New keys of the findings, numbered after those that the mapping holds."""
    f = _findings(spark, sf_dir).select("category", F.col("text").alias("value"), "doc_id", "seg_id", "start_pos", "finding_id")
    old = _mapping(spark, sf_dir).select("category", "map_key", "idx").filter("idx is not null")
    return mapping.issue(f.withColumn("start_pos", F.coalesce("start_pos", F.lit(-1))), ["doc_id", "seg_id", "start_pos", "finding_id"], old)


def mrg_findings(spark, sf_dir):
    """Findings of all layers - rules, values, structure, context - resolved per segment."""
    out = documents.detected(_segments(spark, sf_dir), Config(rules=SAMPLE_RULES))
    return out.withColumn("detectors", F.array_join("detectors", ","))


def mrg_values(spark, sf_dir):
    """Candidates of the value detectors alone, resolved per segment."""
    found = detectors.candidates(_segments(spark, sf_dir), header=F.col("table_ctx.header_text"), pieces=F.col("pieces"))
    out = merge.merged(found, ["doc_id", "seg_id"])
    return out.withColumn("detectors", F.array_join("detectors", ","))


def mrg_recorded(spark, sf_dir):
    """Recorded findings of each segment, resolved to one list."""
    f = _findings(spark, sf_dir).filter("start_pos >= 0 and end_pos > start_pos")
    one = F.struct("finding_id", "start_pos", "end_pos", "category", "grade", "detectors", F.lit("").alias("note"))
    per = f.groupBy("doc_id", "seg_id").agg(F.array_sort(F.collect_list(one)).alias("candidates")).withColumn("text", F.lit(""))
    return merge.merged(per, ["doc_id", "seg_id"]).select("doc_id", "seg_id", "start_pos", "end_pos", "category", "grade", F.array_join("detectors", ",").alias("detectors"), "note")


def mrg_allow_list(spark, sf_dir):
    """Recorded findings whose text no mapping entry that was used more than once holds."""
    allow = _mapping(spark, sf_dir).filter("n_used > 1 and original is not null").select(F.col("original").alias("text")).distinct()
    return _findings(spark, sf_dir).filter("text is not null").join(allow, "text", "left_anti").select("finding_id", "text")


def rul_deny_list(spark, sf_dir):
    """Originals of the mapping, wherever they stand in a segment: a deny list of any length, as a join."""
    deny = _mapping(spark, sf_dir).filter("length(original) >= 2").select("original")
    return meet.contains(_segments(spark, sf_dir), deny, "seg_key", "text", "original")


#: A deny list and rules as a user would set them.
USER = Config(deny=(("담당자", "confidential"), ("협약", "confidential"), ("Institute", "org")), rules=SAMPLE_RULES)


def _layer(spark, sf_dir, *layers, config=Config()):
    scan = documents.scanned(_segments(spark, sf_dir), config, layers)
    f = scan.select("seg_key", "text", F.explode("found").alias("f")).select("seg_key", "f.start_pos", "f.end_pos", "f.category", "f.grade", "f.note", F.substring("text", F.col("f.start_pos") + 1, F.col("f.end_pos") - F.col("f.start_pos")).alias("value"))
    return f


def rul_rules(spark, sf_dir):
    """Spans of a deny list and of the sample rules in all segments."""
    return _layer(spark, sf_dir, "rule", config=USER)


def l2_header_category(spark, sf_dir):
    h = F.col("table_ctx.header_text")
    return _segments(spark, sf_dir).filter(h.isNotNull()).select(h.alias("header"), structure.header_category(h).alias("category")).filter("category is not null").groupBy("header", "category").agg(F.count("*").alias("n"))


def l2_harvest(spark, sf_dir):
    return structure.harvested(_segments(spark, sf_dir)).select("doc_id", "seg_id", "category", "value").distinct()


def _scan(spark, sf_dir, *layers):
    ensure_checkpoint_dir(spark)
    return documents.scanned(_segments(spark, sf_dir), layers=layers or documents.LAYERS).checkpoint()


def l2_cells(spark, sf_dir):
    """Cells that their header names, as findings."""
    return _layer(spark, sf_dir, "L2")


def l2_registry(spark, sf_dir):
    """Each document's names from cells and labels, numbered in the order of their first mention."""
    names = _scan(spark, sf_dir, "L2").select("doc_id", "part", "ord", "seg_id", F.explode("names").alias("n")).select("doc_id", "part", "ord", "seg_id", "n.category", "n.value")
    return structure.registered(names)


def l2_row_attributes(spark, sf_dir):
    out = structure.row_attributes(_segments(spark, sf_dir))
    return out.select("doc_id", "part", "table_id", "row_no", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attributes"))


def l2_propagate(spark, sf_dir):
    """Registered names and their variants wherever they stand in their document."""
    scan = _scan(spark, sf_dir, "L2")
    out = documents.propagated(scan, documents.registry(scan)).select("seg_key", F.explode("hits").alias("h"))
    return out.select("seg_key", "h.category", "h.value", "h.start_pos", "h.end_pos")


def l2_labels(spark, sf_dir):
    """Names of people, organisations and departments after a label in running text."""
    no_cells = _segments(spark, sf_dir).withColumn("table_ctx", F.lit(None).cast("struct<header_text:string,is_header:boolean>"))
    return documents.scanned(no_cells, layers=("L2",)).select("doc_id", "seg_id", F.explode("names").alias("n")).select("doc_id", "seg_id", "n.category", "n.value").distinct()


def l3_unique_surnames(spark, sf_dir):
    """Family names that one registered person of a document has."""
    return documents.unique_surnames(documents.registry(_scan(spark, sf_dir, "L2"))).filter("n = 1").select("doc_id", "surname", "value")


def _people(scan):
    f = scan.select("doc_id", "text", F.explode(F.filter("found", lambda f: (f["detector"] == "L3") & (f["category"] == "person"))).alias("f"))
    return f.select("doc_id", F.lit("person").alias("category"), F.substring("text", F.col("f.start_pos") + 1, F.col("f.end_pos") - F.col("f.start_pos")).alias("value")).distinct()


def l3_surname_mentions(spark, sf_dir):
    """Family names with a title, and whom they mean."""
    scan = _scan(spark, sf_dir)
    out = documents.surname_hits(scan, documents.registry(scan), _people(scan))
    return out.select("seg_key", "hit.start_pos", "hit.end_pos", "hit.grade", "hit.note", "hit.value").distinct()


def l3_given_names(spark, sf_dir):
    """People called by their given name alone."""
    scan = _scan(spark, sf_dir)
    people = documents.registry(scan).filter("category = 'person'").select("doc_id", "value").unionByName(_people(scan).select("doc_id", "value")).distinct()
    return documents.given_hits(scan, people).select("seg_key", "hit.start_pos", "hit.end_pos", "hit.value").distinct()


def l3_references(spark, sf_dir):
    """Segments at or after their document's list of references."""
    return documents.in_references(_scan(spark, sf_dir, "L2"))


def l3_people(spark, sf_dir):
    """Names after labels, payee marks and forms of address, before titles."""
    return _layer(spark, sf_dir, "L3").filter("category = 'person'")


def l3_organisations(spark, sf_dir):
    """Organisations by ending, mark, quotes, office, abbreviation and English name."""
    return _layer(spark, sf_dir, "L3").filter("category = 'org'")


def l3_departments(spark, sf_dir):
    """Departments right after an organisation."""
    return _layer(spark, sf_dir, "L3").filter("category = 'dept'")


def l3_short_universities(spark, sf_dir):
    scan = _scan(spark, sf_dir)
    return documents.short_university_hits(scan, documents.registry(scan)).select("seg_key", "hit.start_pos", "hit.end_pos", "hit.value")


def swp_sweep(spark, sf_dir):
    """What is left of the mapping's values in all segments beside the recorded findings, plain or spaced."""
    m = _mapping(spark, sf_dir).filter("original is not null and pseudonym is not null").select("category", "original", "pseudonym")
    f = _findings(spark, sf_dir).filter("start_pos is not null and end_pos > start_pos").join(unsized(_segments(spark, sf_dir).select("doc_id", "seg_id", "seg_key")), ["doc_id", "seg_id"]).select("seg_key", "start_pos", "end_pos")
    return rewrite.swept(_segments(spark, sf_dir), f, m)


def _plans(spark, sf_dir):
    f = _findings(spark, sf_dir).filter("category is not null and start_pos is not null and end_pos > start_pos and trim(text) <> ''").withColumn("map_key", checks.mapping_key(F.col("text")))
    return rewrite.planned(f, psn_issue(spark, sf_dir))


def pln_apply(spark, sf_dir):
    """Every segment with its recorded findings replaced by pseudonyms."""
    return rewrite.apply_plans(_segments(spark, sf_dir).select("seg_key", "doc_id", "seg_id", "text"), _plans(spark, sf_dir), ["doc_id", "seg_id"]).select("seg_key", "rewritten")


def pln_mask(spark, sf_dir):
    """Every certain finding and what a mask puts in its place."""
    f = _findings(spark, sf_dir).filter("start_pos is not null and end_pos > start_pos")
    return rewrite.planned(f, None, strict_only=True, mask="*").select("finding_id", "replacement")


def rst_restore(spark, sf_dir):
    """Segments rewritten and put back."""
    ensure_checkpoint_dir(spark)
    issued = psn_issue(spark, sf_dir).checkpoint()
    f = _findings(spark, sf_dir).filter("category is not null and start_pos is not null and end_pos > start_pos and trim(text) <> ''").withColumn("map_key", checks.mapping_key(F.col("text")))
    out = rewrite.apply_plans(_segments(spark, sf_dir).select("seg_key", "doc_id", "seg_id", "text"), rewrite.planned(f, issued), ["doc_id", "seg_id"])
    return rewrite.restore(out, issued, "seg_key", "rewritten").select("seg_key", "restored")


def ver_leaks(spark, sf_dir):
    """Originals of the mapping that still stand in a segment, with other separators too."""
    return audit.leaks(_segments(spark, sf_dir), _mapping(spark, sf_dir), "seg_key", "text")


def _run(spark, sf_dir):
    return pipeline.run(_segments(spark, sf_dir), Config(rules=SAMPLE_RULES))


def ver_verdict(spark, sf_dir):
    """The whole way - detect, issue, plan, sweep, rewrite, look again - and the verdict on every document."""
    return _run(spark, sf_dir).verdicts


def ver_rescan(spark, sf_dir):
    """What the second look still finds in the rewritten segments."""
    return _run(spark, sf_dir).rescan


def pub_published(spark, sf_dir):
    """Rewritten segments of the documents that passed."""
    return pipeline.published(_run(spark, sf_dir)).select("seg_key", "doc_id", "rewritten")


def ver_context_risk(spark, sf_dir):
    return audit.context_risk(_segments(spark, sf_dir))


def grd_documents(spark, sf_dir):
    return audit.guard(_segments(spark, sf_dir), _findings(spark, sf_dir).filter("category is not null"))


def grd_packages(spark, sf_dir):
    """Packages with the first reason why a member could not be read: unchecked, never clean."""
    docs = table(spark, sf_dir, "hwpx_docs").select("doc_id", F.get("parse_errors", F.lit(0))["reason"].alias("error"))
    return audit.guard(docs, _findings(spark, sf_dir).select("doc_id", "category"), error="error")


def grd_run(spark, sf_dir):
    """How many documents have each level."""
    return grd_documents(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n_docs"), F.sum("total").alias("n_findings"))


def rpt_by_category(spark, sf_dir):
    return audit.by_category(_findings(spark, sf_dir).filter("category is not null"))


def rpt_masked(spark, sf_dir):
    return _mapping(spark, sf_dir).filter("original is not null").select("rec_id", checks.masked(F.col("original"), F.col("category")).alias("masked"))


def rpt_samples(spark, sf_dir):
    """The first three distinct masked values of each category (a top-k report)."""
    f = _findings(spark, sf_dir).withColumn("value", F.col("text"))
    return audit.samples(f, ["doc_id", "seg_id", "finding_id"])


def flagship(spark, sf_dir):
    """Detect in all layers, resolve and rate: the risk level of every document, from its text alone."""
    s = _segments(spark, sf_dir)
    return audit.guard(s.select("doc_id"), documents.detected(s, Config(rules=SAMPLE_RULES)).select("doc_id", "category"))


def _fixture_query(name):
    def query(spark, sf_dir):
        found = detectors.candidates(fixtures.table(spark), header=F.col("table_ctx.header_text"), pieces=F.col("pieces"), only=(name,))
        out = detectors.exploded(found, "seg_key").select("seg_key", "start_pos", "end_pos", "category", "grade", "note", "value")
        return out.filter("note <> '말로 풀어 쓴 전자우편'") if name == "email" else out

    query.__name__ = f"fx_{name}"
    query.__doc__ = f"Candidates of the detector {name} in the invented rows."
    return query


def fx_context_risk(spark, sf_dir):
    """Warnings of uniqueness and of small groups in the invented rows."""
    return audit.context_risk(fixtures.table(spark))


def fx_references(spark, sf_dir):
    """Invented rows at or after their document's list of references."""
    ensure_checkpoint_dir(spark)
    return documents.in_references(documents.scanned(fixtures.table(spark), layers=("L2",)).checkpoint())


#: Names under which the deny list holds values that the invented rows and the given segments do hold.
def rul_terms(spark, sf_dir):
    """A deny list that hits, met by the join: the categories' words in all segments."""
    terms = spark.createDataFrame([(w,) for w in ("연구원", "과제번호", "Research", "010-", "센터")], "term string")
    return meet.contains(_segments(spark, sf_dir), terms, "seg_key", "text", "term")


def p1_paragraphs(spark, sf_dir):
    """Every paragraph of every readable tree with its member, table, cell and the paragraph around it."""
    return nested.paragraphs(nested.flatten(table(spark, sf_dir, "xml_parts"), ("paragraph",), with_text=False)).drop("text", "variant").distinct()


def p1_cells(spark, sf_dir):
    """Every cell of every readable tree, with or without a paragraph in it."""
    return nested.cells(nested.flatten(table(spark, sf_dir, "xml_parts"), ("cell",), with_text=False)).distinct()


def p1_unreadable(spark, sf_dir):
    """Trees that cannot be read, and why."""
    return nested.unreadable(nested.flatten(table(spark, sf_dir, "xml_parts"), ("unreadable",), with_text=False)).distinct()


def p1_segment_tables(spark, sf_dir):
    """The tables that cells of segments name, with their extent."""
    c = F.col("table_ctx")
    s = _segments(spark, sf_dir).filter(c.isNotNull())
    return s.groupBy("doc_id", "part", c["table_id"].alias("table_id")).agg(F.count("*").alias("n_cells"), F.max(c["row_no"]).alias("last_row"), F.max(c["col_no"]).alias("last_col"))


_OWN = (
    fx_context_risk, fx_references, rul_terms, p1_paragraphs, p1_cells, p1_unreadable, p1_segment_tables, *map(_fixture_query, detectors.DETECTORS), p1_found, p1_tables, p1_variants, p5_found, l1_email, l1_spoken_email, l1_email_values, src_lines, src_markdown_cells, src_grid, src_chunks, val_resident, val_business, val_luhn,
    sc_mapping_key, sc_context_text, psn_tag, psn_issue, psn_continue, mrg_findings, mrg_values, mrg_recorded, mrg_allow_list, rul_deny_list, rul_rules, l2_header_category, l2_harvest, l2_cells, l2_labels, l2_registry,
    l2_row_attributes, l2_propagate, l3_unique_surnames, l3_surname_mentions, l3_given_names, l3_references, l3_people, l3_organisations, l3_departments, l3_short_universities,
    pln_apply, pln_mask, swp_sweep, rst_restore, ver_leaks, ver_verdict, ver_rescan, pub_published, ver_context_risk, grd_documents, grd_packages, grd_run, rpt_by_category, rpt_masked, rpt_samples, flagship,
)
QUERIES = {f.__name__: f for f in (*_OWN, *(_detector_query(d) for d in detectors.DETECTORS if d != "email"))}

# Parts of the SQL that several queries share.
_SEG = "seg AS (SELECT DISTINCT ON (seg_key) seg_key, doc_id, seg_id, ord, part, kind, text, table_ctx FROM segments)"
_FIND = "f AS (SELECT DISTINCT ON (finding_id) finding_id, doc_id, seg_id, start_pos, end_pos, text, lower(category) AS category, grade FROM findings)"
_MAP = "m AS (SELECT DISTINCT ON (rec_id) rec_id, category, map_key, original, n_used, idx FROM mapping)"
_HEADS = "heads(header, category) AS (VALUES " + ", ".join(f"('{h}', '{c}')" for h, c in sorted(HEADER_CATEGORY.items())) + ")"
_RANK = "CASE WHEN category IN ('rrn','foreign_id','card','account','passport','driver') THEN 3 WHEN category IN ('person','phone','tel','email','address','birth','vehicle','handle') THEN 2 ELSE 1 END"
_LEVEL = "CASE coalesce({0}, 0) WHEN 3 THEN '위험' WHEN 2 THEN '주의' WHEN 1 THEN '참고' ELSE '없음' END"
_NUMBERED = "CASE category " + " ".join(f"WHEN '{c}' THEN '{label}'" for c, label in NUMBERED.items()) + " ELSE regexp_replace(category, '[^A-Za-z가-힣]', '', 'g') END"
_DIGIT = lambda d, i: f"CAST(substr({d}, {i}, 1) AS INT)"
_SUM = lambda d, ws: " + ".join(f"{_DIGIT(d, i + 1)} * {w}" for i, w in enumerate(ws))
_BIRTH = "(CAST(substr(d,3,2) AS INT) BETWEEN 1 AND 12 AND CAST(substr(d,5,2) AS INT) BETWEEN 1 AND CASE WHEN CAST(substr(d,3,2) AS INT) = 2 THEN 29 WHEN CAST(substr(d,3,2) AS INT) IN (4,6,9,11) THEN 30 ELSE 31 END)"
_KEY = r"""CASE WHEN length(regexp_replace(translate(k, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g')) >= 6 AND NOT regexp_matches(k, '\p{L}') THEN regexp_replace(translate(k, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g') ELSE lower(k) END"""
_NORMAL = r"""trim(regexp_replace(replace(replace(nfc_normalize({0}), chr(8203), ''), chr(65279), ''), '[\s\p{{Z}}]+', ' ', 'g'), ' ')"""
_GUARD = f"""{_FIND}, g AS (SELECT doc_id, count(*) AS total, max({_RANK}) AS r FROM f WHERE category IS NOT NULL GROUP BY doc_id),
docs AS (SELECT DISTINCT doc_id FROM segments),
out AS (SELECT docs.doc_id, coalesce(total, 0) AS total, true AS checked, {_LEVEL.format('r')} AS level FROM docs LEFT JOIN g ON docs.doc_id IS NOT DISTINCT FROM g.doc_id)"""

_HEAD_OF = "coalesce(head_map[regexp_replace({0}, '\\s+', '', 'g')], head_map[regexp_replace({0}, '[\\s()（）\\[\\]]', '', 'g')], list_filter(list_transform(list_reverse(regexp_split_to_array({0}, '[\\s()（）\\[\\]/·,]+')), lambda w: head_map[w]), lambda x: x IS NOT NULL)[1])".replace(
    "head_map", "MAP {" + ", ".join(f"'{h}': '{c}'" for h, c in sorted(HEADER_CATEGORY.items())) + "}"
)
_PSEUDO = r"regexp_matches({0}, '\[[가-힣A-Za-z]+?(?:[A-Z]+|\p{{Nd}}+)(?:-[가-힣A-Za-z]+\p{{Nd}}*)?\]')"
_LATIN = r"regexp_full_match({0}, '[A-ZÀ-ÖØ-ÞĀ-Ž][A-Za-zÀ-ž.''\-]+( [A-ZÀ-ÖØ-ÞĀ-Ž][A-Za-zÀ-ž.''\-]+){{1,3}}')"
_HELD = "len(list_filter(coalesce(pieces, []), lambda p: p.start_pos < {1} AND {0} < p.start_pos + p.length AND NOT coalesce(p.editable, true) AND NOT coalesce(p.soft, false))) = 0"
_SEG = "seg AS (SELECT DISTINCT ON (seg_key) seg_key, doc_id, seg_id, ord, part, kind, text, table_ctx, pieces FROM segments)"
_WIDE = "translate({0}, '０１２３４５６７８９', '0123456789')"
_S2, _S2A = SURNAMES_2.replace(" ", "|"), SURNAMES
_LABEL_WORDS = {c: "|".join(sorted((h.replace("(", "[(]").replace(")", "[)]") for h in HEADERS[c].split("|")), key=len, reverse=True)) for c in ("person", "org", "dept")}
_ALL_LABELS = "|".join(sorted((h.replace("(", "[(]").replace(")", "[)]") for c in ("person", "org", "dept") for h in HEADERS[c].split("|")), key=len, reverse=True))
_LABEL_MAP = "MAP {" + ", ".join(f"'{h}': '{c}'" for c in ("person", "org", "dept") for h in HEADERS[c].split("|")) + "}"
_LABELLED = rf"""{_SEG}, lab AS (SELECT doc_id, seg_id, part, ord, unnest(regexp_extract_all(text, '({_ALL_LABELS})[\s\p{{Z}}]*[:：][\s\p{{Z}}]*([^\s\p{{Z}},，/|]{{2,20}})', 0)) AS m FROM seg),
lab2 AS (SELECT doc_id, seg_id, part, ord, {_LABEL_MAP}[regexp_extract(m, '^({_ALL_LABELS})')] AS category, regexp_extract(m, '^({_ALL_LABELS})[\s\p{{Z}}]*[:：][\s\p{{Z}}]*(.*)$', 2) AS value FROM lab),
labelled AS (SELECT * FROM lab2 WHERE NOT {_PSEUDO.format('value')} AND CASE WHEN category = 'person' THEN regexp_full_match(value, '(({_S2})[가-힣]{{1,2}}|[{SURNAMES}][가-힣]{{1,2}})') ELSE length(value) >= 3 END)"""
_NAMES = rf"""{_LABELLED}, own AS (SELECT doc_id, seg_id, part, ord, trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS v, {_HEAD_OF.replace('{0}', 'table_ctx.header_text')} AS category FROM seg WHERE table_ctx IS NOT NULL AND NOT coalesce(table_ctx.is_header, false)),
cell AS (SELECT *, CASE WHEN category = 'person' THEN CASE WHEN {_LATIN.format('v')} THEN [v] ELSE list_filter(regexp_extract_all(v, '[가-힣]+'), lambda x: length(x) BETWEEN 2 AND 5) END WHEN category = 'dept' OR length(v) >= 3 THEN [v] ELSE [] END AS vs FROM own WHERE category IN ('person', 'org', 'dept') AND v <> '' AND NOT {_PSEUDO.format('v')}),
names AS (SELECT doc_id, seg_id, part, ord, category, unnest(vs) AS value FROM cell UNION ALL SELECT doc_id, seg_id, part, ord, category, value FROM labelled)"""
_FOLLOW = "|".join(sorted({*PARTICLES.split(), *TITLES.split()}, key=len, reverse=True))
_TAG = """CASE WHEN idx < 26 THEN chr(CAST(65 + idx AS INT)) WHEN idx < 702 THEN chr(CAST(65 + (idx - 26) // 26 AS INT)) || chr(CAST(65 + (idx - 26) % 26 AS INT))
ELSE chr(CAST(65 + (idx - 702) // 676 AS INT)) || chr(CAST(65 + (idx - 702) // 26 % 26 AS INT)) || chr(CAST(65 + (idx - 702) % 26 AS INT)) END"""
_NAMED = f"CASE WHEN category IN ('person','org','dept') THEN '[' || CASE category WHEN 'person' THEN '연구자' WHEN 'org' THEN '기관' ELSE '부서' END || {_TAG} || ']' ELSE '[' || {_NUMBERED} || CAST(idx + 1 AS VARCHAR) || ']' END"
_ISSUED = f"""{_FIND}, ia AS (SELECT *, coalesce(start_pos, -1) AS sp, {_NORMAL.format('text')} AS k FROM f WHERE category IS NOT NULL AND trim(text, ' ') <> ''), ib AS (SELECT *, {_KEY} AS map_key FROM ia),
ic AS (SELECT *, row_number() OVER (PARTITION BY category, map_key ORDER BY doc_id, seg_id, sp, finding_id) AS r, count(*) OVER (PARTITION BY category, map_key) AS n_used FROM ib),
idd AS (SELECT category, map_key, text AS original, n_used, row_number() OVER (PARTITION BY category ORDER BY doc_id, seg_id, sp, finding_id) - 1 AS idx FROM ic WHERE r = 1), issued AS (SELECT *, {_NAMED} AS pseudonym FROM idd)"""
_SPLICE = """pl AS (SELECT DISTINCT doc_id, seg_id, start_pos AS s, end_pos AS e, issued.{0} AS rep, issued.pseudonym AS ps FROM ib JOIN issued USING (category, map_key) WHERE coalesce(grade, '') <> '검토' AND start_pos >= 0 AND end_pos > start_pos),
pl2 AS (SELECT seg_key, text, s, e, rep, row_number() OVER (PARTITION BY seg_key ORDER BY s, e, ps) AS r FROM seg JOIN pl USING (doc_id, seg_id) WHERE e <= length(text)),
go AS (SELECT seg_key, r, e, substr(text, 1, s) || rep AS done FROM pl2 WHERE r = 1 UNION ALL SELECT p.seg_key, p.r, CASE WHEN p.s >= g.e THEN p.e ELSE g.e END, CASE WHEN p.s >= g.e THEN g.done || substr(p.text, g.e + 1, p.s - g.e) || p.rep ELSE g.done END FROM go g JOIN pl2 p ON p.seg_key = g.seg_key AND p.r = g.r + 1),
last AS (SELECT seg_key, arg_max(done, r) AS done, arg_max(e, r) AS e FROM go GROUP BY seg_key),
spliced AS (SELECT seg.seg_key, CASE WHEN last.done IS NULL THEN text ELSE last.done || substr(text, last.e + 1) END AS rewritten FROM seg LEFT JOIN last USING (seg_key))"""
_STARS = "repeat('*', CAST(greatest({0}, 0) AS INT))"
_HEADC = "CASE WHEN length({0}) <= 1 THEN repeat('*', greatest(length({0}), 1)) ELSE left({0}, 1) || repeat('*', length({0}) - 1) END"
_HOST = "regexp_replace(v, '^[^@]*@', '')"
_MASKED = f"""CASE WHEN v = '' THEN '' WHEN category = 'person' THEN CASE WHEN length(v) <= 2 THEN left(v, 1) || '*' ELSE left(v, 1) || {_STARS.format('length(v) - 2')} || right(v, 1) END
WHEN category IN ('rrn', 'foreign_id') THEN CASE WHEN length(d) >= 2 THEN left(d, 2) || '****-*******' ELSE '******' END
WHEN category IN ('phone', 'tel') THEN CASE WHEN length(d) >= 8 THEN {_STARS.format('length(d) - 4')} || right(d, 4) WHEN length(d) = 0 THEN {_STARS.format('greatest(length(v), 1)')} ELSE {_STARS.format('length(d)')} END
WHEN category = 'email' AND contains(v, '@') THEN {_HEADC.format("split_part(v, '@', 1)")} || '@' || CASE WHEN contains({_HOST}, '.') THEN {_HEADC.format("regexp_extract(" + _HOST + ", '^(.*)[.]', 1)")} || regexp_extract({_HOST}, '[.][^.]*$') ELSE {_HEADC.format(_HOST)} END
WHEN category = 'card' THEN {_STARS.format('length(d) - 4')} || right(d, 4) WHEN category = 'account' THEN {_STARS.format('length(d) - 3')} || right(d, 3)
WHEN category = 'address' AND regexp_matches(v, '\\S\\s+\\S') AND regexp_matches(split_part(v, ' ', 1), '[시도]$') THEN split_part(v, ' ', 1) || ' ******' ELSE {_HEADC.format('v')} END"""

ORACLE = {
    "p5_found": """
WITH v AS (SELECT DISTINCT doc_id, seg_id, start_pos AS s, end_pos AS e FROM findings
           WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL AND end_pos > start_pos),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id, seg_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, seg_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
c AS (SELECT doc_id, seg_id, island, min(s) AS s, max(e) AS e FROM n GROUP BY doc_id, seg_id, island),
g AS (SELECT doc_id, seg_id, lag(e) OVER (PARTITION BY doc_id, seg_id ORDER BY s) AS s, s AS e FROM c)
SELECT doc_id, seg_id, 'cover' AS kind, s AS start_pos, e AS end_pos FROM c
UNION ALL SELECT doc_id, seg_id, 'gap', s, e FROM g WHERE s IS NOT NULL
""",
    "l1_email_values": rf"""WITH {_SEG}, e AS (SELECT seg_key, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}')) AS value FROM seg)
SELECT seg_key, value, count(*) AS n FROM e GROUP BY ALL""",
    "src_lines": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS i FROM l)
SELECT doc_id, printf('L%05d', i + 1) AS seg_id, CAST(i AS INT) AS ord, 'line' AS kind, regexp_replace(line, '\\r$', '') AS text FROM e""",
    "src_grid": f"""WITH {_SEG}, c AS (SELECT doc_id, table_ctx.table_id AS table_id, table_ctx.row_no AS row_no, table_ctx.col_no AS col_no, seg_id, coalesce(text, '') AS text FROM seg WHERE table_ctx IS NOT NULL)
SELECT doc_id, table_id, row_no, '| ' || string_agg(text, ' | ' ORDER BY col_no, seg_id) || ' |' AS line FROM c GROUP BY doc_id, table_id, row_no""",
    "val_resident": f"""WITH {_MAP}, n AS (SELECT rec_id, regexp_replace({_WIDE.format('map_key')}, '[^0-9]', '', 'g') AS d FROM m WHERE category = 'rrn' AND map_key IS NOT NULL)
SELECT rec_id, d AS digits, length(d) = 13 AND substr(d,7,1) <> '0' AND {_BIRTH} AS shape_ok,
CASE WHEN length(d) = 13 THEN (11 - ({_SUM('d', [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])}) % 11) % 10 = {_DIGIT('d', 13)} ELSE false END AS check_ok,
length(d) = 13 AND substr(d,7,1) IN ('5','6','7','8') AND {_BIRTH} AS is_foreign FROM n""",
    "val_business": f"""WITH n AS (SELECT DISTINCT rec_id, regexp_replace({_WIDE.format("attributes['bizno']")}, '[^0-9]', '', 'g') AS d FROM registry WHERE attributes['bizno'] IS NOT NULL)
SELECT rec_id, d AS digits, CASE WHEN length(d) = 10 THEN (10 - ({_SUM('d', [1, 3, 7, 1, 3, 7, 1, 3, 5])} + {_DIGIT('d', 9)} * 5 // 10) % 10) % 10 = {_DIGIT('d', 10)} ELSE false END AS check_ok FROM n""",
    "val_luhn": f"""WITH {_SEG}, n AS (SELECT seg_key, regexp_replace({_WIDE.format('text')}, '[^0-9]', '', 'g') AS d FROM seg WHERE text IS NOT NULL),
k AS (SELECT * FROM n WHERE length(d) BETWEEN 13 AND 19)
SELECT seg_key, d AS digits, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(d, length(d) - i + 1, 1) AS INT) ELSE (CAST(substr(d, length(d) - i + 1, 1) AS INT) * 2) // 10 + (CAST(substr(d, length(d) - i + 1, 1) AS INT) * 2) % 10 END)) % 10 = 0 AS ok FROM k""",
    "sc_context_text": f"""WITH {_SEG} SELECT seg_key, CASE WHEN length(table_ctx.header_text) > 0 THEN table_ctx.header_text || ' ' || text ELSE text END AS context FROM seg WHERE text IS NOT NULL""",
    "sc_mapping_key": f"""WITH {_MAP}, k AS (SELECT rec_id, {_NORMAL.format('original')} AS k FROM m WHERE original IS NOT NULL) SELECT rec_id, {_KEY} AS key FROM k""",
    "psn_issue": f"""WITH {_FIND}, a AS (SELECT *, coalesce(start_pos, -1) AS sp, {_NORMAL.format('text')} AS k FROM f WHERE category IS NOT NULL AND trim(text, ' ') <> ''),
b AS (SELECT *, {_KEY} AS map_key FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY category, map_key ORDER BY doc_id, seg_id, sp, finding_id) AS r, count(*) OVER (PARTITION BY category, map_key) AS n_used FROM b),
d AS (SELECT category, map_key, text AS original, n_used, row_number() OVER (PARTITION BY category ORDER BY doc_id, seg_id, sp, finding_id) - 1 AS idx FROM c WHERE r = 1)
SELECT category, map_key, original, idx, CASE WHEN category IN ('person','org','dept') THEN '[' || CASE category WHEN 'person' THEN '연구자' WHEN 'org' THEN '기관' ELSE '부서' END ||
CASE WHEN idx < 26 THEN chr(CAST(65 + idx AS INT)) WHEN idx < 702 THEN chr(CAST(65 + (idx - 26) // 26 AS INT)) || chr(CAST(65 + (idx - 26) % 26 AS INT))
ELSE chr(CAST(65 + (idx - 702) // 676 AS INT)) || chr(CAST(65 + (idx - 702) // 26 % 26 AS INT)) || chr(CAST(65 + (idx - 702) % 26 AS INT)) END || ']'
ELSE '[' || {_NUMBERED} || CAST(idx + 1 AS VARCHAR) || ']' END AS pseudonym, n_used FROM d""",
    "psn_tag": f"""WITH {_MAP} SELECT rec_id, CASE WHEN idx < 26 THEN chr(CAST(65 + idx AS INT)) WHEN idx < 702 THEN chr(CAST(65 + (idx - 26) // 26 AS INT)) || chr(CAST(65 + (idx - 26) % 26 AS INT))
ELSE chr(CAST(65 + (idx - 702) // 676 AS INT)) || chr(CAST(65 + (idx - 702) // 26 % 26 AS INT)) || chr(CAST(65 + (idx - 702) % 26 AS INT)) END AS tag FROM m WHERE idx IS NOT NULL""",
    "mrg_allow_list": f"""WITH {_FIND}, {_MAP} SELECT finding_id, text FROM f WHERE text IS NOT NULL AND text NOT IN (SELECT original FROM m WHERE n_used > 1 AND original IS NOT NULL)""",
    "rul_deny_list": f"""WITH {_SEG}, {_MAP} SELECT DISTINCT seg_key, original FROM seg JOIN m ON contains(seg.text, m.original) WHERE length(original) >= 2""",
    "l2_header_category": f"""WITH {_SEG}, {_HEADS}, h AS (SELECT table_ctx.header_text AS header FROM seg WHERE table_ctx.header_text IS NOT NULL)
SELECT h.header, heads.category, count(*) AS n FROM h JOIN heads ON heads.header = regexp_replace(h.header, '\\s+', '', 'g') GROUP BY ALL""",
    "l2_harvest": rf"""WITH {_SEG}, {_HEADS}, c AS (SELECT doc_id, seg_id, trim(text, ' ') AS t, heads.category AS category FROM seg JOIN heads ON heads.header = table_ctx.header_text WHERE NOT coalesce(table_ctx.is_header, false)
  AND NOT regexp_matches(text, '\[[가-힣A-Za-z]+?(?:[A-Z]+|[0-9]+)\]')),
p AS (SELECT doc_id, seg_id, category, unnest(CASE WHEN regexp_matches(t, '^[A-Z][A-Za-z.''\-]+(?: [A-Z][A-Za-z.''\-]+){{1,3}}$') THEN [t] ELSE list_filter(regexp_extract_all(t, '[가-힣]+'), lambda x: length(x) BETWEEN 2 AND 5) END) AS value FROM c WHERE category = 'person')
SELECT DISTINCT doc_id, seg_id, category, value FROM p UNION SELECT DISTINCT doc_id, seg_id, category, t FROM c WHERE category = 'org' AND length(t) >= 3 OR category = 'dept' AND length(t) > 0""",
    "l3_references": rf"""WITH {_SEG}, s AS (SELECT doc_id, min(ord) AS o FROM seg WHERE regexp_matches(text, '^\s*#{{0,4}}\s*(?:참고문헌|References|인용문헌|참고자료)') GROUP BY doc_id)
SELECT seg_key FROM seg JOIN s ON seg.doc_id = s.doc_id AND ord >= o WHERE trim(text, ' ') <> ''""",
    "l2_cells": rf"""WITH {_SEG}, {_HEADS}, c AS (SELECT *, trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS v, {_HEAD_OF.replace('{0}', 'table_ctx.header_text')} AS category FROM seg WHERE table_ctx IS NOT NULL AND NOT coalesce(table_ctx.is_header, false) AND trim(text, ' ') <> '')
SELECT seg_key, CAST(instr(text, v) - 1 AS INT) AS start_pos, CAST(instr(text, v) - 1 + length(v) AS INT) AS end_pos, category, '확실' AS grade, '표 머리글 ' || chr(39) || trim(table_ctx.header_text, ' ') || chr(39) AS note, v AS value FROM c
WHERE category IS NOT NULL AND category NOT IN ('title', 'phone', 'email') AND length(v) >= 2 AND NOT {_PSEUDO.format('v')} AND (category <> 'person' OR {_LATIN.format('v')} OR regexp_full_match(v, '[가-힣]{{2,5}}')) AND {_HELD.format('instr(text, v) - 1', 'instr(text, v) - 1 + length(v)')}""",
    "l2_labels": rf"""WITH {_LABELLED} SELECT DISTINCT doc_id, seg_id, category, value FROM labelled""",
    "l2_registry": rf"""WITH {_NAMES}, one AS (SELECT doc_id, category, value, min(struct_pack(part := part, ord := ord, seg_id := seg_id)) AS w FROM names GROUP BY ALL)
SELECT doc_id, category, value, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY w.part, w.ord, w.seg_id, category, value) AS INT) AS nth FROM one""",
    "l2_row_attributes": rf"""WITH {_SEG}, {_HEADS}, c AS (SELECT *, trim(text, ' ') AS v, {_HEAD_OF.replace('{0}', 'table_ctx.header_text')} AS category FROM seg WHERE table_ctx IS NOT NULL AND NOT coalesce(table_ctx.is_header, false) AND table_ctx.header_axis = 'col'),
l AS (SELECT doc_id, part, table_ctx.table_id AS table_id, table_ctx.row_no AS row_no, category, arg_max(v, struct_pack(o := ord, v := v)) AS v FROM c WHERE category IS NOT NULL AND v <> '' GROUP BY ALL)
SELECT doc_id, part, table_id, row_no, string_agg(category || '=' || v, ';' ORDER BY category) AS attributes FROM l GROUP BY ALL""",
    "l2_propagate": rf"""WITH RECURSIVE {_NAMES}, reg AS (SELECT DISTINCT doc_id, category, value FROM names),
form AS (SELECT doc_id, category, value, unnest(list_distinct(list_concat([value], CASE WHEN category = 'org' AND length(trim(regexp_replace(value, '[(（\[].*$', ''), ' ')) >= 2 THEN [trim(regexp_replace(value, '[(（\[].*$', ''), ' ')]
  WHEN category = 'person' AND regexp_full_match(value, '[가-힣]{{3,}}') THEN list_transform(['*', '○', 'O', '●'], lambda m: left(value, 1) || repeat(m, length(value) - 2) || right(value, 1)) ELSE [] END))) AS variant FROM reg),
met AS (SELECT seg.seg_key, seg.text, f.* FROM seg JOIN form f ON seg.doc_id = f.doc_id AND contains(seg.text, f.variant) WHERE length(f.variant) >= 2 AND NOT coalesce(seg.table_ctx.is_header, false)),
pos AS (SELECT *, unnest(range(1, length(text) - length(variant) + 2)) AS i FROM met),
hit AS (SELECT seg_key, category, value, variant, i - 1 AS s, i - 1 + length(variant) AS e FROM pos WHERE substr(text, i, length(variant)) = variant
  AND NOT (i > 1 AND regexp_matches(substr(text, i - 1, 1), '[가-힣]') AND regexp_matches(left(variant, 1), '[가-힣]')) AND regexp_matches(substr(text, i + length(variant), 8), '^($|[^가-힣]|{_FOLLOW})')),
rank AS (SELECT *, row_number() OVER (PARTITION BY seg_key ORDER BY length(variant) DESC, variant, category, s) AS r FROM hit),
took AS (SELECT seg_key, r, [struct_pack(s := s, e := e)] AS done, true AS mine FROM rank WHERE r = 1
  UNION ALL SELECT k.seg_key, k.r, CASE WHEN len(list_filter(t.done, lambda x: x.s < k.e AND k.s < x.e)) = 0 THEN list_append(t.done, struct_pack(s := k.s, e := k.e)) ELSE t.done END, len(list_filter(t.done, lambda x: x.s < k.e AND k.s < x.e)) = 0 FROM took t JOIN rank k ON k.seg_key = t.seg_key AND k.r = t.r + 1)
SELECT seg_key, category, value, CAST(s AS INT) AS start_pos, CAST(e AS INT) AS end_pos FROM rank JOIN took USING (seg_key, r) WHERE mine""",
    "l3_unique_surnames": rf"""WITH {_NAMES}, p AS (SELECT DISTINCT doc_id, value, regexp_extract(value, '^(({_S2}).|[{SURNAMES}])') AS h FROM names WHERE category = 'person'),
q AS (SELECT doc_id, value, CASE WHEN regexp_matches(h, '^({_S2}).') THEN left(h, 2) ELSE left(h, 1) END AS surname FROM p WHERE h <> '')
SELECT doc_id, surname, min(value) AS value FROM q WHERE length(value) > length(surname) GROUP BY ALL HAVING count(*) = 1""",
    "rul_rules": rf"""WITH {RUNS}, deny(v, c) AS (VALUES ('담당자', 'confidential'), ('협약', 'confidential'), ('Institute', 'org')),
d AS (SELECT seg_key, text, v, c, unnest(range(1, length(text) - length(v) + 2)) AS i FROM txt JOIN deny ON contains(text, v)),
money AS (SELECT seg_key, text, unnest(range(1, length(text) + 1)) AS i FROM txt WHERE regexp_matches(text, '예산|연구비|사업비|인건비')),
cash AS (SELECT seg_key, i - 1 AS s, regexp_extract(substr(text, i), '^\p{{Nd}}{{1,3}}(,\p{{Nd}}{{3}})+\s*(천원|만원|백만원|억원|원)') AS v FROM money WHERE regexp_matches(substr(text, i, 1), '\p{{Nd}}') AND NOT (i > 1 AND regexp_matches(substr(text, i - 1, 1), '\p{{Nd}}'))),
ask AS (SELECT seg_key, text, regexp_extract(text, '과제\s*번호\s*[:：]\s*([A-Za-z0-9\-]{{6,}})', 0) AS m, regexp_extract(text, '과제\s*번호\s*[:：]\s*([A-Za-z0-9\-]{{6,}})', 1) AS v FROM txt)
{rule_rows()}""",
    "pln_apply": f"""WITH RECURSIVE {_SEG}, {_ISSUED}, {_SPLICE.format('pseudonym')} SELECT seg_key, rewritten FROM spliced""",
    "rst_restore": f"""WITH RECURSIVE {_SEG}, {_ISSUED}, {_SPLICE.format('original')} SELECT seg_key, rewritten AS restored FROM spliced""",
    "psn_continue": f"""WITH {_MAP}, {_ISSUED}, old AS (SELECT category, max(idx) + 1 AS top FROM m WHERE idx IS NOT NULL GROUP BY category),
n AS (SELECT i.category, i.map_key, i.original, i.n_used, row_number() OVER (PARTITION BY i.category ORDER BY i.idx) - 1 + coalesce(old.top, 0) AS idx FROM issued i LEFT JOIN old USING (category) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.idx IS NOT NULL AND m.category = i.category AND m.map_key = i.map_key))
SELECT category, map_key, original, CAST(idx AS BIGINT) AS idx, {_NAMED} AS pseudonym, n_used FROM n""",
    "src_chunks": f"""WITH RECURSIVE {_SEG}, s AS (SELECT doc_id, seg_id, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord, seg_id) AS i FROM seg WHERE length(text) > 0 AND NOT coalesce(table_ctx.is_header, false)),
c AS (SELECT doc_id, seg_id, i, n AS total, CAST(0 AS BIGINT) AS chunk FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.seg_id, s.i, CASE WHEN c.total + s.n > 500 THEN s.n ELSE c.total + s.n END, c.chunk + CASE WHEN c.total + s.n > 500 THEN 1 ELSE 0 END FROM c JOIN s ON s.doc_id IS NOT DISTINCT FROM c.doc_id AND s.i = c.i + 1)
SELECT doc_id, seg_id, chunk FROM c""",
    "ver_leaks": rf"""WITH {_SEG}, {_MAP}, o AS (SELECT DISTINCT original, nfc_normalize(original) AS c, regexp_replace({_WIDE.format('original')}, '[^0-9]', '', 'g') AS d FROM m WHERE length(original) >= 2),
t AS (SELECT seg_key, text, nfc_normalize(text) AS c, regexp_replace({_WIDE.format('text')}, '[^0-9]', '', 'g') AS d, regexp_replace(nfc_normalize(text), '[\s\p{{Z}}·]', '', 'g') AS k, length(text) > 200 AND contains(text, ' ') AND NOT regexp_matches(text, '[가-힣]') AS far FROM seg WHERE length(text) >= 2)
SELECT seg_key, original FROM t JOIN o ON contains(t.text, o.original) OR contains(t.c, o.c) OR (NOT far AND length(o.d) >= 7 AND contains(t.d, o.d))
  OR (NOT far AND o.d = '' AND length(o.c) >= 3 AND contains(t.k, regexp_replace(o.c, '[\s\p{{Z}}·]', '', 'g')) AND regexp_matches(t.c, array_to_string(list_transform(string_split(o.c, ''), lambda x: '[' || x || ']'), '[\s\p{{Z}}·]*')))""",
    "rpt_masked": f"""WITH {_MAP}, v AS (SELECT rec_id, category, trim(original, ' ') AS v, regexp_replace({_WIDE.format("trim(original, ' ')")}, '[^0-9]', '', 'g') AS d FROM m WHERE original IS NOT NULL) SELECT rec_id, {_MASKED} AS masked FROM v""",
    "pln_mask": f"""WITH {_FIND} SELECT finding_id, repeat('*', end_pos - start_pos) AS replacement FROM f WHERE end_pos > start_pos AND grade = '확실'""",
    "ver_context_risk": rf"""WITH {_SEG}, w AS (SELECT *, regexp_replace(text, '\s+', '', 'g') AS t FROM seg),
h AS (SELECT *, CASE WHEN regexp_matches(t, '(국내|세계)(유일|최초|최대)|유일(한|하게)?(기관|대학|기업|보유)|단독(보유|수행|운영)|국내에서(유일|처음)') THEN 'context-unique'
  WHEN regexp_matches(text, '(^|[^0-9])[1-9]\s*명\s*의?\s*(연구원|참여|전담|박사|교수)') THEN 'context-small-cohort' END AS code FROM w),
n AS (SELECT doc_id, seg_id, part, code, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, seg_id) AS INT) AS nth FROM h WHERE code IS NOT NULL)
SELECT * FROM n WHERE nth <= 20 UNION ALL SELECT doc_id, NULL, NULL, 'context-truncated', 21 FROM n WHERE nth = 20""",
    "grd_documents": f"WITH {_GUARD} SELECT * FROM out",
    "grd_run": f"WITH {_GUARD} SELECT level, count(*) AS n_docs, CAST(sum(total) AS BIGINT) AS n_findings FROM out GROUP BY level",
    "rpt_by_category": f"""WITH {_FIND} SELECT category, count(*) FILTER (WHERE grade = '확실') AS certain, count(*) FILTER (WHERE grade = '추정') AS likely, count(*) FILTER (WHERE grade = '검토') AS review, count(*) AS total FROM f WHERE category IS NOT NULL GROUP BY category""",
}
ORACLE |= L1
# The same SQL over the invented rows.
ORACLE |= {"fx_" + name.removeprefix("l1_"): text.replace(SEG, fixtures.sql()) for name, text in L1.items()}
ORACLE |= {"fx_context_risk": ORACLE["ver_context_risk"].replace(_SEG, fixtures.sql()), "fx_references": ORACLE["l3_references"].replace(_SEG, fixtures.sql())}
_TRUST = "coalesce(list_min(list_transform({0}, lambda d: CASE d WHEN 'rule' THEN 0 WHEN 'L1' THEN 1 WHEN 'L2' THEN 2 WHEN 'L3' THEN 3 WHEN 'L4' THEN 4 ELSE 9 END)), 9)"
_BOTH = "list_sort(list_distinct(list_concat(c.dets, f.dets)))"
_MERGE = f"""CASE WHEN c.s = f.s AND c.e = f.e THEN struct_pack(s := c.s, e := c.e, cat := CASE WHEN f.r < c.r THEN f.cat ELSE c.cat END, grade := CASE WHEN f.grade = '확실' THEN f.grade ELSE c.grade END, dets := {_BOTH}, r := least(c.r, f.r), note := CASE WHEN f.r < c.r THEN f.note ELSE c.note END)
WHEN c.s <= f.s AND f.e <= c.e THEN struct_pack(s := c.s, e := c.e, cat := c.cat, grade := c.grade, dets := {_BOTH}, r := least(c.r, f.r), note := c.note)
WHEN f.s <= c.s AND c.e <= f.e THEN struct_pack(s := f.s, e := f.e, cat := f.cat, grade := f.grade, dets := {_BOTH}, r := least(c.r, f.r), note := f.note)
ELSE struct_pack(s := least(c.s, f.s), e := greatest(c.e, f.e), cat := CASE WHEN f.r < c.r THEN f.cat ELSE c.cat END, grade := c.grade, dets := {_BOTH}, r := least(c.r, f.r), note := CASE WHEN c.note = '' THEN '중첩 병합' ELSE c.note || ' / 중첩 병합' END) END"""
ORACLE |= {
    "mrg_recorded": f"""WITH RECURSIVE f0 AS (SELECT DISTINCT ON (finding_id) finding_id, doc_id, seg_id, start_pos AS s, end_pos AS e, lower(category) AS cat, grade, list_sort(list_distinct(coalesce(detectors, []))) AS dets FROM findings WHERE start_pos >= 0 AND end_pos > start_pos),
f1 AS (SELECT doc_id, seg_id, struct_pack(s := s, e := e, cat := cat, grade := grade, dets := dets, r := {_TRUST.format('dets')}, note := '') AS f, row_number() OVER (PARTITION BY doc_id, seg_id ORDER BY s, s - e, {_TRUST.format('dets')}, finding_id) AS n FROM f0),
go AS (SELECT doc_id, seg_id, n, [f] AS l FROM f1 WHERE n = 1
  UNION ALL SELECT x.doc_id, x.seg_id, x.n, CASE WHEN x.place IS NULL THEN list_append(x.l, x.f) ELSE list_transform(range(1, len(x.l) + 1), lambda i: CASE WHEN i <> x.place THEN x.l[i] ELSE {_MERGE.replace('c.', 'x.l[i].').replace('f.', 'x.f.')} END) END
  FROM (SELECT b.doc_id, b.seg_id, b.n, b.f, g.l, list_filter(range(1, len(g.l) + 1), lambda i: b.f.s < g.l[i].e AND g.l[i].s < b.f.e)[1] AS place FROM go g JOIN f1 b ON b.doc_id IS NOT DISTINCT FROM g.doc_id AND b.seg_id IS NOT DISTINCT FROM g.seg_id AND b.n = g.n + 1) x),
last AS (SELECT doc_id, seg_id, unnest(arg_max(l, n)) AS c FROM go GROUP BY doc_id, seg_id)
SELECT doc_id, seg_id, CAST(c.s AS INT) AS start_pos, CAST(c.e AS INT) AS end_pos, c.cat AS category, c.grade AS grade, array_to_string(c.dets, ',') AS detectors, c.note AS note FROM last""",
    "src_markdown_cells": r"""WITH d AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS i FROM d),
f AS (SELECT *, regexp_matches(line, '^\s*\|.*\|\s*$') AS row_, regexp_matches(line, '^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$') AS rule_ FROM l), g AS (SELECT *, row_ AND NOT rule_ AND coalesce(lead(rule_) OVER w, false) AS opens FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT *, max(CASE WHEN opens THEN i END) OVER w AS o, max(CASE WHEN NOT row_ THEN i END) OVER w AS b, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS t FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, o ORDER BY i) - 1 AS r FROM h WHERE o > coalesce(b, -1) AND NOT rule_),
c AS (SELECT *, string_split(regexp_replace(regexp_replace(line, '^\s*\|', ''), '\|\s*$', ''), '|') AS cs FROM k), e AS (SELECT doc_id, i, t, r, o, unnest(cs) AS text, generate_subscripts(cs, 1) - 1 AS col FROM c)
SELECT e.doc_id, printf('L%05dC%02d', e.i + 1, e.col) AS seg_id, CAST(e.t AS INT) AS table_no, CAST(e.r AS INT) AS row_no, CAST(e.col AS INT) AS col_no, CASE WHEN e.r = 0 THEN '' ELSE trim(coalesce(c.cs[e.col + 1], ''), ' ') END AS header_text, e.r = 0 AS is_header, e.text
FROM e JOIN c ON c.doc_id = e.doc_id AND c.i = e.o""",
    "l3_short_universities": rf"""WITH {_NAMES}, body AS (SELECT seg_key, doc_id, text FROM seg WHERE trim(text, ' ') <> '' AND NOT coalesce(table_ctx.is_header, false)),
stem AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^가-힣])([가-힣]{{2,8}})대학교', 1)) AS value FROM body UNION SELECT doc_id, regexp_extract(value, '^([가-힣]{{2,8}})대학교$', 1) FROM names WHERE category = 'org'),
pos AS (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM body WHERE contains(text, '대')),
hit AS (SELECT seg_key, doc_id, i - 1 AS s, regexp_extract(substr(text, i), '^([가-힣]{{2,8}}?)대(?:[^학]|$)', 1) AS value FROM pos WHERE i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[가-힣]'))
SELECT seg_key, CAST(s AS INT) AS start_pos, CAST(s + length(value) + 1 AS INT) AS end_pos, value FROM hit WHERE value <> '' AND EXISTS (SELECT 1 FROM stem WHERE stem.doc_id = hit.doc_id AND stem.value = hit.value)""",
    "grd_packages": f"""WITH {_FIND}, g AS (SELECT doc_id, count(*) AS total, max({_RANK}) AS r FROM f GROUP BY doc_id), docs AS (SELECT doc_id, bool_and(len(coalesce(parse_errors, [])) = 0 OR parse_errors[1].reason IS NULL) AS checked FROM hwpx_docs GROUP BY doc_id)
SELECT docs.doc_id, coalesce(total, 0) AS total, checked, {_LEVEL.format('r')} AS level FROM docs LEFT JOIN g USING (doc_id)""",
    "rpt_samples": f"""WITH {_FIND}, v AS (SELECT category, trim(text, ' ') AS v, regexp_replace({_WIDE.format("trim(text, ' ')")}, '[^0-9]', '', 'g') AS d, doc_id, seg_id, finding_id FROM f WHERE category IS NOT NULL AND trim(text, ' ') <> ''),
k AS (SELECT category, {_MASKED} AS sample, min(struct_pack(a := doc_id, b := seg_id, c := finding_id)) AS o FROM v GROUP BY 1, 2),
n AS (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY o.a, o.b, o.c, sample) AS INT) AS rank, sample FROM k) SELECT * FROM n WHERE rank <= 3""",
    "rul_terms": f"WITH {_SEG}, t(term) AS (VALUES ('연구원'), ('과제번호'), ('Research'), ('010-'), ('센터')) SELECT DISTINCT seg_key, term FROM seg JOIN t ON contains(seg.text, t.term)",
    "p1_segment_tables": f"WITH {_SEG} SELECT doc_id, part, table_ctx.table_id AS table_id, count(*) AS n_cells, max(table_ctx.row_no) AS last_row, max(table_ctx.col_no) AS last_col FROM seg WHERE table_ctx IS NOT NULL GROUP BY ALL",
}
