"""Detection over whole documents: one Arrow pass per segment, small joins for what only the document knows, one fold.

1. :func:`scanned` reads every segment once and keeps what its text says alone: candidates of the user's rules, of value
   detectors, of cells under a header, of names and organisations; names for the document's registry; family names with
   a title; short forms of universities.
2. What the document decides travels as narrow rows: registered names meet segments on (document, two characters), family
   names on (document, family name), stems on (document, stem). A segment's text is never copied to meet a name. Rows of
   one document are spread over :data:`SALTS` parts, the names of the other side repeated for each, so a document that
   holds a third of all segments is not one task.
3. :func:`detected` puts the candidates of each segment together in the order of the detectors and folds them.

Defined results: null and blank texts have no findings. Repeated segments are the caller's to remove. A segment without a
document id gets what its own text says, and no more. Header cells give no names, only values. After the line that opens a document's list of
references no person is taken.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import Config
from veilframe.operators import context, merge, rules, values
from veilframe.operators.detectors import editable
from veilframe.operators.structure import variants
from veilframe.session import ensure_checkpoint_dir, unsized

SALTS = 32
LAYERS = ("rule", "L1", "L2", "L3")
_CANDIDATE = "array<struct<start_pos:int,end_pos:int,category:string,grade:string,note:string,detector:string>>"
_ARROW_CANDIDATE = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("category", pa.string()), ("grade", pa.string()), ("note", pa.string()), ("detector", pa.string())]))
_KEYS = "seg_key long, doc_id string, seg_id string, part string, ord int, text string"
_SCAN = f"{_KEYS}, is_header boolean, found {_CANDIDATE}, names array<struct<category:string,value:string>>, surnames array<struct<start_pos:int,end_pos:int,surname:string>>, stems array<string>, shorts array<struct<start_pos:int,end_pos:int,stem:string>>, opens boolean"


def _dicts(found: list, detector: str) -> list[dict]:
    return [{"start_pos": a, "end_pos": b, "category": c, "grade": g, "note": n, "detector": detector} for a, b, c, g, n in found]


def scan_text(text: str, header: str | None, is_header: bool, config: Config, layers: tuple[str, ...], as_of: dt.date) -> dict:
    """What one text says alone."""
    found: list[dict] = []
    if "rule" in layers:
        found += _dicts(rules.find(text, config), "rule")
    if "L1" in layers:
        found += _dicts(values.find(text, header, as_of=as_of), "L1")
    if "L2" in layers:
        found += _dicts(context.cell(text, header, is_header), "L2")
    out: dict = {"found": found, "names": context.harvest(text, header, is_header) if "L2" in layers else [], "surnames": [], "stems": [], "shorts": [], "opens": context.opens_references(text)}
    if "L3" in layers and not is_header:
        orgs = context.organisations(text)
        # a department comes before an organisation of the same span
        named = [x for o in orgs for x in (o, *context.departments(text, o[1]))]
        found += _dicts(context.people(text), "L3") + _dicts(named, "L3")
        out |= {"surnames": context.surname_titles(text), "stems": context.universities(text), "shorts": context.short_universities(text)}
    return out


def scanned(segments: DataFrame, config: Config = Config(), layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """Rows of :data:`_SCAN` for segments (seg_key, doc_id, seg_id, part, ord, text, table_ctx, pieces)."""
    as_of = dt.date.fromisoformat(config.as_of)
    names, pair = pa.list_(pa.struct([("category", pa.string()), ("value", pa.string())])), lambda k: pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), (k, pa.string())]))
    kinds = {"found": _ARROW_CANDIDATE, "names": names, "surnames": pair("surname"), "stems": pa.list_(pa.string()), "shorts": pair("stem"), "opens": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t, h, bool(x), config, layers, as_of) for t, h, x in zip(*(batch.column(i).to_pylist() for i in (5, 7, 6)), strict=True)]
            named = {
                "found": [r["found"] for r in rows], "names": [[{"category": c, "value": v} for c, v in r["names"]] for r in rows],
                "surnames": [[{"start_pos": a, "end_pos": b, "surname": s} for a, b, s in r["surnames"]] for r in rows], "stems": [r["stems"] for r in rows],
                "shorts": [[{"start_pos": a, "end_pos": b, "stem": s} for a, b, s in r["shorts"]] for r in rows], "opens": [r["opens"] for r in rows],
            }
            cols = [*batch.columns[:7], *(pa.array(named[k], t) for k, t in kinds.items())]
            yield pa.RecordBatch.from_arrays(cols, names=_SCAN_NAMES)

    c = F.col("table_ctx")
    src = segments.filter(F.trim("text") != "").select(
        F.col("seg_key").cast("long").alias("seg_key"), "doc_id", "seg_id", "part", F.col("ord").cast("int").alias("ord"), "text", F.coalesce(c["is_header"], F.lit(False)).alias("is_header"), c["header_text"].alias("header"), "pieces"
    )
    out = src.drop("pieces").mapInArrow(run, _SCAN)
    held = src.filter(F.exists("pieces", lambda p: ~F.coalesce(p["editable"], F.lit(True)) & ~F.coalesce(p["soft"], F.lit(False)))).select(F.col("seg_key").alias("_k"), "pieces")
    # Few segments hold pieces that must not be touched; only they are looked at again.
    both = out.join(unsized(held), out["seg_key"] == held["_k"], "left")
    return both.withColumn("found", F.when(F.col("_k").isNull(), F.col("found")).otherwise(F.filter("found", lambda f: editable(F.col("pieces"), f["start_pos"], f["end_pos"])))).drop("_k", "pieces")


_SCAN_NAMES = ["seg_key", "doc_id", "seg_id", "part", "ord", "text", "is_header", "found", "names", "surnames", "stems", "shorts", "opens"]


def with_salt(rows: DataFrame, by: str = "seg_key") -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def salted(rows: DataFrame, known: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` (with seg_key) joined with ``known`` on keys, the rows of a hot key spread over :data:`SALTS` parts."""
    return with_salt(rows).join(unsized(known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))), [*keys, "_salt"], how).drop("_salt")


def registry(scan: DataFrame) -> DataFrame:
    """Rows (doc_id, category, value): each document's registered names, once."""
    return scan.select("doc_id", F.explode("names").alias("n")).select("doc_id", "n.category", "n.value").distinct()


def pairs_of(text: Column, n: int = 2) -> Column:
    """Distinct stretches of ``n`` characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, n)))


_HIT = "array<struct<start_pos:int,end_pos:int,category:string,grade:string,note:string,detector:string,value:string>>"
_ARROW_HIT = pa.list_(pa.struct([*list(_ARROW_CANDIDATE.value_type), ("value", pa.string())]))


def _matched(scan: DataFrame, known: DataFrame, judge, schema: str, columns: list[pa.DataType]) -> DataFrame:
    """``judge(text, is_header, [values])`` for each segment and the known values of its document that may stand in it.

    ``known`` has doc_id, _g (two characters) and v (a struct).
    """
    grams = scan.select("seg_key", "doc_id", F.explode(pairs_of(F.col("text"))).alias("_g"))
    per = salted(grams, known, ["doc_id", "_g"]).groupBy("seg_key").agg(F.collect_set("v").alias("vs"))
    src = scan.select("seg_key", "doc_id", "text", "is_header").join(unsized(per), "seg_key")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [judge(t, h, vs) for t, h, vs in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            cols = [batch.column(0), batch.column(1), *(pa.array([r[i] for r in results], k) for i, k in enumerate(columns))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)


def propagate(text: str, is_header: bool, known: list[dict]) -> list[dict]:
    """Registered names in a text: the longest first, then by value; whole words, not in header cells."""
    if is_header:
        return []
    taken: list[tuple[int, int]] = []
    out = []
    for v in sorted(known, key=lambda x: (-len(x["variant"]), x["variant"], x["category"])):
        at = text.find(v["variant"])
        while at >= 0:
            end = at + len(v["variant"])
            if all(end <= a or b <= at for a, b in taken) and context.is_word(text, at, end):
                taken.append((at, end))
                out.append({"start_pos": at, "end_pos": end, "category": v["category"], "grade": context.CERTAIN, "note": context.NOTE_PROPAGATED, "detector": "L2", "value": v["value"]})
            at = text.find(v["variant"], at + 1)
    return out


def propagated(scan: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (seg_key, doc_id, hits): registered names and their variants wherever they stand in their document."""
    v = names.select("doc_id", "category", "value", F.explode(variants(F.col("category"), F.col("value"))).alias("variant")).filter("length(variant) >= 2")
    known = v.select("doc_id", F.left("variant", F.lit(2)).alias("_g"), F.struct("category", "value", "variant").alias("v")).distinct()
    return _matched(scan, known, lambda t, h, vs: (propagate(t, h, vs),), f"seg_key long, doc_id string, hits {_HIT}", [_ARROW_HIT])


def unique_surnames(names: DataFrame) -> DataFrame:
    """Rows (doc_id, surname, value, n): a document's people by family name; value is the one person if n is 1."""
    people = names.filter("category = 'person'").select("doc_id", "value").distinct().withColumn("surname", _surname(F.col("value"))).filter("surname <> '' and length(value) > length(surname)")
    return people.groupBy("doc_id", "surname").agg(F.min("value").alias("value"), F.count("*").alias("n"))


def _surname(name: Column) -> Column:
    from veilframe.functions.lexicon import SURNAMES, SURNAMES_2, alternation

    return F.regexp_extract(name, f"^(?:({alternation(SURNAMES_2)}).|([{SURNAMES}]))", 0).substr(F.lit(1), F.when(name.rlike(f"^(?:{alternation(SURNAMES_2)})."), 2).otherwise(1))


def surname_hits(scan: DataFrame, names: DataFrame, local: DataFrame) -> DataFrame:
    """Rows (seg_key, hit): family names with a title, linked to the one registered or local person they can mean."""
    found = scan.select("seg_key", "doc_id", F.explode("surnames").alias("s")).select("seg_key", "doc_id", "s.*")
    known = unique_surnames(names).select("doc_id", "surname", "value", "n", F.lit(None).cast("string").alias("l_value"), F.lit(None).cast("long").alias("m"))
    near = unique_surnames(local).select("doc_id", "surname", F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("n"), F.col("value").alias("l_value"), F.col("n").alias("m"))
    both = known.unionByName(near).groupBy("doc_id", "surname").agg(F.max("value").alias("value"), F.max("n").alias("n"), F.max("l_value").alias("l_value"), F.max("m").alias("m"))
    met = salted(found, both, ["doc_id", "surname"], "left")
    from veilframe.functions.lexicon import UNSURE_SURNAMES

    linked, near_one = F.coalesce(F.col("n") == 1, F.lit(False)), F.coalesce(F.col("m") == 1, F.lit(False))
    met = met.filter(linked | near_one | ~F.col("surname").isin(*UNSURE_SURNAMES))
    hit = F.struct(
        "start_pos", "end_pos", F.lit("person").alias("category"), F.when(linked, context.CERTAIN).otherwise(context.LIKELY).alias("grade"),
        F.when(linked, context.NOTE_LINKED).when(near_one, context.NOTE_LOCAL).otherwise(context.NOTE_UNLINKED).alias("note"), F.lit("L3").alias("detector"), F.when(linked, F.col("value")).when(near_one, F.col("l_value")).alias("value"),
    )
    return met.select("seg_key", hit.alias("hit"))


def _judge_given(text: str, is_header: bool, known: list[dict]):
    hits, bad = [], []
    for v in sorted(known, key=lambda x: x["name"]):
        for at, fits in context.given_name_hits(text, v["name"]):
            if not fits:
                bad.append(v["name"])
            elif not is_header:
                hits.append({"start_pos": at, "end_pos": at + 2, "category": "person", "grade": context.LIKELY, "note": context.NOTE_GIVEN, "detector": "L3", "value": v["name"]})
    return hits, bad


def given_hits(scan: DataFrame, people: DataFrame) -> DataFrame:
    """Rows (seg_key, hit): people of a document called by their given name, if every place of it in the document can be explained."""
    named = people.filter(F.col("value").rlike("^[가-힣]{3,4}$")).withColumn("s", _surname(F.col("value"))).filter("s <> '' and length(value) - length(s) = 2")
    known = named.select("doc_id", F.right("value", F.lit(2)).alias("_g"), F.struct(F.col("value").alias("name")).alias("v")).distinct()
    ensure_checkpoint_dir(scan.sparkSession)
    met = _matched(scan, known, _judge_given, f"seg_key long, doc_id string, hits {_HIT}, bad array<string>", [_ARROW_HIT, pa.list_(pa.string())]).checkpoint()
    bad = met.select("doc_id", F.explode("bad").alias("name")).distinct()
    hits = met.select("seg_key", "doc_id", F.explode("hits").alias("hit")).withColumn("name", F.col("hit.value"))
    return salted(hits, bad, ["doc_id", "name"], "left_anti").select("seg_key", "hit")


def short_university_hits(scan: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (seg_key, hit): a university of the document by its stem and 대 alone."""
    registered = names.filter("category = 'org'").select("doc_id", F.regexp_extract("value", f"^([가-힣]{{2,8}}){context.UNIVERSITY}$", 1).alias("stem")).filter("stem <> ''")
    stems = scan.select("doc_id", F.explode("stems").alias("stem")).unionByName(registered).distinct()
    found = scan.select("seg_key", "doc_id", F.explode("shorts").alias("s")).select("seg_key", "doc_id", "s.*")
    hit = F.struct("start_pos", "end_pos", F.lit("org").alias("category"), F.lit(context.LIKELY).alias("grade"), F.lit(context.NOTE_STEM).alias("note"), F.lit("L3").alias("detector"), F.col("stem").alias("value"))
    return salted(found, stems, ["doc_id", "stem"], "left_semi").select("seg_key", hit.alias("hit"))


def in_references(scan: DataFrame) -> DataFrame:
    """Rows (seg_key): segments at or after the line that opens their document's list of references."""
    first = scan.filter("opens").groupBy("doc_id").agg(F.min("ord").alias("_from"))
    return salted(scan.select("seg_key", "doc_id", "ord"), first, ["doc_id"]).filter("ord >= _from").select("seg_key")


def put_together(text: str, found: list[dict], extra: list[dict], skip_people: bool) -> list[dict]:
    """A segment's candidates in the order of the detectors; people claim their place in the order of their clues."""
    hit = lambda note: sorted((e for e in extra if e["note"] in note), key=lambda x: (x["start_pos"], x["end_pos"]))
    of = lambda d, c=None: [f for f in found if f["detector"] == d and (c is None or (f["category"] == "person") == c)]
    out = of("rule") + of("L1") + of("L2")
    spread = hit((context.NOTE_PROPAGATED,))
    out += sorted(spread, key=lambda x: (-(x["end_pos"] - x["start_pos"]), x["start_pos"]))
    if not skip_people:
        claimed: list[dict] = []
        for group in (of("L3", True), hit((context.NOTE_LINKED, context.NOTE_LOCAL, context.NOTE_UNLINKED)), hit((context.NOTE_GIVEN,))):
            for f in group:
                if all(f["end_pos"] <= c["start_pos"] or c["end_pos"] <= f["start_pos"] for c in claimed):
                    claimed.append(f)
        out += claimed
    out += of("L3", False) + hit((context.NOTE_STEM,))
    for o in spread:
        if o["category"] == "org":
            out += _dicts(context.departments(text, o["end_pos"]), "L3")
    return out


_FINDING = "seg_key long, doc_id string, seg_id string, part string, start_pos int, end_pos int, category string, grade string, detectors array<string>, note string, value string"


def detected(segments: DataFrame, config: Config = Config(), layers: tuple[str, ...] = LAYERS, more: tuple = ()) -> DataFrame:
    """Rows of :data:`_FINDING`: the findings of every segment, all layers merged.

    ``more`` are further detectors: functions of the scanned segments that give rows (seg_key, hit).
    """
    ensure_checkpoint_dir(segments.sparkSession)
    scan = scanned(segments, config, layers).checkpoint()
    extras = []
    if "L2" in layers:
        names = registry(scan).checkpoint()
        extras.append(propagated(scan, names).select("seg_key", F.explode("hits").alias("hit")))
        if "L3" in layers:
            local = scan.select("doc_id", F.explode(F.filter("found", lambda f: (f["detector"] == "L3") & (f["category"] == "person"))).alias("f"), "text")
            local = local.select("doc_id", F.lit("person").alias("category"), F.substring("text", F.col("f.start_pos") + 1, F.col("f.end_pos") - F.col("f.start_pos")).alias("value")).distinct().checkpoint()
            people = names.filter("category = 'person'").select("doc_id", "value").unionByName(local.select("doc_id", "value")).distinct()
            extras += [surname_hits(scan, names, local), given_hits(scan, people), short_university_hits(scan, names)]
    extras += [f(scan) for f in more]
    marks = in_references(scan).select("seg_key", F.lit(None).cast(_HIT[len("array<") : -1]).alias("hit")) if "L3" in layers else None
    every = None
    for e in (*extras, marks):
        if e is not None:
            every = e if every is None else every.unionByName(e)
    keep = scan.select("seg_key", "doc_id", "seg_id", "part", "text", "found")
    if every is None:
        both = keep.filter(F.size("found") > 0).withColumns({"extra": F.array().cast(_HIT), "skip": F.lit(False)})
    else:
        per = every.groupBy("seg_key").agg(F.collect_list("hit").alias("extra"), F.bool_or(F.col("hit").isNull()).alias("skip"))
        both = keep.join(unsized(per), "seg_key", "left").filter((F.size("found") > 0) | (F.size("extra") > 0)).withColumns({"extra": F.coalesce("extra", F.array().cast(_HIT)), "skip": F.coalesce("skip", F.lit(False))})
    allow, on = frozenset(config.allow), config.categories
    names_out = [x.split()[0] for x in _FINDING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (text, found, extra, skip) in enumerate(zip(*(batch.column(k).to_pylist() for k in (4, 5, 6, 7)), strict=True)):
                every = put_together(text, found, extra, skip)
                for f in merge.fold([{**f, "detectors": [f["detector"]]} for f in merge.allowed(every, text, allow, on)]):
                    at.append(i)
                    rows.append({**{k: f[k] for k in ("start_pos", "end_pos", "category", "grade", "detectors", "note")}, "value": text[f["start_pos"] : f["end_pos"]]})
            own = batch.select(["seg_key", "doc_id", "seg_id", "part"]).take(pa.array(at, pa.int64()))
            new = pa.RecordBatch.from_pylist(rows, schema=merge.ARROW)
            yield pa.RecordBatch.from_arrays([*own.columns, *new.columns], names=names_out)

    return both.mapInArrow(run, _FINDING)
