"""One form for text that looks the same.

Texts are exploded to positioned code points; a broadcast join with the decomposition and look-alike mapping (a
table made by rule from the Unicode data, whose size Unicode bounds) replaces each by what it looks like; combining
marks are put in the order of their class within their run; the strings are rebuilt and recomposed. What looks the
same then is the same: full and half width, composed and combining accents, syllables and their letters, kinds of
space, hyphen, dot and quote, look-alike letters of other scripts. Invisible characters go. Case, digits, other
letters and missing spaces stay different.

Code points of ASCII and whole Hangul syllables map to themselves and take no part in any composition with one
another, so a text of these alone is its own form and is passed by without exploding it. Equal texts are exploded once.

Defined results: null gives null, an empty text and one of invisible characters only give ''. Lone surrogates cannot
occur in a Spark string. Texts of any length are exploded whole. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.lookalike import combining, mapping
from veilframe.session import ensure_checkpoint_dir

#: A text that matches may differ from its form.
MAY_CHANGE = r"[^\x00-\x7f가-힣]"


def table_of_signs(spark: SparkSession) -> DataFrame:
    """Rows (sign, parts array<struct<k,ch,ccc>>): every code point that is replaced, dropped (no parts) or a combining mark."""
    ccc = combining()
    rows = [(ch, [(k, c, ccc.get(c, 0)) for k, c in enumerate(to)]) for ch, to in mapping().items()]
    rows += [(ch, [(0, ch, c)]) for ch, c in ccc.items() if ch not in mapping()]
    return spark.createDataFrame(rows, "sign string, parts array<struct<k:int,ch:string,ccc:int>>")


def rebuilt(signs: list[str], classes: list[int]) -> str:
    """The string of signs, each run of combining marks put in the order of their class (equal classes keep their order), recomposed."""
    out, run = [], []
    for ch, ccc in zip(signs, classes, strict=True):
        if ccc:
            run.append((ccc, ch))
            continue
        if run:
            out += [c for _, c in sorted(run, key=lambda x: x[0])]
            run = []
        out.append(ch)
    out += [c for _, c in sorted(run, key=lambda x: x[0])]
    return unicodedata.normalize("NFC", "".join(out))


@F.pandas_udf(T.StringType())
def _rebuild(signs: pd.Series, classes: pd.Series) -> pd.Series:
    return pd.Series([rebuilt(list(a), list(b)) for a, b in zip(signs, classes, strict=True)], dtype=object)


def forms(texts: DataFrame, text_col: str) -> DataFrame:
    """Rows (key, form) for the distinct texts that may change; key is the MD5 of the text.

    The texts are partitioned by their key once; exploding, the broadcast join and putting together again keep that
    partitioning, so code points are never shuffled.
    """
    odd = texts.select(F.col(text_col).alias("t")).filter(F.col("t").rlike(MAY_CHANGE)).select(F.unhex(F.md5("t")).alias("key"), "t")
    # A set number of partitions: few bytes of text become many code points, too many for a few coalesced tasks.
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    odd = odd.repartition(n, "key").groupBy("key").agg(F.max("t").alias("t"))
    points = odd.select("key", F.posexplode(F.regexp_extract_all("t", F.lit("(?s)."), F.lit(0))).alias("pos", "sign"))
    signs = F.broadcast(table_of_signs(texts.sparkSession))
    itself = F.array(F.struct(F.lit(0).alias("k"), F.col("sign").alias("ch"), F.lit(0).alias("ccc")))
    parts = points.join(signs, "sign", "left").select("key", "pos", F.coalesce("parts", itself).alias("p"))
    joined = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("all"))
    flat = F.flatten(F.transform("all", lambda x: x["p"]))
    return joined.select("key", flat.alias("f")).select("key", _rebuild(F.transform("f", lambda x: x["ch"]), F.transform("f", lambda x: x["ccc"])).alias("form"))


def canonical(rows: DataFrame, text_col: str, into: str) -> DataFrame:
    """``rows`` with a column ``into``: the one form of the text."""
    found = forms(rows, text_col).select(F.col("key").alias("_key"), F.col("form").alias("_form"))
    odd = F.col(text_col).rlike(MAY_CHANGE)
    keyed = rows.withColumn("_odd_key", F.when(odd, F.unhex(F.md5(text_col))))
    # Plain texts have no key; they take no part in the shuffle of the join.
    plain = keyed.filter(F.col("_odd_key").isNull()).withColumn(into, F.col(text_col)).drop("_odd_key")
    other = keyed.filter(F.col("_odd_key").isNotNull()).join(found, F.col("_odd_key") == F.col("_key")).withColumn(into, F.col("_form")).drop("_odd_key", "_key", "_form")
    return plain.unionByName(other)


#: Rows of one form are paired in slices of this many.
SLICE = 2000


def lookalike_pairs(rows: DataFrame, id_col: str, text_col: str, scope: str | None = None) -> DataFrame:
    """Rows (id_a, id_b), id_a < id_b, of texts that look the same but differ, within a ``scope`` value.

    Two plain texts that differ never look the same, so every pair has an odd text: the odd rows meet the plain rows
    whose text is their form, and one another. A form with many rows is split into slices over tasks.
    """
    base = rows.select(F.col(id_col).cast("long").alias("id"), (F.lit("") if scope is None else F.coalesce(F.col(scope), F.lit("\0null"))).alias("scope"), F.col(text_col).alias("t")).filter("t is not null")
    odd_rows = base.filter(F.col("t").rlike(MAY_CHANGE)).select("id", "scope", F.unhex(F.md5("t")).alias("key"))
    ensure_checkpoint_dir(rows.sparkSession)
    # Everything below reads these rows again.
    odd = odd_rows.join(forms(rows, text_col), "key").select("id", "scope", "form", "key").distinct().checkpoint()
    wanted = odd.select("scope", "form").distinct()
    plain = base.filter(~F.col("t").rlike(MAY_CHANGE)).join(wanted, (F.col("t") == F.col("form")) & (base["scope"] == wanted["scope"]), "left_semi")
    plain = plain.select("id", "scope", F.col("t").alias("form"), F.lit(None).cast("binary").alias("key")).distinct()
    every = odd.unionByName(plain)
    sizes = every.groupBy("scope", "form").agg(F.count("*").alias("n"))
    sizes = sizes.filter("n > 1").select("scope", "form", F.expr(f"cast(ceil(n / {SLICE}) as int)").alias("slices"))
    left = odd.join(sizes, ["scope", "form"]).select("scope", "form", F.col("id").alias("x"), F.col("key").alias("xk"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    right = every.join(sizes, ["scope", "form"]).select("scope", "form", F.col("id").alias("y"), F.col("key").alias("yk"), F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
    met = left.join(right, ["scope", "form", "slice"]).filter("yk is null or (x < y and xk <> yk)")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
