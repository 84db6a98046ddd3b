"""Scalar functions over columns: check digits, dates, keys, masks, tags. All of them built-in expressions but the normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digits(text: Column) -> Column:
    """The digits of a text, wide and circled ones as plain ones (NFKC); ASCII and Hangul stay in the JVM."""
    return F.regexp_replace(F.when(text.rlike(r"^[\x00-\x7f가-힣]*$"), text).otherwise(form("NFKC")(text)), "[^0-9]", "")


def _weighted(d: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(d, i + 1, 1).cast("int") * w
    return total


def birth_part(d: Column) -> Column:
    """yymmdd at the start of ``d`` can be a date; 29 February always can."""
    m, day = F.substring(d, 3, 2).cast("int"), F.substring(d, 5, 2).cast("int")
    longest = F.when(m == 2, 29).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return d.rlike("^[0-9]{6}") & m.between(1, 12) & (day >= 1) & (day <= longest)


def resident_check(d: Column) -> Column:
    """Check digit of a 13-digit resident number."""
    return F.when(d.rlike("^[0-9]{13}$"), F.pmod(11 - F.pmod(_weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]), F.lit(11)), F.lit(10)) == F.substring(d, 13, 1).cast("int")).otherwise(False)


def resident_shape(d: Column) -> Column:
    return d.rlike("^[0-9]{6}[1-9][0-9]{6}$") & birth_part(d)


def foreign_shape(d: Column) -> Column:
    return d.rlike("^[0-9]{6}[5-8][0-9]{6}$") & birth_part(d)


def business_check(d: Column) -> Column:
    """Check digit of a 10-digit business number."""
    total = _weighted(d, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + F.floor(F.substring(d, 9, 1).cast("int") * 5 / 10)
    return F.when(d.rlike("^[0-9]{10}$"), F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == F.substring(d, 10, 1).cast("int")).otherwise(False)


def corporate_check(d: Column) -> Column:
    """Check digit of a 13-digit corporate number."""
    return F.when(d.rlike("^[0-9]{13}$"), F.pmod(10 - F.pmod(_weighted(d, [1, 2] * 6), F.lit(10)), F.lit(10)) == F.substring(d, 13, 1).cast("int")).otherwise(False)


def luhn(d: Column) -> Column:
    return F.when(d.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", d)).otherwise(False)


def birth_date(year: Column, month: Column, day: Column, as_of: str) -> Column:
    """A real date from 1900 to ``as_of``."""
    made = F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.coalesce(made.between(F.lit("1900-01-01").cast("date"), F.lit(as_of).cast("date")), F.lit(False))


def form(kind: str):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(kind, x), na_action="ignore")

    return run


def normal_key(text: Column) -> Column:
    """NFC, without zero-width spaces and byte order marks, white space collapsed and trimmed. ASCII stays in the JVM."""
    ascii_only = text.rlike(r"^[\x00-\x7f가-힣]*$")
    nfc = F.when(ascii_only, text).otherwise(form("NFC")(text))
    return F.trim(F.regexp_replace(F.translate(nfc, "​﻿", ""), r"(?U)\s+", " "))


def mapping_key(text: Column) -> Column:
    """The key of a value in the pseudonym mapping: its digits if it has six or more and no letter, else the normal key in lower case."""
    key = normal_key(text)
    return F.when((F.length(digits(key)) >= 6) & ~key.rlike(r"\p{L}"), digits(key)).otherwise(F.lower(key))


def alpha_tag(index: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA: base 26 without a zero, for every bigint from 0 up; null gives null."""
    zero = F.struct((index.cast("long") + 1).alias("n"), F.lit("").alias("out"))
    # Fourteen letters hold every bigint. The state is carried from step to step, so no expression is nested.
    letter = lambda a: F.char(F.lit(65) + F.pmod(a["n"] - 1, F.lit(26)))
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.call_function("div", a["n"] - 1, F.lit(26)).alias("n"), F.concat(letter(a), a["out"]).alias("out"))).otherwise(a)
    return F.when(index.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(14)), zero, step, lambda a: a["out"]))


def masked(text: Column, category: Column) -> Column:
    """A value of which only as much shows as is needed to find its place again. Blank gives ''."""
    v = F.trim(text)
    n, d = F.length(v), digits(v)
    k = F.length(d)
    stars = lambda x: F.repeat(F.lit("*"), F.greatest(x, F.lit(0)).cast("int"))
    head = lambda x: F.when(F.length(x) <= 1, stars(F.greatest(F.length(x), F.lit(1)))).otherwise(F.concat(F.substring(x, 1, 1), stars(F.length(x) - 1)))
    last = lambda m: F.concat(stars(k - m), F.right(d, F.lit(m)))
    person = F.when(n <= 2, F.concat(F.substring(v, 1, 1), F.lit("*"))).otherwise(F.concat(F.substring(v, 1, 1), stars(n - 2), F.right(v, F.lit(1))))
    number = F.when(k >= 8, last(4)).when(k == 0, stars(F.greatest(n, F.lit(1)))).otherwise(stars(k))
    local, domain = F.substring_index(v, "@", 1), F.regexp_replace(v, "^[^@]*@", "")
    dot = F.instr(F.reverse(domain), ".")
    host = F.when(dot > 0, F.concat(head(F.left(domain, F.length(domain) - dot)), F.right(domain, dot))).otherwise(head(domain))
    first = F.substring_index(v, " ", 1)
    place = F.when(v.rlike(r"\S\s+\S") & first.rlike("[시도]$"), F.concat(first, F.lit(" ******"))).otherwise(head(v))
    resident = F.when(k >= 2, F.concat(F.left(d, F.lit(2)), F.lit("****-*******"))).otherwise(F.lit("******"))
    return (
        F.when(n == 0, F.lit("")).when(category == "person", person).when(category.isin("rrn", "foreign_id"), resident).when(category.isin("phone", "tel"), number)
        .when((category == "email") & F.contains(v, F.lit("@")), F.concat(head(local), F.lit("@"), host)).when(category == "card", last(4)).when(category == "account", last(3))
        .when(category == "address", place).otherwise(head(v))
    )
