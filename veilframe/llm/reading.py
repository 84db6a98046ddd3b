"""Reading level of documents.

The familiar-word formula: the share of words outside a high-frequency list, and the average length of sentences. A
document's words are those of its running prose; headings, label lines, table rows and
lines that end without a full stop are set aside. Korean words are taken without their particles. The list of a
language is its :data:`LIST_SIZE` words with the highest document frequency, counted over all documents.

On technical corpora frequent words are not easy words, so the formula also takes the mean length of words (``terms``
leaves it out). Its weights are fitted per language on the graded passages (a labelled sample of at most :data:`GRADED_LIMIT` rows):
ridge regression for the band, logistic regression for being as demanding as the upper bands.

Defined results: a document without prose, null or empty has no level and is not demanding. The language is that of
the prose's letters (Hangul or not), not the recorded one. A repeated row counts once. A language without graded
passages has no level. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.pii import skeleton
from veilframe.session import ensure_checkpoint_dir

LIST_SIZE = 300
GRADED_LIMIT = 100_000
#: Bands from this one up count as demanding.
DEMANDING = 4
# Particles and endings that follow a Korean noun.
PARTICLES = "은 는 이 가 을 를 와 과 의 도 만 로 으로 에 에서 에게 까지 부터 보다 처럼 이나 나 이라는 라는 만으로는 에서는 에는 으로부터 로부터 함에 함을 에도"
_PARTICLES = sorted(PARTICLES.split(), key=len, reverse=True)
_WORD = re.compile(r"[가-힣]+|[A-Za-zÀ-ÿ]+(?:'[a-z]+)?")
_SENTENCE = re.compile(r"(?<=[.!?。])[\"”’)\]]*\s+")
_BULLET = re.compile(r"^(?:[-*•·]|\d+[.)]|[가-하][.)])\s+")
_LABEL = re.compile(r"^[^.!?\s]{1,12}(?: [^.!?\s]{1,12}){0,2}\s?[:：](?:\s|$)")
_END = re.compile(r"[.!?。][\"”’)\]]*$")


def prose(text: str) -> list[str]:
    """The lines of running prose, without bullets."""
    out = []
    for line in skeleton(text)[0].split("\n"):
        line = line.strip()
        if not line or line[0] in "#|" or line.count("|") >= 2 or line.count("\t") >= 2 or _LABEL.match(line):
            continue
        line = _BULLET.sub("", line)
        if _END.search(line):
            out.append(line)
    return out


class Words:
    """Words of a sentence with a cache of stems; the cache only saves time."""

    def __init__(self) -> None:
        self.stems: dict[str, str] = {}

    def of(self, text: str) -> list[str]:
        stems, out = self.stems, []
        for w in _WORD.findall(text):
            s = stems.get(w)
            if s is None:
                s = w.lower()
                if "가" <= w[0] <= "힣":
                    for p in _PARTICLES:
                        if len(w) > len(p) and w.endswith(p):
                            s = w[: -len(p)]
                            break
                if len(stems) > 200_000:
                    stems.clear()
                stems[w] = s
            out.append(s)
        return out


def language(words: list[str]) -> str:
    return "ko" if 2 * sum("가" <= w[0] <= "힣" for w in words) > len(words) else "en"


def _counted(text: str | None, words: Words) -> tuple[list[str], int]:
    lines = prose(text) if text else []
    return words.of("\n".join(lines)), sum(1 for p in lines for s in _SENTENCE.split(p) if s.strip())


def counted(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, source, lang, n_sentences, words array<struct<w,n>>): the words of each document's prose, read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        kind = pa.list_(pa.struct([("w", pa.string()), ("n", pa.int32())]))
        for batch in batches:
            langs, sentences, found = [], [], []
            for text in batch.column(2).to_pylist():
                ws, n = _counted(text, words)
                langs.append(language(ws) if ws else None)
                sentences.append(n)
                found.append([{"w": w, "n": k} for w, k in Counter(ws).items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(sentences, pa.int32()), pa.array(found, kind)], names=["doc_id", "source", "lang", "n_sentences", "words"])

    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, source string, lang string, n_sentences int, words array<struct<w:string,n:int>>")


def frequent_words(of: DataFrame, size: int = LIST_SIZE) -> dict[str, set[str]]:
    """The ``size`` words of each language in the most documents, over all rows of :func:`counted`."""
    df = of.select("lang", F.explode("words.w").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # The first of each language, without gathering a language in one task: two languages and a bounded list each.
    lists: dict[str, set[str]] = {}
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(16))).orderBy(F.desc("n"), "word")
    some = df.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= size)
    final = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    for row in some.withColumn("r", F.row_number().over(final)).filter(F.col("r") <= size).select("lang", "word").collect():
        lists.setdefault(row.lang, set()).add(row.word)
    return lists


#: The terms of the formula: the named two, and the mean length of words.
NAMED, ALL = 2, 3


def features(text: str | None, lists: dict[str, set[str]], words: Words) -> tuple[str, int, int, float, float, float] | None:
    """(language, words, sentences, unfamiliar share, words a sentence, letters a word), or None without prose."""
    ws, n_sentences = _counted(text, words)
    if not ws:
        return None
    lang = language(ws)
    known = lists.get(lang, set())
    return lang, len(ws), n_sentences, sum(w not in known for w in ws) / len(ws), len(ws) / max(1, n_sentences), sum(map(len, ws)) / len(ws)


def _ridge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a = np.c_[x, np.ones(len(x))]
    return np.linalg.solve(a.T @ a + 1e-2 * np.diag([1.0] * x.shape[1] + [0.0]), a.T @ y)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    penalty = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(graded: list[tuple[int, str]], lists: dict[str, set[str]], terms: int = ALL) -> dict[str, tuple]:
    """Per language (mean, scale, weights for the band, weights for demanding) from (band, text) rows, with the first ``terms`` terms."""
    words, rows = Words(), {}
    for band, text in graded:
        f = features(text, lists, words)
        if f and band is not None:
            rows.setdefault(f[0], []).append((f[3 : 3 + terms], band))
    out = {}
    for lang, own in rows.items():
        x, y = np.array([f for f, _ in own]), np.array([b for _, b in own], dtype=float)
        mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z = (x - mean) / scale
        out[lang] = (mean, scale, _ridge(z, y), _logistic(z, (y >= DEMANDING).astype(float)))
    return out


def levels(documents: DataFrame, graded: DataFrame, list_size: int = LIST_SIZE, terms: int = ALL) -> DataFrame:
    """Rows (doc_id, source, lang, n_words, n_sentences, unfamiliar, level, demanding), one per document.

    ``level`` lies on the scale of the graded bands, from 1 to 5. ``terms`` NAMED leaves out the length of words.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    of = counted(documents).checkpoint()
    lists = frequent_words(of, list_size)
    sample = [(r.band, r.text) for r in graded.select("band", "text").orderBy("band", "text").limit(GRADED_LIMIT).collect()]
    model = fit(sample, lists, terms)

    total = lambda words, value: F.aggregate(words, F.lit(0), lambda acc, x: acc + value(x))
    unknown = lambda known: lambda x: ~x["w"].isin(*known)
    fresh, level, demanding = F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(False)
    for lang, known in sorted(lists.items()):
        if lang is not None:
            # a list of bounded length, looked up by hash
            fresh = F.when(F.col("lang") == lang, total(F.filter("words", unknown(sorted(known))), lambda x: x["n"])).otherwise(fresh)
    for lang, (mean, scale, band, line) in sorted(model.items()):
        x = [F.col("unfamiliar"), F.col("n_words") / F.greatest("n_sentences", F.lit(1)), F.col("_letters") / F.col("n_words")][:terms]
        z = [(c - float(m)) / float(s) for c, m, s in zip(x, mean, scale, strict=True)]
        sums = [sum((c * float(w) for c, w in zip(z, ws[:-1], strict=True)), F.lit(float(ws[-1]))) for ws in (band, line)]
        level = F.when(F.col("lang") == lang, F.greatest(F.lit(1.0), F.least(F.lit(5.0), sums[0]))).otherwise(level)
        demanding = F.when(F.col("lang") == lang, sums[1] > 0).otherwise(demanding)
    out = of.withColumns({"n_words": total(F.col("words"), lambda x: x["n"]), "_letters": total(F.col("words"), lambda x: x["n"] * F.length(x["w"])), "_fresh": fresh})
    out = out.withColumn("unfamiliar", F.when(F.col("n_words") > 0, F.col("_fresh") / F.col("n_words")))
    out = out.withColumns({"level": F.when(F.col("n_words") > 0, level), "demanding": F.coalesce((F.col("n_words") > 0) & demanding, F.lit(False))})
    return out.select("doc_id", "source", "lang", "n_words", "n_sentences", "unfamiliar", "level", "demanding").dropDuplicates(["doc_id"])
