import random
import time

import numpy as np
import pyarrow as pa
import pytest

from veilframe.llm import copies


def test_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 3)):  # near copies with few or many words changed
            own = list(base)
            for _ in range(r.choice([1, 2, 12])):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += ["", None, "Two words", "two  WORDS", "one"]
    sets = [set(copies.shingles(t or "").tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sets[i] & sets[j]
            if both and len(both) >= copies.LEAST * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    docs = spark.createDataFrame([(i, "s", t, "clash") for i, t in enumerate(texts)], "doc_id long, source string, text string, bands string")
    items = spark.createDataFrame([(i, hash(" ".join((t or "").lower().split())) if t else None, copies.bands(copies.signature(copies.shingles(t or ""))), bytearray(copies.signature(copies.shingles(t or "")).tobytes())) for i, t in enumerate(texts)], "doc_id long, copy_key long, bands array<long>, sig binary")
    got = {x.doc_id: x.copy_key for x in copies.clustered(items, docs).collect()}
    assert len(got) == len(texts)
    own = [i for i, t in enumerate(texts) if t]
    assert all((got[i] == got[j]) == (label[i] == label[j]) for i in own for j in own)
    assert got[texts.index("")] is None and copies.clustered(items.limit(0), docs).count() == 0


def test_every_pair_counts(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for k in range(300):  # two words of 100 changed far from each other: 86 shingles of 106 in common, a Jaccard of 0.811
        base = [word() for _ in range(100)]
        own = list(base)
        own[30], own[60] = word(), word()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    # a hub of which all are near copies, and a chain through it
    base = [word() for _ in range(200)]
    for k in range(120):
        rows.append((1000 + k, " ".join([*base[: 2 * (k % 20)], *(word() for _ in range(2)), *base[2 * (k % 20) + 2 :]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = {i: copies.signature(copies.shingles(t)) for i, t in rows}
    items = spark.createDataFrame([(i, i + 7, copies.bands(sigs[i]), bytearray(sigs[i].tobytes())) for i, _ in rows], "doc_id long, copy_key long, bands array<long>, sig binary")
    got = {x.doc_id: x.copy_key for x in copies.clustered(items, docs).collect()}
    assert all(got[2 * k] == got[2 * k + 1] for k in range(300)) and len(set(got.values())) == 301


def made_of(rows):
    """Items and documents of rows (id, text)."""
    sigs = {i: copies.signature(copies.shingles(t)) for i, t in rows}
    return [(i, i + 7, copies.bands(sigs[i]), bytearray(sigs[i].tobytes())) for i, _ in rows], "doc_id long, copy_key long, bands array<long>, sig binary"


def test_prefixes_travel_packed(spark):
    def written():
        sc = spark.sparkContext._jsc.sc()
        time.sleep(0.5)  # the figures lag behind
        spark.range(10).count()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    r = random.Random(12)
    rows = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(150))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").localCheckpoint()
    items = spark.createDataFrame(*made_of(rows)).localCheckpoint()
    before = written()
    copies.clustered(items, docs).write.format("noop").mode("overwrite").save()
    assert written() - before < 1.2 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("words", [1 << 18, 9, 1])
def test_many_signatures_at_once(monkeypatch, words):
    monkeypatch.setattr(copies, "WORDS", words)
    r = random.Random(4)
    texts = [None, "", " ", *(" ".join(r.choice("abcde") for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 40, 300]))) for _ in range(300))]
    found, n = np.unique(np.concatenate([copies.shingles(t or "") for t in texts]), return_counts=True)
    for order in (None, (found[n > 1], n[n > 1])):
        for some in (texts, texts[:1], ["a b"], []):
            heads, prefixes = copies.signatures(some, order)
            assert [(x, y.tolist()) for x, y in zip(heads, prefixes, strict=True)] == [copies.split(copies.signature(copies.shingles(t or ""), order)) for t in some]


def test_bitmaps_lose_no_pair():
    r = random.Random(6)
    sets, pairs = [], []
    for _ in range(400):
        own = [r.getrandbits(64) for _ in range(r.choice([1, 5, 31, 32, 33, 120, 500]))]
        other = own[r.randint(0, len(own) // 8) :] + [r.getrandbits(64) for _ in range(r.randint(0, len(own) // 8))]
        sets += [own, other, [r.getrandbits(64) for _ in range(len(own))]]
    sigs = [copies.signature(np.array(sorted(s), np.uint64)).tobytes() for s in sets]
    pairs = [(i, j) for k in range(0, len(sets), 3) for i, j in ((k, k + 1), (k + 1, k), (k, k + 2))]
    got = copies.may_reach([sigs[i] for i, _ in pairs], [sigs[j] for _, j in pairs]).tolist()
    jaccard = [len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) for i, j in pairs]
    assert all(g for g, x in zip(got, jaccard, strict=True) if x >= copies.LEAST) and not all(got)
    assert copies.may_reach([], []).tolist() == []


def test_meeting_against_all_pairs():
    r = random.Random(7)
    rows = [(r.choice([-5, 3, 1 << 40]) + i, r.randint(50, 70), s, r.randint(0, 40)) for i in range(400) for s in {r.randrange(200), r.randrange(200), 1 << 31 if i % 3 else 7, (1 << 32) - 1 - i}]
    blocks = []
    for k in range(0, len(rows), 97):
        node, size, shingle, pos = (np.array(x, np.int64) for x in zip(*rows[k : k + 97], strict=True))
        blocks.append((0, int(node.min()), shingle.astype(np.uint32).tobytes(), *(copies._narrow(x).tobytes() for x in (node - node.min(), size, pos))))
    table = pa.table({c: list(x) for c, x in zip(("bucket", "base", "shingle", "node", "size", "pos"), zip(*blocks, strict=True), strict=True)})
    out = copies._meet(table).to_pylist()
    by: dict = {}
    for node, size, shingle, pos in rows:
        by.setdefault(shingle, []).append((node, size, pos))
    room = lambda x, y: min(x[1] - x[2], y[1] - y[2]) * 1.8 >= 0.8 * (x[1] + y[1]) - 1e-6
    few = {(min(x[0], y[0]), max(x[0], y[0])) for v in by.values() if len(v) <= copies.MEET for x in v for y in v if x[0] < y[0] and room(x, y)}
    many = {(node, s, size, pos) for s, v in by.items() if len(v) > copies.MEET for node, size, pos in v}
    assert {(x["a"], x["shingle"], x["size"], x["pos"]) for x in out if x["shingle"] is not None} == many and many
    got = [(x["a"], x["b"]) for x in out if x["shingle"] is None]
    assert few <= set(got) and few and len(got) == len(set(got))
    for s, v in by.items():
        if len(v) > copies.MEET:  # one of them is held against all others that leave room
            assert any({(min(x[0], y[0]), max(x[0], y[0])) for y in v if x[0] != y[0] and room(x, y)} <= set(got) for x in v), s


def test_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(copies, "HOT_LEAST", 30)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, groups = [], []
    for size in (1, 2, 29, 120, 200):  # copies of a text with two words changed in the same places
        base = [word() for _ in range(150)]
        groups.append(range(len(rows), len(rows) + size))
        for _ in range(size):
            rows.append((len(rows), " ".join([*base[:50], word(), *base[51:100], word(), *base[101:]])))
    nodes = spark.createDataFrame([(i, 100, x) for i, _, x, _ in made_of(rows)[0]], "node long, size int, bands array<long>")
    assert len(copies._hot(nodes, len(rows))[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.copy_key for x in copies.clustered(spark.createDataFrame(*made_of(rows)), docs).collect()}
    assert all(len({got[i] for i in g}) == 1 for g in groups) and len(set(got.values())) == len(groups)
