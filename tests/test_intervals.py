import random
from collections import defaultdict

import pytest

from veilframe.operators.intervals import coverage

SCHEMA = "d string, s string, a int, b int, kind string, at int"


def brute(rows):
    groups = defaultdict(list)
    for d, s, a, b in rows:
        if a is not None and b is not None and b > a:
            groups[d, s].append((a, b))
    out = set()
    for k, spans in groups.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out |= {(*k, "cover", a, b) for a, b in merged} | {(*k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in coverage(df, ["d", "s"], "a", "b").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_defined_cases(spark):
    rows = [("d", "s", 0, 5), ("d", "s", 5, 7), ("d", "s", 9, 12), ("d", "s", 10, 11), ("d", None, 3, 4), ("d", "s", 4, 4), ("d", "s", None, 4), ("d", "s", 8, 2), ("d", "s", 0, 5)]
    assert run(spark, rows) == brute(rows) == {("d", "s", "cover", 0, 7), ("d", "s", "cover", 9, 12), ("d", "s", "gap", 7, 9), ("d", None, "cover", 3, 4)}
    assert run(spark, []) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(1500):
        a = r.choice([r.randint(-500, 500), r.randint(-200_000, 200_000), r.randint(-4, 4) * 65_536, r.randint(-100, 100) * 64])
        rows.append((f"d{r.randint(0, 40)}", None if i % 50 == 0 else "x", a, a + r.choice([0, 1, r.randint(1, 64), 64, 65_536, 131_072, r.randint(1, 300), r.randint(1, 200_000)])))
    rows += [("edge", "x", -(2**31), 2**31 - 1), ("edge2", "x", 2**31 - 2, 2**31 - 1), ("edge2", "x", -(2**31), -(2**31) + 1)]
    assert run(spark, rows) == brute(rows)


def test_long_intervals_stay_runs(spark):
    import random

    day = 86_400_000_000
    r = random.Random(4)
    rows = [("a", 0, 365 * day), ("a", 366 * day, 366 * day + 5), ("a", 366 * day + 7, 800 * day), ("a", 3 * day, 3 * day + 9), ("b", 5, 6), (None, -400 * day, -day), (None, -day + 3, day)]
    rows += [("c", s, s + r.choice([3, 70_000, 10_000_000, day])) for s in (r.randrange(20 * day) for _ in range(200))]
    want = set()
    for k in ("a", "b", "c", None):
        end = None
        for s, e in sorted((s, e) for x, s, e in rows if x == k):
            if end is None or s > end[1]:
                if end:
                    want |= {(k, "cover", *end), (k, "gap", end[1], s)}
                end = [s, e]
            else:
                end[1] = max(end[1], e)
        want.add((k, "cover", *end))
    got = coverage(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e").collect()
    assert {(x.k, x.kind, x.s, x.e) for x in got} == want and len(got) == len(want)
