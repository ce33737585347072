import random
import re

import pytest
import xxhash
from mailframe.llm import common, queries, simhash
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(points, radius=3):
    """points: (id, fingerprint); the least id reachable."""
    by = {}
    for i, f in points:
        by.setdefault(f, []).append(i)
    keys, seen, out, groups = list(by), set(), {}, []
    for k in keys:
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            x = todo.pop()
            for y in keys:
                if y not in group and (x ^ y).bit_count() <= radius:
                    group.add(y)
                    todo.append(y)
        seen |= group
        groups.append(group)
        least = min((i for f in group for i in by[f] if i is not None), default=None)
        out.update(dict.fromkeys(group, least))
    return out, groups


def check(rows, docs):
    want = [(i, brute_fingerprint(t)) for i, t in docs]
    of, _ = brute_components(want)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str) == sorted(((i, f"{f:016x}", of[f]) for i, f in want), key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op3_simhash(spark, sf).collect(), docs)


def test_odd_rows(odd, none, monkeypatch):
    check(simhash.near_duplicates(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(none).collect() == []
    with monkeypatch.context() as m:
        m.setattr(common, "HOT", 1)
        check(simhash.near_duplicates(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    kept = simhash.first_of_each(odd)
    _, groups = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in odd.collect()])
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert simhash.first_of_each(none).collect() == []


@pytest.mark.parametrize("home", (16, 2))
def test_links_in_a_deep_tree(spark, monkeypatch, home):
    """Chains and balls of fingerprints, levels below the sample, leaves cut into grids: as connected as all pairs are."""
    rng = random.Random(8)
    points = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        points.add(x)
        for _ in range(rng.choice((1, 5, 60))):
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    for name, value in (("HOME", home), ("BLOCK", 64), ("AT_ONCE", 256), ("DEALT", 500)):
        monkeypatch.setattr(simhash, name, value)
    monkeypatch.setattr(common, "HOT", home)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in points]
    frame = spark.createDataFrame(signed, "fp long")
    got = {r.a: r.b for r in simhash.components(simhash.links(frame)).collect()}
    want, _ = brute_components([(x, x) for x in points])
    groups = {}
    for x, in signed:
        groups.setdefault(want[x & (1 << 64) - 1], set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert {(r.a, r.b) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 301)}


def test_pairs_are_links_that_span(spark, monkeypatch):
    """Each pair lies within the radius, and the pairs are as connected as all are; few more than there are fingerprints."""
    rng = random.Random(3)
    points = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        points.add(x)
        for _ in range(rng.choice((2, 40))):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            points.add(x)
    for name, value in (("HOME", 16), ("BLOCK", 64), ("AT_ONCE", 256)):
        monkeypatch.setattr(simhash, name, value)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in points]
    got = [tuple(r) for r in simhash.pairs(spark.createDataFrame(signed, "fp long")).collect()]
    assert all(a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in got)
    of = {r.a: r.b for r in simhash.components(spark.createDataFrame(got, "a long, b long")).collect()}
    _, groups = brute_components([(x, x) for x in points])
    assert len(points) - len(of) == len(groups) and len(got) < 4 * len(points)
