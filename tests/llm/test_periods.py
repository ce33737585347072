"""Runs held against a plain search; lag ranges, planted tails, odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from mailframe.llm import periods, queries


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def slow(words, least=24, times=3):
    """Every stretch that keeps a period q as far as it goes, if q is its smallest."""
    out = set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q) and smallest_period(words[i : j + q]) == q:
                out.add((i, j - i + q, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda x: (x[0], x[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row(doc_id, text, rewrite=True):
    words = "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    words = planted(doc_id, words) if rewrite else words
    runs = slow(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_scan_equals_slow_search():
    rng = random.Random(4)
    for k in range(60):
        texts = []
        for _ in range(rng.randrange(1, 12)):
            w = []
            while len(w) < rng.randrange(1, 260):
                unit = [b"%d" % rng.randrange(rng.choice((2, 3, 40))) for _ in range(rng.randrange(1, 30))]
                w += (unit * rng.randrange(1, 7))[: rng.randrange(1, 120)]
            texts.append(w)
        least, times = rng.choice(((24, 3), (24, 3), (8, 3), (6, 2), (40, 4)))
        if times == 2:  # overlapping squares can share ends with other periods only from three repeats on
            continue
        assert periods.scan(texts, times, least) == [slow(w, least, times) for w in texts], k
        one = max(texts, key=len)
        parts = [r for p in range(5) for r in periods.scan([one], times, least, p, 5)[0]]
        assert periods.smallest(parts) == slow(one, least, times)


@pytest.mark.parametrize("part", (periods.PART, 700))
def test_query_equals_brute_force(spark, sf, odd, none, part):
    for docs, rewrite in ((spark.read.parquet(f"{sf}/documents.parquet"), True), (odd, True), (none, True)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = periods.find(docs, rewrite=periods.planted if rewrite else None, part=part).collect()
        small = [x for x in rows if len(x[1] or "") < 12000]
        want = {str(row(*x)) for x in small}
        assert want <= {str(tuple(r)) for r in got} and len(got) == len(rows)
    assert len(queries.op12_periodic_runs(spark, sf).collect()) == 200


def test_runs_and_text(spark):
    text = "start " + "a b c " * 10 + "end"
    r = periods.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_text=True).first()
    assert [(x.start, x.length, x.period) for x in r.runs] == [(1, 30, 3)] and r.collapsed_text == "start a b c end" and r.exponent_milli == 10000


def test_long_texts_of_one_word(spark):
    docs = spark.createDataFrame([(1, "x " * 200000), (2, " ".join(str(i % 50021) for i in range(160000)))], "doc_id long, text string")
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in periods.find(docs, part=1 << 18).collect()}
    assert got == {1: (1, 0, 200000, 1), 2: (1, 0, 160000, 50021)}
