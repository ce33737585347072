"""The pipeline's near-duplicate stage against all pairs by 5-word Jaccard similarity."""

import random
import re

import corpus_pipeline
import pytest
from mailframe.llm import common, near, simhash
from pyspark.sql import functions as F

from .conftest import DOC

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, threshold=0.8):
    """The ids that stay, of (id, text) with distinct ids."""
    sets = []
    for _, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    of = list(range(len(docs)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-9:
                x, y = root(i), root(j)
                of[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i][0])
    return {min(g) for g in groups.values()}


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_edited_copies(spark, monkeypatch):
    """Words replaced, left out and added up to the threshold and beyond, a shared license, short texts."""
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(3000)]
    licence = " ".join(pool[:30])
    texts = []
    for _ in range(60):
        w = rng.choices(pool, k=rng.choice((3, 5, 9, 40, 150, 600)))
        texts.append(" ".join(w) + (" " + licence if rng.random() < 0.5 else ""))
        for _ in range(3):
            c = list(w)
            for _ in range(rng.choice((1, 1, 2, 4, 1 + len(w) // 100, 1 + len(w) // 40))):
                c[rng.randrange(len(c))] = rng.choice(("Edit", "", "two words"))
            texts.append("  ".join(c).upper() + (" " + licence if rng.random() < 0.5 else ""))
    docs = list(enumerate(texts))
    want = brute(docs)
    assert 60 < len(want) < 200
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for sample in (near.SAMPLE, 40, 0):
        monkeypatch.setattr(near, "SAMPLE", sample)
        assert sorted(r.doc_id for r in near.first_of_each(frame).collect()) == sorted(want)


@pytest.mark.parametrize("block", (4096, 50))
def test_a_large_group_is_not_all_pairs(spark, monkeypatch, block):
    """400 variants of one text, hot, some near, in one block or in many: fewer pairs are compared on words than are similar, and all links count."""
    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(near, "BLOCK", block)
    checked, sizes = near.verified, []
    monkeypatch.setattr(near, "verified", lambda pairs, *x: sizes.append(pairs.count()) or checked(pairs, *x))
    rng = random.Random(7)
    words = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(400):
        w = list(words)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = f"own{rng.random()}"
        docs.append((i, " ".join(w)))
    # a chain that leads away from the group
    docs += [(1000 + k, " ".join([*words[5 * k :], *(f"n{j}" for j in range(5 * k))])) for k in range(1, 6)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in near.first_of_each(frame).collect()) == sorted(brute(docs))
    sets = [near.shingles(t.encode()) for _, t in docs]
    similar = sum(near.similar(a, b) for i, a in enumerate(sets) for b in sets[:i])
    assert sum(sizes) < min(similar, 4 * len(docs))


def compared(cells):
    """Pairs of texts that meet in a cell, both orders counted."""
    sizes = cells.groupBy("leader", "at", "i", "j", "block").count().groupBy("leader", "at", "i", "j").agg(F.collect_list("count").alias("c")).collect()
    return sum(sum(r.c) ** 2 for r in sizes)


def test_comparisons_in_a_group(spark, monkeypatch):
    """Four times the near copies of a text, four times the comparisons and not sixteen; texts of one component meet no more."""
    monkeypatch.setattr(near, "BLOCK", 40)
    monkeypatch.setattr(near, "PIVOTS", 4)
    first = []
    for m in (400, 1600):
        # all share the shingles of a text and form two components, and ten that are alone
        root = F.when(F.col("id") < 10, F.col("id")).when(F.col("id") % 3 == 0, 100).otherwise(200)
        known = spark.range(m).select(F.col("id").alias("key"), root.alias("root"), F.lit(50).alias("n"), F.lit(bytes(256)).alias("bits"))
        shared = known.select(F.lit(7).cast("long").alias("h"), "key")
        first.append(compared(near.meetings(shared, known)[0]))
        cells = near.meetings(shared, known, known.select("key", "root"))[0]
        both = cells.select("leader", "i", "j", "key", "root", "block")
        met = both.alias("x").join(both.alias("y"), ["leader", "i", "j"]).where("x.key < y.key AND (i = j OR x.block != y.block)")
        times = met.groupBy("x.key", "y.key").agg(F.count("*").alias("n"), F.first(F.col("x.root") == F.col("y.root")).alias("same"))
        got = {r.same: (r.c, r.n) for r in times.groupBy("same").agg(F.count("*").alias("c"), F.max("n").alias("n")).collect()}
        # each pair of different components once, none of a component
        third = len([i for i in range(10, m) if i % 3 == 0])
        assert got == {False: (45 + 10 * (m - 10) + third * (m - 10 - third), 1)}
    assert first[1] < 5.5 * first[0]


def test_common_shingles_of_a_share(spark, monkeypatch):
    """A passage in all texts shows in a share of them, whatever the bounded sample says; then texts that share nothing else don't meet."""
    monkeypatch.setattr(near, "SAMPLE", 0)
    monkeypatch.setattr(near, "BLOCK", 20)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))) for i in range(120)]
    docs += [(200 + i, docs[i][1] + " more") for i in range(15)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found, counts = near.candidates, []
    monkeypatch.setattr(near, "candidates", lambda shared, known, threshold, *roots: counts.append(compared(near.meetings(shared, known, *roots)[0])) or found(shared, known, threshold, *roots))
    for share in (0, 1 / 3):
        monkeypatch.setattr(near, "SHARE", share)
        assert sorted(r.doc_id for r in near.first_of_each(frame).collect()) == sorted(brute(docs)) == list(range(120))
    # two forests and two searches between components
    assert counts[0] > 10 * counts[2] and counts[2] <= 15 * 4


def test_simhash_links_by_its_tree(spark, monkeypatch):
    """Near copies within three bits, or of one fingerprint, are linked by the tree alone and compared on words; the search then has only the others."""
    rng = random.Random(5)
    docs = []
    for i in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        docs.append((10 * i, " ".join(w)))
        # one word, then each word of twenty
        for k, step in enumerate((300, 300, 20)):
            docs.append((10 * i + k + 1, " ".join(rng.choice(("x", "y")) + v if j % step == 7 else v for j, v in enumerate(w))))
    # one fingerprint of texts that are not similar, since shingles that are the same count
    docs += [(1000, "a b c " * 50 + "d"), (1001, "a b c " * 50 + "e f g h")]
    prints = {i: simhash.fingerprint(t.encode()) for i, t in docs}
    sets = {i: near.shingles(t.encode()) for i, t in docs}
    within = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert (1000, 1001) in within and not near.similar(sets[1000], sets[1001])
    of = {i: i for i, _ in docs}
    for a, b in sorted(within):
        if near.similar(sets[a], sets[b]):
            low, high = sorted((of[a], of[b]))
            of = {i: low if r == high else r for i, r in of.items()}
    by_tree = set(of.values())
    assert len(brute(docs)) < len(by_tree) < len(docs) - 20
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near.first_of_each(frame).collect()} == brute(docs)
    # nothing but the tree
    monkeypatch.setattr(near, "shared_shingles", lambda known, made=near.shared_shingles: near.stash(made(known).where("false")))
    assert {r.doc_id for r in near.first_of_each(frame).collect()} == by_tree


def test_plans_are_narrow(spark, monkeypatch):
    """No key is hot and no group large, on more rows than one could be hot in: no written table is planned from more than six others, since the driver prepares the stages of all at once."""
    monkeypatch.setattr(common, "HOT", 20)
    leaves, write = [], common.stash

    def stash(df, what="table"):
        leaves.append((df._jdf.queryExecution().optimizedPlan().collectLeaves().size(), what))
        return write(df, what)

    for module in (common, near, simhash):
        monkeypatch.setattr(module, "stash", stash)
    rng = random.Random(3)
    docs = []
    for i in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for k in range(4):
            docs.append((4 * i + k, " ".join([*w[:3], *(f"own{rng.random()}" for _ in range(rng.choice((0, 1, 3)))), *w[3:], *(["end"] * (k % 2))])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near.first_of_each(frame).collect()} == brute(docs)
    assert max(leaves)[0] <= 6, sorted(leaves)[-5:]


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    kept = near.first_of_each(odd)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    # copies and texts without words count once
    assert kept.columns == odd.columns and sorted(got, key=str) == sorted({x for x in rows if (x[1] or "").strip()} | {(2, None)}, key=str)
    assert near.first_of_each(spark.createDataFrame([], DOC)).collect() == near.first_of_each(none).collect() == []
