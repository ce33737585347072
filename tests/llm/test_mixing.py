import heapq
import random
import re
from collections import Counter, defaultdict

from mailframe.llm import common, mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, share=1.5, repeats=2, weights=(5, 2, 1)):
    """Targets by resharing the excess until no source is above its stop."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(repeats * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        got = {s: repeats * sizes[s] if s in full else left * w[s] / free for s in order}
        more = {s for s in order if s not in full and got[s] > repeats * sizes[s]}
        if not more:
            return got
        full |= more


def check(rows, words):
    sizes, taken = defaultdict(int), defaultdict(int)
    for source, size in words:
        sizes[source] += size
    targets = brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    for r in rows:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        assert abs(r.target - targets[r.source]) <= 1e-6 * max(1, targets[r.source])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t), (s, taken[s], t)


def test_targets_and_quotas(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs, keep=("source",)).collect()
    check(rows, [(r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()])
    again = queries.op2_mixing(spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_whole_copies_come_near(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mix(docs, keep=("source",)).collect()
    whole, part = sum(r["size"] * r.whole_copies for r in rows), sum(r.taken for r in rows)
    assert abs(whole - part) < 0.05 * part and max(r.whole_copies for r in rows) <= 2


def test_highest_quotients(spark):
    """The seats of each shard's house are those of the highest quotients, one after the other."""
    rng = random.Random(4)
    rows = [(f"s{i}", shard, 10**6, int(mixing.PART * rng.choice((0, 0.01, 0.3, 0.5, 3.3, 40, 1000)) * rng.random())) for shard in range(30) for i in range(rng.randrange(1, 12))]
    got = {(r.key, r.shard): r.seats for r in mixing.quotas(spark.createDataFrame(rows, "key string, shard long, blocks long, votes long")).collect()}
    for shard in range(30):
        votes = {k: v for k, s, _, v in rows if s == shard}
        house = int(sum(votes.values()) / mixing.PART + 0.5)
        heap, seats = [(-v, k) for k, v in votes.items()], dict.fromkeys(votes, 0)
        heapq.heapify(heap)
        for _ in range(house):
            _, k = heapq.heappop(heap)
            seats[k] += 1
            heapq.heappush(heap, (-votes[k] / (2 * seats[k] + 1), k))
        assert {k: got[k, shard] for k in votes} == seats and sum(seats.values()) == house


def test_copies_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 100)
    frame = spark.range(6000).selectExpr("if(id < 3000, 7, id) AS doc_id", "if(id < 3000, 'one two three', concat('w w ', id)) AS text", "if(id % 5 = 0 AND id >= 3000, 'b', 'a') AS source")
    rows = mixing.mix(frame).collect()
    assert len(rows) == 6000 and sum(r.doc_id == 7 for r in rows) == 3000
    source = {r.doc_id: r.source for r in frame.collect()}
    taken = Counter()
    for r in rows:
        taken[source[r.doc_id]] += r.taken
    for s, t in brute_targets({"a": 3000 * 3 + 2400 * 3, "b": 600 * 3}).items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t)


def test_odd_rows(odd, none):
    rows = mixing.mix(odd, keep=("source", "_mix_size")).collect()
    assert len(rows) == odd.count() and "_mix_size" in rows[0]
    check(rows, [(r.source, len(WORD.findall(r.text or ""))) for r in odd.collect()])
    assert mixing.mix(none).collect() == []
