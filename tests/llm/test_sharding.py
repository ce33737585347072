import zlib
from collections import Counter

from mailframe.llm import common, queries, sharding
from mailframe.llm.sharding import Leaf, shard_of
from pyspark.sql import functions as F


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_sharding(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        b = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(b) + 16, zlib.crc32(b), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    for s, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert 5 < sum(r.grown_shard == 40 for r in rows) < 60


def test_weights_and_movement(spark):
    keys = spark.range(20000)
    tree = [Leaf(0, 0, 0, 4.0), Leaf(1, 0, 1, 2.0), Leaf(2, 1, 0, 1.0), Leaf(3, 1, 0, 1.0)]
    larger = sharding.grown(sharding.grown(tree, 1, 0, 2.0), 0, 1, 2.0)
    rows = keys.select(shard_of(F.col("id"), tree).alias("a"), shard_of(F.col("id"), larger).alias("b")).collect()
    n = Counter(r.a for r in rows)
    assert all(abs(n[x.shard] / 20000 - x.weight / 8) < 0.02 for x in tree)
    moved = [r for r in rows if r.a != r.b]
    assert {r.b for r in moved} == {4, 5} and abs(len(moved) / 20000 - 4 / 12) < 0.02


def test_odd_rows(odd, none):
    tree = sharding.even_tree(40)
    rows = sharding.place(odd, tree, sharding.grown(tree)).collect()
    assert len(rows) == odd.count() and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.place(none, tree, sharding.grown(tree)).collect() == []


def test_lowered_and_removed_shards(spark):
    """Only the keys of a shard whose weight goes move, and as many as it had too much."""
    tree = sharding.grown([Leaf(s, s % 2, s // 2 % 2) for s in range(6)], 0, 1)
    half, gone = sharding.lowered(tree, 2, 0.5), sharding.lowered(sharding.lowered(tree, 2, 0.5), 4)
    rows = spark.range(20000).select(*(shard_of(F.col("id"), t).alias(n) for t, n in ((tree, "a"), (half, "b"), (gone, "c")))).collect()
    assert {r.a for r in rows if r.a != r.b} == {2} and {r.b for r in rows if r.b != r.c} <= {2, 4} | {r.b for r in rows if r.a == 2}
    for name, weights in (("b", {s: 0.5 if s == 2 else 1 for s in range(7)}), ("c", {s: {2: 0.5, 4: 0}.get(s, 1) for s in range(7)})):
        n = Counter(r[name] for r in rows)
        assert all(abs(n[s] / 20000 - w / sum(weights.values())) < 0.015 for s, w in weights.items()), (name, n)


def test_a_row_of_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 100)
    frame = spark.range(5000).selectExpr("if(id < 4000, 7, id) AS doc_id", "'same' AS text")
    tree = sharding.even_tree(40)
    rows = sharding.place(frame, tree, sharding.grown(tree)).collect()
    assert len(rows) == 5000
    for s, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
