import math
import random
from fractions import Fraction

from mailframe.llm import queries, topk
from pyspark.sql import functions as F


def brute(rows, queries, k=20):
    ok = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, bound = [], lambda x: max(-(2**63), min(2**63 - 1, x))
    for at, (q, v) in enumerate(ok):
        if not queries(q):
            continue
        best = sorted((-bound(sum(a * b for a, b in zip(v, c))), i) for n, (i, c) in enumerate(ok) if n != at and len(c) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in queries.op7_top_k(spark, sf).collect()) == brute(rows, lambda i: i % 20 == 0)


def test_edges(spark, monkeypatch):
    """Ties, many tiles and cells, other lengths, nulls, values that are not finite, large ones, repeated rows and ids."""
    for name, value in (("TILE", 8), ("CELL", 100), ("QUERIES_AT_ONCE", 2), ("GROUP", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(2)
    rows = [(i, [rng.choice((-0.5, 0.25, 0.1)) for _ in range(3)]) for i in range(120)] + [(200, [0.1, None, 0.1]), (201, None), (220, [float("nan"), 1.0, 1.0]), (240, [float("inf"), 0.0, 0.0]), (260, [1.0]), (261, [2.0]), (280, []), (281, []), (None, [1.0, 1.0, 1.0]), (20, [0.25, 0.25, 0.25]), (300, [1e6, 3e5, -2e6]), (301, [1e6, 3e5, -2e6])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    rows = [tuple(r) for r in frame.collect()]
    is_query = F.col("vec_id") % 20 == 0
    got = topk.search(frame, is_query, k=7).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % 20 == 0, 7)
    assert topk.search(frame.limit(0), frame).collect() == [] == topk.search(frame, frame.limit(0)).collect() == topk.search(frame.limit(0), is_query).collect()
    # queries from elsewhere have no row of their own; other columns may have any name
    other = frame.where(is_query).withColumns({"score": F.lit(1), "n": F.lit("x"), "place": F.lit(2), "v": F.lit(0)})
    more = topk.search(frame.withColumn("i", F.lit(0)), other, k=1000).groupBy("query_id").count().collect()
    rows3 = sum(1 for i, v in rows if i is not None and v and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v))
    assert {r["count"] for r in more if r.query_id == 0} == {rows3}


def test_scores_beyond_a_long(spark):
    """They stop at its ends; products that aren't finite are exact before that."""
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.7e308, 0.0]), (4, [0.0, 1.0]), (20, [-1.7e308, 5.0]), (40, [3e9, 3e9])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = topk.search(frame, F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % 20 == 0)
