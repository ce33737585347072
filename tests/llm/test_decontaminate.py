import random
import re

from mailframe.llm import decontaminate, queries

W = re.compile(r"\w+").findall


def brute(docs, items, t=0.8):
    out = []
    for i, text in docs:
        w = W((text or "").lower())
        for k, item in items:
            q = W((item or "").lower())
            n = min(5, len(q))
            own = {tuple(q[j : j + n]) for j in range(len(q) - n + 1)} if q else set()
            there = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if own and len(own & there) >= t * len(own) - 1e-9:
                out.append((i, k, len(own), len(own & there)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op5_decontamination(spark, sf).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(docs, items) and got


def test_edges(spark, odd, none):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "seven"), (93, "four five six seven"), (94, "Seven"), (None, "no id here but words")]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(0, 300))
        copy = items[rng.randrange(40)][1].split()
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = "changed"
        docs.append((i, " ".join(words[:20] + copy + words[20:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (10, 10**6):
        got = decontaminate.contaminated(frame, bench, block_words=block).collect()
        assert sorted((tuple(r)[:4] for r in got), key=str) == brute(docs, items)
    odd_rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r)[:4] for r in decontaminate.contaminated(odd, bench).collect()), key=str) == brute(odd_rows, items)
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - len({(x[0], j) for j, d in enumerate(odd_rows) for x in brute([d], items)})
    assert decontaminate.contaminated(none, bench).collect() == [] == decontaminate.contaminated(odd, bench.limit(0)).collect()
    assert decontaminate.clean(odd, bench.limit(0)).count() == len(odd_rows)
