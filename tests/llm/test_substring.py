import hashlib
import random
import re
from collections import Counter

import pytest
from mailframe.llm import common, queries, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=35):
    words = [WORD.findall(t or "") for _, t in docs]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = {j for a in range(len(w) - window + 1) if n[tuple(w[a : a + window])] > 1 for j in range(a, a + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf):
    for d in (sf, "/root/testdata/sf0.01"):
        docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in queries.op9_substring_dedup(spark, d).collect()), key=str) == brute(docs)


@pytest.mark.parametrize("hot", (4096, 2))
def test_edges(spark, odd, none, monkeypatch, hot):
    """Overlapping copies, runs of one word, junctions of two passages, near copies, short windows."""
    # with 2, nearly all keys are hot
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(400)]
    passages = [rng.choices(pool, k=rng.randrange(10, 90)) for _ in range(12)]
    docs = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(passages) if rng.random() < 0.5 else rng.choices(pool, k=rng.randrange(40))
        if docs and rng.random() < 0.3:
            w = docs[rng.randrange(len(docs))][1].split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "edit"
        docs.append((i, " ".join(w)))
    docs += [(900, "same " * 36), (901, "same " * 35), (902, "a b " * 30), (903, " ".join(pool[:35])), (904, " ".join(pool[:36])), (905, " ".join(pool[1:35]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for window, short in ((35, 8), (12, 4)):
        got = substring.remove_repeats(frame, window, short).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(docs, window)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in substring.remove_repeats(odd).collect()), key=str) == brute(rows)
    assert substring.remove_repeats(none).collect() == []
    kept = {r.doc_id: r.kept_text for r in substring.remove_repeats(odd, with_text=True).collect()}
    assert kept[7] == " ".join(WORD.findall(next(t for i, t in rows if i == 7))) and kept[4] == ""
