"""Frequent lines held against brute force; batches, runs, levels, hot lines, odd rows."""

import hashlib
from collections import Counter

import pytest
from mailframe.llm import common, lines

WHITE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least):
    keys = [[x.strip(WHITE).translate(UPPER) for x in (t or "").split("\n")] for _, t in docs]
    n = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (i, t), ks in zip(docs, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if not k or n[k] < least]
        out.append((i, len(ks), len(ks) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame, **kw):
    return sorted((tuple(r) for r in lines.dedup(frame, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    pool = ["Common Line", "  common line\t", "ÉTÉ", "été", "", " \x0b ", "x" * 5000, "a\x00b", "\x85", "last"]
    out = [(i, "\n".join(pool[(i * k) % len(pool)] + ("" if k % 3 else str(i % 7)) for k in range(i % 9))) for i in range(120)]
    return [*out, (None, None), (None, "Common line"), (5, "twice\ntwice"), (5, "twice\ntwice"), (7, "\n"), (8, "COMMON LINE\n" * 3000)]


@pytest.mark.parametrize("hot", (4096, 2))
@pytest.mark.parametrize(("least", "fan", "batches"), ((10, 4, 6), (2, 2, 5), (1, 3, 1), (500, 2, 3)))
def test_equals_brute_force(spark, docs, monkeypatch, least, fan, batches, hot):
    monkeypatch.setattr(common, "HOT", hot)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(frame, least=least, fan=fan, batches=batches) == brute(docs, least)


def test_odd_and_empty(spark, odd, none):
    assert got(odd, least=2) == brute([(r.doc_id, r.text) for r in odd.collect()], 2)
    assert got(none) == []
    kept = lines.dedup(spark.createDataFrame([(1, "a\nB\nc"), (2, "b ")], "doc_id long, text string"), least=2, with_text=True)
    assert {r.doc_id: r.kept_text for r in kept.collect()} == {1: "a\nc", 2: ""}


def test_runs_outlive_a_session_and_take_a_batch_once(spark):
    path = common.new_path(spark, "kept-runs")

    def counts(ids):
        found = lines.lines(lines.rows_of(spark.createDataFrame([(i, "every\nown %d" % i) for i in ids], "doc_id long, text string")))
        return lines.counted(found)

    first = lines.Runs(spark, path, least=4, fan=2)
    for k in range(3):
        first.add(f"b{k}", counts(range(3 * k, 3 * k + 3)))
    first.add("b2", counts(range(6, 9)))
    first.close()
    other = spark.newSession()
    again = lines.Runs(other, path, least=4, fan=2)
    m = again.manifest()
    assert m["batches"] == ["b0", "b1", "b2"] and [len(x) for x in m["levels"]] == [1, 1]
    assert sorted(r.n for r in again.totals().collect()) == [1] * 9 + [6]
    assert again.closed().count() == 1
    # what is stored is read by buckets and not moved
    counts_of = lines.counted(lines.lines(lines.rows_of(spark.createDataFrame([(i, "every") for i in range(3)], "doc_id long, text string"))))
    plans = []
    again._write = lambda rows, buckets: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or 1 / 0
    with pytest.raises(ZeroDivisionError):
        again.add("b3", counts_of)
    assert "Bucketed: true" in plans[0] or "Broadcast" in plans[0]
    again.close()


def test_a_batch_that_fails_adds_nothing(spark, monkeypatch):
    runs = lines.Runs(spark, common.new_path(spark, "broken-runs"), least=2)
    frame = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    counts = lines.counted(lines.lines(lines.rows_of(frame)))
    monkeypatch.setattr(runs, "_commit", lambda m: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        runs.add("b", counts)
    monkeypatch.undo()
    assert runs.totals().collect() == []
    runs.add("b", counts)
    assert [r.n for r in runs.closed().collect()] == [2]
    runs.close()
