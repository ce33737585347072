"""Filter counts held against a simulation of every order; duplicates against pairs; hashes that mix texts up."""

from collections import Counter
from itertools import permutations

import pytest
from mailframe.llm import audit, common


def fails(doc_id, text, docs):
    t = text or ""
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
    out = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + "D" * any(c in t for c in "#$%&*|")
    return out + "E" * (doc_id is not None and any(i is not None and i < doc_id and (s or "") == t for i, s, _ in docs))


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = [(lang or "", fails(i, t, docs), i in good, i in toxic) for i, t, lang in docs]
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                redundant = sum(r[0] == part and f in r[1] and r not in gone for r in rows)
                unique = sum(r[0] == part and r[1] == f for r in rows)
                out[part, "".join(order), step] = [len(stay), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
                left = stay
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


@pytest.fixture(scope="module")
def docs():
    words = " ".join(f"w{i}" for i in range(120))
    out = [(i, ("" if i % 3 else "SHOUT ") + words[: (i * 37) % 700] + "#" * (i % 5 == 0) + "same " * (i % 4 * 40), ("en", "fr", None)[i % 3]) for i in range(60)]
    out += [(100 + i, out[i % 7][1], "en") for i in range(20)] + [(1, out[1][1], "fr"), (None, out[2][1], "en"), (None, None, None), (200, "", "en"), (201, None, "en")]
    # equal but for the last character, after several blocks
    return [*out, (300, "y" * 30000 + "a", "en"), (301, "y" * 30000 + "b", "en"), (302, "y" * 30000 + "a", "en"), (303, "é" * 15000, "en"), (304, "é" * 15000, "fr")]


LABELS = [(i, i % 2, (i // 2) % 2) for i in range(0, 130, 3)] + [(3, 1, 0), (3, 1, 1), (None, 1, 1), (6, None, None)]


@pytest.mark.parametrize("hot", (4096, 2))
@pytest.mark.parametrize("mixed", (False, True))
def test_equals_brute_force(spark, docs, monkeypatch, hot, mixed):
    monkeypatch.setattr(common, "HOT", hot)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    if mixed:  # every text in one class
        alike = frame.select("doc_id")
        known = audit.refined

        def all_alike(rows):
            return common.stash(rows.selectExpr("r", "doc_id", "1L AS cls"), "alike")

        assert known is audit.refined and alike.count() == len(docs)
        monkeypatch.setattr(audit, "refined", all_alike)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.audit(frame, labels)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, LABELS)


def test_refinement_drops_what_differs(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = common.stash(frame.selectExpr("monotonically_increasing_id() AS r", "doc_id", "coalesce(lang, '') AS part", "coalesce(text, '') AS t"), "rows")
    alike = {r.doc_id for r in audit.refined(audit.measured(rows, 64)).collect()}
    assert {300, 302, 303, 304, 200, 201} <= alike and 301 not in alike


def test_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert sorted(tuple(r) for r in audit.audit(odd, labels).collect()) == brute(rows, LABELS)
    assert audit.audit(none, labels).collect() == []
    assert {r.good_lost for r in audit.audit(odd, labels.limit(0)).collect()} == {0}
