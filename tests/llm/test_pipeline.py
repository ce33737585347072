"""Each stage against a brute-force version on its own input, and run() against the stages."""

from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from mailframe.llm import langid, near
from mailframe.llm.common import BATCH, BATCH_KEY, small_batches, stash
from pyspark.sql import functions as F

from .test_decontaminate import brute as contaminated
from .test_mixing import WORD, brute_targets
from .test_near import brute as similar
from .test_token_files import expected

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    languages, near, decontaminated, mixed, tokens = (f for _, f in corpus_pipeline.STAGES)

    kept = stash(languages(spark, docs, SF))
    model = langid.fit(docs)
    own = {r.doc_id: r for r in docs.collect()}
    likely = {i for i, r in own.items() if (s := model.scores(r.text)) is not None and model.classes[int(s.argmax())] == r.lang}
    assert kept.columns == columns and likely <= {r.doc_id for r in kept.collect()}

    want = similar([(r.doc_id, r.text) for r in kept.collect()])
    single = stash(near(spark, kept, SF))
    assert single.columns == columns and {r.doc_id for r in single.collect()} == want
    assert all(tuple(r) == tuple(own[r.doc_id]) for r in single.collect())

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    gone = {x[0] for x in contaminated([(r.doc_id, r.text) for r in single.collect()], items)}
    clean = stash(decontaminated(spark, single, SF))
    assert gone and clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - gone

    mix = stash(mixed(spark, clean, SF))
    times, sizes, most = Counter(r.doc_id for r in mix.collect()), Counter(), Counter()
    taken = Counter()
    for r in clean.collect():
        n = len(WORD.findall(r.text))
        sizes[r.source] += n
        most[r.source] = max(most[r.source], n)
        taken[r.source] += n * times[r.doc_id]
    assert mix.columns == columns and max(times.values()) <= 2
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 4 * most[s]

    want = expected(sorted((r.doc_id, r.text) for r in mix.collect()))
    assert [tuple(r) for r in tokens(spark, mix, SF).orderBy("start").collect()] == want
    assert [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()] == want


def test_empty_table(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
        docs = none.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.mark.parametrize("name", ["language ID", "SimHash near-dedup", "benchmark decontamination", "token files"])
def test_small_batches(spark, none, name, monkeypatch):
    """After a stage of Python, whose result is read later, 20 MB of texts don't go to a worker at once; a session's own bound stays."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    # many rounds over no rows; only what it leaves to the session counts here
    monkeypatch.setattr(near, "first_of_each", lambda docs: docs)
    docs, stage = none.select("doc_id", "text", "lang", "source", "n_chars"), dict(corpus_pipeline.STAGES)[name]
    rows = spark.range(0, 200, 1, 1).select("id", F.repeat(F.lit("some words "), 9_500).alias("text"))
    try:
        spark.conf.unset(BATCH_KEY)
        stage(spark, docs, SF)
        got = [tuple(r) for r in rows.mapInArrow(sizes, "n long, bytes long").collect()]
        assert sum(n for n, _ in got) == 200 and sum(x for _, x in got) > 20_000_000 and max(x for _, x in got) < 1.1 * BATCH
        spark.conf.set(BATCH_KEY, "1m")
        small_batches(spark)
        assert spark.conf.get(BATCH_KEY) == "1m"
    finally:
        spark.conf.unset(BATCH_KEY)
