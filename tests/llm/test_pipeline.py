import gc

import corpus_pipeline
from terraflux.llm import quality, toxicity

from .test_packing import VOCABULARY, check
from .test_similar import smallest
from .test_substrings import brute


def test_stages_one_by_one(spark, words):
    """Each stage on all its predecessor kept, held against the operator's own report or brute force."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_dedup", "substring_dedup", "packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    good = stages["quality"](spark, docs, sf).cache()
    assert good.columns == docs.columns
    assert ids(good) == ids(quality.report(docs, labels).where("not rejected"))
    kind = stages["toxicity"](spark, good, sf).cache()
    assert kind.columns == docs.columns
    assert ids(kind) == ids(toxicity.scored(good, labels).where("predicted = 0"))
    single = stages["near_dedup"](spark, kind, sf).cache()
    assert single.columns == docs.columns
    kept = ids(single)
    assert kept == smallest({r.doc_id: r.text or "" for r in kind.collect()})
    cut = stages["substring_dedup"](spark, single, sf).cache()
    assert cut.columns == docs.columns and ids(cut) == kept
    wanted = {i: b" ".join(w) for i, w, _ in brute([(r.doc_id, r.text) for r in single.collect()], words, 50)}
    assert {r.doc_id: b" ".join(words(r.text)) for r in cut.collect()} == wanted
    packed = stages["packing"](spark, cut, sf).collect()
    assert check(packed, [(r.doc_id, r.text) for r in cut.collect()], Tokenizer.from_file(path(VOCABULARY[0])), 2048) == 0


def test_stages_called_before_the_first_is_read(spark):
    """Neither result is cached; the second call must not take the first one's tables away, nor a third what is derived from it."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["near_dedup"](spark, docs, sf)
    second = stages["substring_dedup"](spark, docs, sf)
    derived = first.select("doc_id")
    del first
    stages["near_dedup"](spark, second, sf)
    assert 0 < derived.count() < second.count() == docs.count()


def test_tables_that_nothing_reads_are_removed(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    made = stages["substring_dedup"](spark, docs, sf)
    held = corpus_pipeline._WRITTEN[spark.sparkContext.applicationId]
    before = [t.path for t in held]
    made.count()
    del made
    gc.collect()
    spark._jvm.System.gc()
    stages["substring_dedup"](spark, docs, sf).count()
    now = [t.path for t in corpus_pipeline._WRITTEN[spark.sparkContext.applicationId]]
    assert set(before) - set(now) and set(now) - set(before)


def test_run_with_odd_rows(spark, tmp_path, make):
    """Nulls, empty, long and repeated texts, columns whose names clash, and an empty table, through the whole chain."""
    good = "plain words in a plain sentence. "
    rows = [(k, good * 3 + f"number {k}") for k in range(40)] + [(100, None), (101, ""), (None, good), (102, good * 20000), (102, good * 20000), (103, good * 3 + "number 3")]
    for name, docs in (("some", make(rows)), ("none", make([]))):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert {r.doc_id for r in out} <= {i for i, _ in rows} and bool(out) == (name == "some")
        if out:
            assert {None, 0, 100, 102} <= {r.doc_id for r in out} and 101 not in {r.doc_id for r in out}  # an empty text is a copy of a null one


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None
