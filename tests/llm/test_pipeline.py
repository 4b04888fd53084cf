"""The stages in a row, each against what the one before kept."""

import pytest
from pyspark.sql import functions as F

from blockloom.llm import pii
from blockloom.llm.common import table

from .test_dedup_operators import groups, passages

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [rows_of(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        seen.append(rows_of(docs))
    raw, known, single, stripped, clean = seen
    assert known == {d: t for d, t in raw.items() if t and any(c.isalpha() for c in t)}
    of = groups(list(known.items()), 5, 80)
    assert single == {d: t for d, t in known.items() if of[d][1] == d}
    import hashlib

    want = passages(list(single.items()), 50)
    assert stripped.keys() == single.keys()
    for d, t in stripped.items():
        assert t == single[d] if not want[d][1] else hashlib.sha256(t.encode()).hexdigest() == want[d][2]
    assert clean == {d: pii.redacted(t, pii.spans_of(t)) for d, t in stripped.items()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(packed.doc_id) == set(clean) and packed.groupby("sequence_id").length.sum().max() <= 1024
    assert [r.n_chars for r in docs.collect()] == [len(r.text) for r in docs.collect()]


def test_language_without_any_label_keeps_texts(spark, sf_dir, nasty):
    docs = nasty.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    want = [r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert len(want) > 5 and sorted(r.text for r in kept.collect()) == sorted(want)


def test_run_and_empty(spark, sf_dir, nasty, empty):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for start in (nasty, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = table(stage(spark, docs, sf_dir), name)
        assert (docs.count() > 0) == (start is nasty)
