import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, key long, spans string, n int"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with names that operators use themselves."""
    rng = random.Random(9)
    long_text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(60_000))
    texts = ["", " \n\t ", None, "one", "Ein kurzer Text.", "x" * 5000, long_text, "mail a.b@c.example.com or +1 (988) 555-2485", "…é日本語   ", "42 42 42 42"]
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 4 else "s", None, "b", 1, "s", 0) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", "en", "s", 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [rows[7], rows[7], (77, long_text, "en", "s", 1, "b", 1, "s", 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (4, 1, 0), (None, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
