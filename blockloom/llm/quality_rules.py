"""Quality rules, in DataFrame expressions only.

Verdict: the hashed n-gram log-likelihood ratio between two multinomials, one of trusted text and one of the raw corpus.
N-grams up to `order` words (the query: words and pairs of neighbouring words) are hashed into `buckets` classes; the raw counts cover every document, the trusted counts the labelled good ones.
The ratio of a class is ln((t + a) / (r + a)) with t its trusted count and r the count expected there from the raw corpus,
so rare classes weigh nothing. It is kept as an integer number of millionths: sums are exact and so deterministic in any
order. A document's score is the mean over its n-grams; it is kept if the score reaches `threshold` (0: at least as likely
under the trusted multinomial as under the raw one).

Scale: both passes over the texts are map-side. The count pass shuffles at most `buckets` rows a task, the score pass one
row a document, which meets the document's base figures by id and text. The ratios are broadcast; they are bounded by `buckets` rows whatever the input. The labelled sample is
bounded by `max_trusted` rows (ids are chosen by hash, so alike at any size), everything else covers all rows.

Defined results: null text has no words; such documents, like all under 50 words, fail the base rule; one row per input
row, repeated rows and null ids included; rows that share an id are scored by their own texts. With no trusted document all ratios are 0 and the base rule alone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

BUCKETS = 1 << 20
MAX_TRUSTED = 50_000
PSEUDO = 3.0
THRESHOLD = 0.0
ORDER = 2
UNIT = 1_000_000

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def grams(w: Column, order: int) -> Column:
    """The hashes of the words and, at order 2, of the pairs of neighbouring words; their classes are taken from rows, in generated code."""
    one = hashes(w)
    if order == 1:
        return one
    two = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    return F.concat(one, F.slice(two, 1, F.greatest(F.size(w) - 1, F.lit(0))))


def repeat_words(w: Column) -> Column:
    """How many words stand in a three-word window that occurs twice or more."""
    # each word is hashed once, a window from its words' hashes
    windows = let(hashes(w), lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), 1, F.greatest(F.size(h) - 2, F.lit(0))))

    def covered(s: Column) -> Column:
        """s: (window, place), sorted."""
        again = F.filter(s, lambda x, i: (x["g"] == F.get(s, i + 1)["g"]) | (x["g"] == F.get(s, i - 1)["g"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def counted(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(placed, covered))

    return let(windows, counted).cast("long")


def base(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the base figures and a hash of the text (`tag`) of each row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    figures = let(
        words(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")),
    )
    symbols = F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long")
    repeated = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    # the generator keeps the optimiser from putting these expressions in the place of every use of a figure
    once = F.inline(F.array(F.struct(figures.alias("f"), symbols.alias("n_symbols"), repeated.alias("n_dup_lines"))))
    return rows.select("doc_id", F.xxhash64("text").alias("tag"), once).select("doc_id", "tag", "f.n_words", "f.word_chars", "n_symbols", "n_dup_lines", "f.n_repeat_words")


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Ids of labelled good documents, about max_trusted at most, chosen by hash."""
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    share = max_trusted / max(max_trusted, good.count())
    return good.where(F.pmod(F.xxhash64("doc_id"), F.lit(UNIT)) < int(share * UNIT))


def ratios(df: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, pseudo: float = PSEUDO, order: int = 1) -> DataFrame:
    """(bucket, llr in millionths)."""
    flag = F.broadcast(trusted.select(F.col("doc_id").alias("doc_id"), F.lit(1).alias("good")))
    counts = (
        df.select("doc_id", "text").join(flag, "doc_id", "left")
        .select("good", F.explode(let(words(F.col("text")), lambda w: grams(w, order))).alias("gram"))
        .groupBy(F.pmod("gram", F.lit(buckets)).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good"))
    )
    counts = table(counts, "op6-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    n_raw, n_good = total.raw or 0, total.good or 0
    if not n_good:
        return counts.select("bucket", F.lit(0).cast("long").alias("llr"))
    due = F.col("raw") * (n_good / n_raw)
    return counts.select("bucket", F.round(F.log((F.col("good") + pseudo) / (due + pseudo)) * UNIT).cast("long").alias("llr"))


def judge(df: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, pseudo: float = PSEUDO, threshold: float = THRESHOLD, order: int = 1) -> DataFrame:
    """The base figures, `base_failed`, `score` (null without words) and `kept` of each row."""
    llr = ratios(df, trusted, buckets, pseudo, order)
    rows = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    hashed = rows.select("doc_id", "text", F.xxhash64("text").alias("tag"))  # before the n-grams are rows: once a text
    one = hashed.select("doc_id", "tag", F.explode(let(words(F.col("text")), lambda w: grams(w, order))).alias("gram")).select("doc_id", "tag", F.pmod("gram", F.lit(buckets)).alias("bucket"))
    sums = one.join(F.broadcast(llr), "bucket").groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg((F.sum("llr") / F.count(F.lit(1)) / F.lit(float(UNIT))).alias("score"))
    rows = base(df)
    rows = rows.join(sums, rows["doc_id"].eqNullSafe(sums["_id"]) & (rows["tag"] == sums["_tag"]), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(documents(spark, sf_dir), trusted_ids(labels))


def ngram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `query`, which scores single words, with pairs of neighbouring words besides."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(documents(spark, sf_dir), trusted_ids(labels), order=ORDER)


QUERY = ("op6_quality_ratio", ngram_query)
