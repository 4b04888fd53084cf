"""Language identification with error-correcting output codes.

Each language gets a codeword of bits; one binary classifier a bit predicts it from hashed character n-grams (2 and 3
code points of the lower-cased text, runs of anything but letters counting as one space). A classifier is a log-odds
weight for each n-gram class: the bit's languages of value 1 against those of value 0. A document's margin on a bit is the
mean weight over its n-grams. Decoding is loss-weighted: the language whose codeword has the least logistic loss, summed
over bits weighted by how well the bit separates its two sides. `score` is the softmax of the negated losses; `ambiguous`
says that the runner-up comes closer than `MARGIN` to the winner.

Scale: fitting reads a sample of labelled rows chosen by hash of the id (about `max_rows` in all, a documented bound, dealt by
language: those with few rows are read whole, the others give alike) and gathers
`classes` counts a language; predicting is map-only with the fitted matrix (bounded by classes x bits) as the only side
input. Whole texts are used in both.

Defined results: `und` with score 0 for null texts, texts without a letter, and when nothing could be learned; one row per
input row, repeated rows and null ids included (a null id is never held out and never learned from); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PHI, documents, pieces

CLASSES = 1 << 14
MAX_ROWS = 20_000
MARGIN = 0.1
SHARPNESS = 4.0
FOLDS = 5
UND = "und"
_BLOCK = 1 << 22
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point: its lower-case form if a letter, else a space."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS = table
    return _LETTERS


def grams(text: str | None, classes: int = CLASSES) -> np.ndarray:
    """The classes of the text's 2- and 3-grams (empty if there is no letter)."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    solid = points != 32
    if not solid.any():
        return np.zeros(0, dtype=np.int64)
    points = np.concatenate([[32], points[solid | np.concatenate([[True], solid[:-1]])], [32]]).astype(np.uint64)
    two = points[:-1] * np.uint64(0x110001) + points[1:]
    three = two[:-1] * np.uint64(0x110001) + points[2:] + np.uint64(7)
    shift = np.uint64(64 - (classes.bit_length() - 1))
    return np.concatenate([(two * PHI) >> shift, (three * PHI) >> shift]).astype(np.int64)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1. Up to 5 languages: the exhaustive code; beyond: the best of seeded random codes by least distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        columns = [c for n in range(1, k) for c in combinations(range(k), n) if 0 in c]
        return np.array([[1 if i in c else -1 for c in columns] for i in range(k)], dtype=float)
    rng, best, most = np.random.default_rng(5), None, -1
    bits = int(np.ceil(15 * np.log2(k)))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(k, bits))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        least = min((code[a] != code[b]).sum() for a, b in combinations(range(k), 2))
        if least > most:
            best, most = code, least
    return best


@dataclass
class Model:
    """languages, codewords (languages x bits), weights (classes x bits), the bits' importance and bias."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    importance: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses and softmax scores of (rows x bits) margins, both rows x languages."""
        fit = margins[:, None, :] * self.code[None, :, :] / np.maximum(self.scale, 1e-9)
        loss = (np.logaddexp(0, -SHARPNESS * fit) * self.importance).sum(axis=2) / self.importance.sum()
        e = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
        return loss, e / e.sum(axis=1, keepdims=True)

    @property
    def scale(self) -> np.ndarray:
        return self.importance


def fit_counts(counts: dict[str, np.ndarray]) -> Model | None:
    """From the n-gram counts of each language."""
    languages = sorted(lang for lang, c in counts.items() if c.sum() > 0)
    if not languages:
        return None
    code = codewords(len(languages))
    # each language counts alike, however many rows it has
    p = np.array([(counts[x] + 0.05) / (counts[x].sum() + 0.05 * len(counts[x])) for x in languages])
    weights, importance = [], []
    for bit in code.T:
        if (bit > 0).all():
            weights.append(np.ones(p.shape[1]))
            importance.append(1.0)
            continue
        one, zero = p[bit > 0].mean(axis=0), p[bit < 0].mean(axis=0)
        w = np.clip(np.log(one / zero), -4, 4)
        means = p @ w  # each language's expected margin
        w = w - (means[bit > 0].min() + means[bit < 0].max()) / 2  # halfway between the two sides' closest languages
        weights.append(w)
        importance.append(max(1e-3, (means[bit > 0].min() - means[bit < 0].max()) / 2))
    return Model(languages, code, np.array(weights).T.copy(), np.array(importance))


def shares(rows: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's rows to read, about `most` rows in all: the languages with few rows keep all of them, the others get alike."""
    out, left = {}, most
    for i, (lang, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left / (len(rows) - i))
        out[lang] = take / n
        left -= take
    return out


def fit(df: DataFrame, classes: int = CLASSES, max_rows: int = MAX_ROWS) -> Model | None:
    """Learns from rows (doc_id, text, lang) with a language that are not held out."""
    rows = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    of = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = {lang: int(1_000_000 * share) for lang, share in shares(of, max_rows).items() if share < 1}
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = F.lit(True)
    if cut:
        limit = F.create_map(*(F.lit(x) for pair in cut.items() for x in pair))[F.col("lang")]
        chosen = mark < F.coalesce(limit, F.lit(1_000_000))
    sample = rows.where(chosen).select("lang", "text").repartition(24)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, np.zeros(classes, dtype=np.int64))
                found[lang] += np.bincount(grams(text, classes), minlength=classes)
        for lang, c in found.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], ["lang", "class", "n"])

    sums = sample.mapInArrow(count, "lang string, class long, n long").groupBy("lang", "class").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, part in sums.groupby("lang"):
        counts[lang] = np.zeros(classes)
        counts[lang][part["class"].to_numpy()] = part["n"].to_numpy()
    return fit_counts(counts)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def predict_texts(model: Model | None, texts: list[str | None], classes: int = CLASSES) -> list[tuple[str, float, bool]]:
    """(language, score, ambiguous) of each text."""
    out: list[tuple[str, float, bool]] = [(UND, 0.0, False)] * len(texts)
    if model is None:
        return out
    known = []
    margins = []
    for i, text in enumerate(texts):
        g = grams(text, classes)
        if len(g):
            times = np.bincount(g, minlength=classes)
            at = np.flatnonzero(times)
            margins.append(times[at] @ model.weights[at] / len(g))
            known.append(i)
    if known:
        loss, scores = model.decode(np.array(margins))
        best = loss.argmin(axis=1)
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else np.full(len(best), np.inf)
        close = second - loss.min(axis=1) < MARGIN
        for k, i in enumerate(known):
            out[i] = (model.languages[best[k]], float(scores[k, best[k]]), bool(close[k]))
    return out


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES) -> DataFrame:
    """Adds nothing else: the id as doc_id, lang_pred, score, ambiguous."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = predict_texts(model, batch.column("text").to_pylist(), classes)
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_known(df: DataFrame, model: Model | None, classes: int = CLASSES) -> DataFrame:
    """The rows (all columns) whose text has a language: null texts and those without a letter are rejected, with or without a model."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            if model is None:
                known = [len(grams(t, classes)) > 0 for t in texts]
            else:
                known = [x[0] != UND for x in predict_texts(model, texts, classes)]
            yield batch.filter(pa.array(known, pa.bool_()))

    return df.mapInArrow(scan, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERY = ("op5_langid_ecoc", query)
