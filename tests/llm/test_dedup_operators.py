"""Duplicates of three kinds against brute force, with groups, ties and hot keys."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from blockloom.llm import components, minhash, substrings, suffixes
from blockloom.llm.minimisers import levels

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def passages(docs, k):
    least, out = {}, {}
    for d, t in docs:
        w = (t or "").encode().split()
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            least[g] = min(d, least.get(g, d))
    for d, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def strings(docs, k):
    times = collections.Counter(b[i : i + k] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - k + 1))
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if times[b[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def groups(docs, width, percent):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 40)))) for i in range(200)]
    rows += [(200 + i, rows[i][1] + " xé " + rows[i + 1][1]) for i in range(40)] + [(300, None), (301, ""), (302, "\n\t")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_passages_on_the_table(spark, documents, sf_dir):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.query(spark, sf_dir).collect()}
    assert got == passages(documents, substrings.K)


@pytest.mark.parametrize(("k", "m", "hot"), [(6, 2, None), (6, 2, 20), (6, 2, 0), (14, 2, 3)])
def test_passages_with_frequent_minimisers(small, k, m, hot):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(small[1], k=k, m=m, hot_least=hot).collect()}
    assert got == passages(small[0], k)


def test_passages_edges(nasty, empty):
    out = substrings.digest(nasty).collect()
    assert len(out) == nasty.count() and {r.doc_id: r.n_removed for r in out}[77] == 60_000 and sum(r.n_removed for r in out if r.doc_id == 7) == 0
    kept = substrings.strip(nasty)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() and substrings.digest(empty).count() == substrings.strip(empty).count() == 0


def test_strings_on_the_table(spark, documents, sf_dir):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.query(spark, sf_dir).collect()}
    assert got == strings(documents, suffixes.K)


@pytest.mark.parametrize(("k", "m", "hot"), [(12, 5, None), (13, 5, 20), (13, 5, 0), (30, 5, 3)])
def test_strings_with_frequent_minimisers(small, k, m, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(small[1], k=k, m=m, hot_least=hot).collect()}
    assert got == strings(small[0], k)


def _shards(k, m):
    """Random texts with much in common, in three shards; the arguments of suffixes.settle."""
    rng = random.Random(4)
    base = [["".join(rng.choices("abc", k=60)) for _ in range(6)] for _ in range(4)]
    docs = [(i, "".join(rng.choice(base[rng.choice((3, i // 20))])[rng.randrange(9) :] for _ in range(4))) for i in range(60)]
    lengths = levels(k, m)
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array([t for _, t in part])], ["doc_id", "tag", "text"]) for part in (docs[:20], docs[20:40], docs[40:])]
    rows = [r for b in batches for r in suffixes._packer(k, lengths, 1, np.zeros(0, np.uint64))(iter([b]))]
    unzip = zstandard.ZstdDecompressor()
    shards = [(np.frombuffer(unzip.decompress(a), np.uint64).reshape(-1, 7), unzip.decompress(t)) for r in rows for a, t in [(r.column("arrays")[0].as_py(), r.column("texts")[0].as_py())] if a]
    return docs, rows, shards


def _windows(batches):
    return {(r["doc_id"], r["first"] + i) for b in batches for r in b.to_pylist() for i in range(r["n"])}


def test_transforms_decide(spark):
    """The merge gives all repeated windows, and other ones if a shard's transform is out of order."""
    k = 40
    docs, rows, shards = _shards(k, 5)
    times = collections.Counter(t[i : i + k] for _, t in docs for i in range(len(t) - k + 1))
    want = {(d, i) for d, t in docs for i in range(len(t) - k + 1) if times[t[i : i + k]] > 1}
    assert len(shards) == 3 and _windows(suffixes._judge(k)(iter(rows))) == want
    good = _windows(suffixes.settle(shards, k))
    numbers, raw = shards[1]
    ends = np.cumsum(numbers[:, 3].view(np.int64) + k - 1)
    parts = [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
    mixed = np.random.default_rng(5).permutation(len(parts))
    turned = (np.ascontiguousarray(numbers[mixed]), b"".join(parts[i] for i in mixed))
    assert _windows(suffixes.settle([shards[0], turned, shards[2]], k)) != good


@pytest.mark.parametrize("operator", [substrings, suffixes])
def test_texts_that_share_an_id(spark, operator):
    """Each text of an id is judged by itself, equal ones too; texts of one id are no smaller id than each other."""
    w = [" ".join(f"{c}{i:05d}" for i in range(80)) for c in "abcd"]
    rows = [(1, w[0]), (2, w[0]), (2, w[1]), (2, w[1]), (2, w[2] + " " + w[3]), (3, "x " + w[2]), (4, None), (4, ""), (4, "one")]
    got = sorted((r.doc_id, r[1], r.n_removed) for r in operator.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    if operator is substrings:
        assert got == sorted([(1, 80, 0), (2, 80, 80), (2, 80, 0), (2, 80, 0), (2, 160, 0), (3, 81, 80), (4, 0, 0), (4, 0, 0), (4, 1, 0)])
    else:
        n = len(w[0])
        assert got == sorted([(1, n, n), (2, n, n), (2, n, n), (2, n, n), (2, 2 * n + 1, n), (3, n + 2, n), (4, 0, 0), (4, 0, 0), (4, 3, 0)])


def test_a_text_of_several_segments(spark, monkeypatch):
    """Long texts are cut in overlapping segments; nothing changes."""
    rng = random.Random(1)
    docs = [(i, "".join(rng.choices("ab", k=300))) for i in range(8)]
    monkeypatch.setattr(suffixes, "SEGMENT", 37)
    rows = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([0] * 8, pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "tag", "text"])
    packed = suffixes._packer(12, levels(12, 5), 1, np.zeros(0, np.uint64))(iter([rows]))
    times = collections.Counter(t[i : i + 12] for _, t in docs for i in range(289))
    assert _windows(suffixes._judge(12)(packed)) == {(d, i) for d, t in docs for i in range(289) if times[t[i : i + 12]] > 1}


def test_strings_edges(nasty, empty):
    out = suffixes.digest(nasty).collect()
    assert len(out) == nasty.count() and suffixes.digest(empty).count() == 0
    by = {r.doc_id: r for r in out}
    assert by[77].n_removed == by[77].n_bytes == by[6].n_removed and by[5].n_removed == 5000 and by[5].n_spans == 1


def test_near_duplicates_on_the_table(spark, documents, sf_dir):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.query(spark, sf_dir).collect()}
    assert got == groups(documents, 4, 80)


def test_near_duplicates_chain_and_group(spark):
    """A chain whose ends are far apart, a group of variants of one text with some too far from all, and texts that share a passage."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(100_000)]
    base = rng.sample(words, 120)
    rows, now = [], base[:]
    for _ in range(25):
        now = now[:]
        now[rng.randrange(120)] = rng.choice(words)
        rows.append(now)
    other = rng.sample(words, 120)
    for i in range(120):
        copy = other[:]
        for _ in range(i % 9):
            copy[rng.randrange(120)] = rng.choice(words)
        rows.append(copy)
    shared = rng.sample(words, 80)
    rows += [rng.sample(words, 30) + shared for _ in range(60)] + [other, other, ["A", "b"], ["a", "B"], ["a"], []]
    order = list(range(len(rows)))
    rng.shuffle(order)
    docs = [(order[i], " ".join(r)) for i, r in enumerate(rows)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(docs, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(nasty, empty):
    out = minhash.near_duplicates(nasty).collect()
    assert len(out) == nasty.count() and {r.doc_id: r.component_id for r in out}[77] == 6 and all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    kept = minhash.keep_one(nasty)
    assert kept.columns == nasty.columns and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id = 77").count() == 0 and kept.where("doc_id IS NULL").count() == 2
    assert minhash.near_duplicates(empty).count() == minhash.keep_one(empty).count() == 0


def test_keep_one_judges_each_text_of_an_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[1]), (4, texts[2]), (4, texts[1]), (4, texts[2]), (5, None), (5, ""), (None, texts[0])]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(1, texts[0]), (2, texts[1]), (4, texts[2]), (5, None), (5, ""), (None, texts[0])]))


def test_near_duplicates_of_texts_that_share_an_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (2, texts[1]), (3, texts[1]), (4, texts[2]), (4, None), (None, texts[0])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, 37, 1, True), (2, 37, 1, False), (2, 37, 2, True), (2, 37, 2, True), (3, 37, 2, False), (4, 37, 4, True), (4, 0, 4, True), (None, 37, None, True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.components(links, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
