"""Suffix-array removal, near-duplicates, repeated passages."""
import collections
import hashlib
import random

import numpy as np
import pytest

from lineweave.llm import chaining, minhash, suffixdedup as sd

from .cases import docs_of, odd_rows, words


def naive_kept(rows):
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - sd.LENGTH + 1):
            first.setdefault(b[p:p + sd.LENGTH], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - sd.LENGTH + 1 if i is not None else 0):
            if first[b[p:p + sd.LENGTH]] < i:
                gone[p:p + sd.LENGTH] = b"\1" * sd.LENGTH
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(gone)))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [32768, 3])
def test_suffix_dedup(spark, most):
    rng = random.Random(7)
    parts = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(30, 120))) for _ in range(9)]
    rows = [(100 + i, "".join(rng.choice(parts) if rng.random() < .5 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(8)))) for i in range(80)]
    rows += [r for r in odd_rows() if r[0] != 8] + [(300, "a" * 300 + "b"), (301, "ab" * 100), (302, "ab" * 90)]
    got = sd.keep_first(docs_of(spark, rows), most).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == naive_kept(rows)
    assert sd.keep_first(docs_of(spark, [])).count() == 0


def test_two_stage_sorting():
    rng = random.Random(8)
    for _ in range(200):
        parts = [bytes(rng.choice(b"ab\x00\xffc"[:rng.randrange(1, 6)]) for _ in range(rng.randrange(1, 120))) for _ in range(rng.randrange(1, 5))]
        text, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
        order = sd.two_stage(text, ends)
        assert sorted(order.tolist()) == list(range(len(text)))
        owner = np.searchsorted(ends, np.arange(len(text)), "right")
        heads = [bytes(text[i:i + sd.LENGTH]) for i in order if i + sd.LENGTH <= ends[owner[i]]]
        assert heads == sorted(heads)


def shingles(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            both = sum((sets[a] & sets[b]).values())
            if both and both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                parent[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    return {r[0]: min(x for x in ids[find(i)] if x is not None) for i, r in enumerate(rows) if r[0] is not None}


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows = [r for r in odd_rows() if r[0] != 8]
    for base in range(25):
        t = words(rng, rng.randrange(40, 200), 5000).split()
        for copy in range(rng.choice([1, 2, 5, 30])):
            u = list(t)
            for _ in range(rng.randrange(0, max(2, len(t) // 60) + 1)):
                u[rng.randrange(len(u))] = f"new{rng.randrange(10 ** 6)}"
            rows.append((1000 + 100 * base + copy, " ".join(u)))
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == brute_classes(rows)
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_banded_alignment():
    rng = random.Random(10)
    for _ in range(200):
        x = np.arange(rng.randrange(1, 60)).astype(np.uint64)
        y = np.array([v for v in x if rng.random() > 0.05] + [1000 + i for i in range(rng.randrange(4))], np.uint64)
        common = len(set(x.tolist()) & set(y.tolist()))
        want = common / (len(x) + len(y) - common)
        assert minhash.similarity(x, y) == (pytest.approx(want) if want >= 0.8 else 0.0)


def test_repeated_passages(spark):
    rng = random.Random(11)
    passage = words(rng, 60, 10 ** 6).split()
    rows = odd_rows()
    for i in range(40):
        p = list(passage)
        if i % 4 == 1:
            p[rng.randrange(5, 55)] = "changed"
        body = words(rng, 50, 10 ** 6) + " " + (" ".join(p) + " " if i % 2 else "") + words(rng, 50, 10 ** 6)
        rows.append((100 + i, body))
    got = chaining.repeated_passages(docs_of(spark, rows)).collect()
    assert {r.doc_id for r in got if r.doc_id >= 100} == {100 + i for i in range(1, 40, 2)} - {101}
    assert all(40 <= r.end - r.start <= 70 and 45 <= r.start <= 55 and r.other_id < r.doc_id and r.identity >= 0.8 for r in got if r.doc_id >= 100)
    assert {(r.doc_id, r.other_id) for r in got if r.doc_id < 100} >= {(6, 5), (7, 5), (11, 5)}
    assert chaining.repeated_passages(docs_of(spark, [])).count() == 0


def test_hot_seeds_are_dealt_and_still_linked(spark):
    rng = random.Random(12)
    passage = words(rng, 60, 10 ** 6)
    rows = [(i, words(rng, 12, 10 ** 6) + " " + passage + " " + words(rng, 12, 10 ** 6)) for i in range(6000)]
    linked = chaining.links(docs_of(spark, rows))
    assert linked.select("b").distinct().count() == 5999 and linked.count() < 6000 * 60 * 2


def test_fenwick_chains_prefer_collinear_segments():
    sa, sb, n = np.array([0, 20, 45, 22]), np.array([100, 121, 146, 5]), np.array([15, 20, 20, 18])
    best = chaining.chains(sa, sb, n)
    assert best[0] == [0, 1, 2] and sorted(i for c in best for i in c) == [0, 1, 2, 3]


def test_long_passages_do_not_hide_short_ones(spark):
    rng = random.Random(31)
    rows, want = [], set()
    for k in range(12):
        long_, short = words(rng, 600, 90000).split(), words(rng, 65, 90000).split()
        holed = short[:30] + words(rng, 5, 90000).split() + short[35:]
        fill = lambda: words(rng, 25, 90000).split()
        rows += [(10 * k, " ".join(long_ + fill() + short + fill())), (10 * k + 1, " ".join(fill() + holed + fill() + long_))]
        want.add((10 * k + 1, 10 * k))
    got = chaining.repeated_passages(docs_of(spark, rows)).collect()
    near = {(r.doc_id, r.other_id) for r in got if 60 <= r.end - r.start <= 75 and r.start < 40}
    assert near == want and len({(r.doc_id, r.other_id) for r in got if r.end - r.start >= 600}) == 12


def test_links_of_crowded_buckets_need_no_star(spark, monkeypatch):
    few = minhash.proposed
    monkeypatch.setattr(minhash, "proposed", lambda reps, b: few(reps, b.filter(f"size <= {minhash.ALL_PAIRS}")))
    rng = random.Random(41)
    rows = []
    for k in range(3):
        text = words(rng, 150, 10 ** 6).split()
        for i in range(20):
            t = list(text)
            t[rng.randrange(150)] = f"other{i}"
            rows.append((100 * k + i, " ".join(t)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) == 3


def test_crowded_buckets_propose_every_pair_of_classes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE", 3)
    keys = [[t * 100 + (0 if t < 4 else 1 + i % 7) for t in range(minhash.TABLES)] for i in range(40)]
    reps = spark.createDataFrame([(i, k, k) for i, k in enumerate(keys)], "rep long, shallow array<long>, deep array<long>")
    label = {i: 0 if i < 20 else i - i % 2 for i in range(40)}
    labels = spark.createDataFrame([(i, c) for i, c in label.items() if i % 3 or c != i], "node long, label long")
    got = [(r.a, r.b) for r in minhash.unproposed(reps, minhash.buckets(reps), labels).collect()]
    assert sorted(got) == [(a, b) for a in range(40) for b in range(a + 1, 40) if label[a] != label[b]]


def test_crowded_buckets_drop_only_pairs_that_cannot_reach_the_bound(spark):
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    texts = []
    for i in range(40):  # texts of a bucket, from very near to far from each other
        x = common.copy()
        at = rng.choice(300, rng.integers(1, 90), replace=False)
        x[at] = rng.integers(0, 1 << 62, len(at)).astype(np.uint64)
        texts.append(x[:300 - i % 5 * 4])
    keys = [7 + t for t in range(minhash.TABLES)]
    rows = [(i, keys, keys, minhash.parity(x).tolist(), len(x)) for i, x in enumerate(texts)]
    reps = spark.createDataFrame(rows, "rep long, shallow array<long>, deep array<long>, parity array<long>, n long")
    labels = spark.createDataFrame([], "node long, label long")
    got = {(r.a, r.b) for r in minhash.unproposed(reps, minhash.buckets(reps), labels).collect()}
    pairs = {(a, b) for a in range(40) for b in range(a + 1, 40)}
    linked = {(a, b) for a, b in pairs if minhash.similarity(texts[a], texts[b]) >= 0.8}
    assert linked and linked <= got and len(got) < len(linked) + 0.5 * len(pairs - linked)
