"""Repeated passages by collinear chaining.

Seeds are ``SEED``-word grams, thinned to the least hash of every ``WINDOW`` neighbours, so any ``SEED + WINDOW - 1`` equal
words share one.  The documents of a seed are linked in the order of their ids, each to the first and to the one before,
so links grow with rows and not with pairs.  The links of two documents become exact segments; a Fenwick tree over the
second document's places gives each segment its best predecessor, at a cost for gaps, and so the best chains.  Chains are
aligned word by word (banded at their gaps) and extended at both ends; passages of ``LEAST`` words and ``IDENTITY`` stay.
"""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontam import common_subsequence
from .shared import batch_bytes, grams, shared_table, slices, table, words_of

SEED, WINDOW = 6, 8
LEAST, IDENTITY = 40, 0.8
GAP, GAP_COST = 30, 0.5   # words of a band, one to two of which may lie between chained segments, and the cost of a word of gap difference
HOT, SALTS = 1000, 64     # a seed in more than one of HOT documents of a sample is dealt over SALTS keys
BATCH = 1 << 21


def seeds_of(rows, h):
    """(row, place, hash) of the thinned seeds; the place is a word's index in its row."""
    at, g = grams(h, rows, SEED)
    n = len(g)
    if not n:
        return at, at, g.view(np.int64)
    r = rows[at]
    first = np.searchsorted(rows, r)
    v = (g >> np.uint64(32)) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    if n >= WINDOW:
        least, done = v, 1
        while done < WINDOW:
            least, done = np.minimum(least[:-done], least[done:]), 2 * done  # WINDOW is a power of two
        inside = r[:len(least)] == r[WINDOW - 1:WINDOW - 1 + len(least)]
        keep = np.zeros(n, bool)
        keep[(least[inside] & np.uint64((1 << 32) - 1)).astype(np.int64)] = True
    else:
        keep = np.zeros(n, bool)
    counts = np.bincount(r)
    keep |= counts[r] < WINDOW  # short texts keep all of theirs
    return r[keep], (at - first)[keep], g[keep].view(np.int64)


def _record(columns, names):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def seeds(docs: DataFrame) -> DataFrame:
    def run(it):
        for b in it:
            data, off = batch_bytes(b.column("text"))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi in slices(np.diff(off), BATCH):
                rows, _, _, h = words_of(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], folded=True)
                r, at, g = seeds_of(rows, h)
                yield _record([g, ids[lo:hi][r], at.astype(np.int32)], ["h", "doc_id", "at"])
    return docs.select("doc_id", "text").mapInArrow(run, "h long, doc_id long, at int")


def _linked(it):
    """Of rows ordered by seed, salt and document: links to the group's first row and to the row before; a group's first passes too."""
    first = last = None
    for b in it:
        k, salt, d, p = (b.column(c).to_numpy() for c in ("h", "salt", "doc_id", "at"))
        if not len(k):
            continue
        new = np.append(True, (k[1:] != k[:-1]) | (salt[1:] != salt[:-1]))
        carried = first is not None and first[0] == k[0] and first[1] == salt[0]
        new[0] = not carried
        start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        own = start >= 0
        fd = np.where(own, d[start], first[2] if carried else 0)
        fp = np.where(own, p[start], first[3] if carried else 0)
        bd, bp = np.append(last[0] if carried else 0, d[:-1]), np.append(last[1] if carried else 0, p[:-1])
        to_first = ~new & (fd != d)
        before = ~new & (bd != d) & (bd != fd)
        yield _record([np.concatenate([fd[to_first], bd[before]]), np.concatenate([d[to_first], d[before]]),
                       np.concatenate([fp[to_first], bp[before]]).astype(np.int32), np.concatenate([p[to_first], p[before]]).astype(np.int32)], ["a", "b", "at_a", "at_b"])
        first, last = (k[-1], salt[-1], int(fd[-1]), int(fp[-1])), (int(d[-1]), int(p[-1]))


LINK = "a long, b long, at_a int, at_b int"


def links(docs: DataFrame, gone: DataFrame = None) -> DataFrame:
    """(a, b, at_a, at_b), a < b: seeds in common.  Seeds that a sample shows in very many documents are dealt over salts first.

    Documents in ``gone`` (doc_id) leave before seeds are linked, so they take no partner's place.
    """
    sampled = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0)
    least = max(64, sampled.count() // HOT)
    hot = np.sort(np.array([r.h for r in seeds(sampled).groupBy("h").count().filter(F.col("count") > least).collect()], np.int64))  # HOT times a text's seeds at most
    # texts meet ``gone``, not their seeds, which are more; the merge keeps one plan at every size
    every = seeds(docs if gone is None else docs.join(gone.hint("merge"), "doc_id", "left_anti"))
    if not len(hot):
        return every.withColumn("salt", F.lit(0)).repartition("h").sortWithinPartitions("h", "doc_id", "at").mapInArrow(_linked, LINK)
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def flag(it):
        for b in it:
            h = b.column("h").to_numpy()
            at = np.minimum(np.searchsorted(known.value, h), len(known.value) - 1)
            yield _record([*b.columns, np.where(known.value[at] == h, b.column("doc_id").to_numpy() % SALTS, -1).astype(np.int32)], ["h", "doc_id", "at", "salt"])
    flagged = every.mapInArrow(flag, "h long, doc_id long, at int, salt int")
    dealt = flagged.repartition("h", "salt").sortWithinPartitions("h", "salt", "doc_id", "at").mapInArrow(_linked, LINK)
    heads = flagged.filter("salt >= 0").groupBy("h", "salt").agg(F.min(F.struct("doc_id", "at")).alias("m")).select("h", "m.doc_id", "m.at", F.lit(0).alias("salt"))
    return dealt.unionByName(heads.repartition("h").sortWithinPartitions("h", "doc_id", "at").mapInArrow(_linked, LINK))


def segments(at_a, at_b):
    """Seeds on one diagonal that overlap or touch, as (start_a, start_b, words)."""
    pairs = np.unique(np.stack([at_b - at_a, at_a]), axis=1)
    diagonal, at = pairs
    new = np.append(True, (diagonal[1:] != diagonal[:-1]) | (at[1:] - at[:-1] > SEED + WINDOW))
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(at)) - 1
    return at[start], at[start] + diagonal[start], at[end] - at[start] + SEED


class Fenwick:
    """Largest (value, index) over a prefix of places."""

    def __init__(self, n):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, i, value):
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i):
        got = (float("-inf"), -1)
        i += 1
        while i > 0:
            got = max(got, self.best[i])
            i -= i & -i
        return got


def chains(sa, sb, n):
    """Best collinear chains of segments, each segment in one chain at most: lists of indices.

    A segment's score is its words plus its best predecessor's score, less a cost for the change of diagonal.  Predecessors
    end before it, in its own or the last band of ``GAP`` words of both documents.  Each pair of bands has a Fenwick tree over
    ends in ``b`` that gives the one of the largest score corrected for its place, so a long chain further off can't hide a
    near one.
    """
    m = len(sa)
    trees, score, before = {}, [0.0] * m, [-1] * m
    events = sorted([(int(sa[i]), 1, i) for i in range(m)] + [(int(sa[i] + n[i]), 0, i) for i in range(m)])
    for _, begins, i in events:
        if begins:
            score[i] = float(n[i])
            band_a, band_b, place = int(sa[i]) // GAP, int(sb[i]) // GAP, int(sb[i]) % GAP
            for near_a in (band_a, band_a - 1):
                for near_b in (band_b, band_b - 1):
                    tree = trees.get((near_a, near_b))
                    j = tree.upto(place if near_b == band_b else GAP - 1)[1] if tree else -1
                    if j >= 0:
                        gained = score[j] - GAP_COST * abs(int(sb[i] - sb[j]) - int(sa[i] - sa[j]))
                        if gained > 0 and n[i] + gained > score[i]:
                            score[i], before[i] = n[i] + gained, j
        else:
            a, b = int(sa[i] + n[i]), int(sb[i] + n[i])
            key = (a // GAP, b // GAP)
            if key not in trees:
                trees[key] = Fenwick(GAP)
            trees[key].put(b % GAP, (score[i] + GAP_COST * (a + b), i))
    used, out = [False] * m, []
    for i in sorted(range(m), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _chained(it):
    """Chains of each pair of documents, from links in the order of pairs; one pair is held at a time."""
    import pyarrow as pa
    names = ["a", "b", "start_a", "end_a", "start_b", "end_b"]

    def out(rows):
        kinds = [pa.int64()] * 2 + [pa.int32()] * 4
        return _record([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def pair(a, b, x, y):
        sa, sb, n = segments(x.astype(np.int64), y.astype(np.int64))
        for c in chains(sa, sb, n):
            i, j = c[0], c[-1]
            if max(sa[j] + n[j] - sa[i], sb[j] + n[j] - sb[i]) + 2 * (SEED + WINDOW) >= LEAST:
                yield a, b, int(sa[i]), int(sa[j] + n[j]), int(sb[i]), int(sb[j] + n[j])
    held = [np.zeros(0, np.int64)] * 4
    for batch in it:
        cols = [np.concatenate([o, batch.column(c).to_numpy()]) for o, c in zip(held, ("a", "b", "at_a", "at_b"))]
        if not len(cols[0]):
            continue
        new = np.flatnonzero(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
        rows = []
        for s, e in zip(new[:-1], new[1:]):
            rows += pair(int(cols[0][s]), int(cols[1][s]), cols[2][s:e], cols[3][s:e])
        held = [c[new[-1]:] for c in cols]
        yield out(rows)
    if len(held[0]):
        yield out(list(pair(int(held[0][0]), int(held[1][0]), held[2], held[3])))


def _extended(x, y, ax, ay, step):
    """Words of exact agreement from a place on, in one direction."""
    n = 0
    while 0 <= ax < len(x) and 0 <= ay < len(y) and x[ax] == y[ay]:
        ax, ay, n = ax + step, ay + step, n + 1
    return n


def aligned(x, y, sa, ea, sb, eb):
    """(start_a, end_a, start_b, end_b, identity) of a chain in word hashes x and y: ends extended, the inside aligned.

    Single differing words at the ends are stepped over while agreement goes on behind them.
    """
    while True:
        n = _extended(x, y, sa - 1, sb - 1, -1)
        skip = 0 if n else _extended(x, y, sa - 2, sb - 2, -1)
        grown = n or (skip + 1 if skip >= 4 else 0)
        sa, sb = sa - grown, sb - grown
        if not grown:
            break
    while True:
        n = _extended(x, y, ea, eb, 1)
        skip = 0 if n else _extended(x, y, ea + 1, eb + 1, 1)
        grown = n or (skip + 1 if skip >= 4 else 0)
        ea, eb = ea + grown, eb + grown
        if not grown:
            break
    p, q = x[sa:ea], y[sb:eb]
    if len(p) == len(q) and (p == q).all():
        return sa, ea, sb, eb, 1.0
    return sa, ea, sb, eb, common_subsequence(p.tolist(), q.tolist()) / max(len(p), len(q))


def repeated_passages(docs: DataFrame, least=LEAST, identity=IDENTITY) -> DataFrame:
    """(doc_id, start, end, other_id, other_start, other_end, identity): passages of ``docs`` (doc_id, text) that repeat one of another document.

    Places are word indices, words being runs of letters and digits, lower-cased; ``other_id`` is smaller than ``doc_id``.  A copy
    of a whole text refers to the first of its kind and isn't compared further.  Null texts, null ids and texts under
    ``least`` words have no passages; rows alike have one result.
    """
    import pyarrow as pa
    own = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.unhex(F.md5("text")).alias("content"))
    first = own.groupBy("content").agg(F.min("doc_id").alias("first"))
    facts = shared_table(own.select("doc_id", "content", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).alias("words")).join(first, "content").drop("content").distinct(), "facts")
    later = facts.filter("doc_id > first")
    copies = later.filter(F.col("words") >= least).select("doc_id", F.lit(0).alias("start"), F.col("words").alias("end"), F.col("first").alias("other_id"),
                                                          F.lit(0).alias("other_start"), F.col("words").alias("other_end"), F.lit(1.0).alias("identity"))
    kept = own.select("doc_id", "text")
    gone = later.select("doc_id").distinct()
    linked = links(kept, gone)
    found = shared_table(linked.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_chained, "a long, b long, start_a int, end_a int, start_b int, end_b int"), "chains")

    def align(it):
        for b in it:
            words = []
            for c in ("x", "y"):
                data, off = batch_bytes(b.column(c))
                own_words = []
                for lo, hi in slices(np.diff(off), BATCH):
                    rows, _, _, h = words_of(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], folded=True)
                    cut = np.searchsorted(rows, np.arange(hi - lo + 1))
                    own_words += [h[s:e] for s, e in zip(cut[:-1], cut[1:])]
                words.append(own_words)
            rows = []
            for i, (x, y, spans) in enumerate(zip(*words, b.column("spans").to_pylist())):
                for s in spans:
                    got = aligned(x, y, *s)
                    if min(got[1] - got[0], got[3] - got[2]) >= least and got[4] >= identity:
                        rows.append((i, *got))
            rows = sorted(set(rows))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield _record([b.column("b").take(at), *[pa.array([r[k] for r in rows], pa.int32()) for k in (3, 4)], b.column("a").take(at), *[pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2)],
                           pa.array([r[5] for r in rows], pa.float64())], ["doc_id", "start", "end", "other_id", "other_start", "other_end", "identity"])
    pairs = found.groupBy("a", "b").agg(F.collect_list(F.array("start_a", "end_a", "start_b", "end_b")).alias("spans"))
    side = lambda name, text: kept.select(F.col("doc_id").alias(name), F.col("text").alias(text)).hint("merge")  # noqa: E731  one plan at every size
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    passages = both.select("a", "b", "spans", "x", "y").mapInArrow(align, "doc_id long, start int, end int, other_id long, other_start int, other_end int, identity double")
    return passages.unionByName(copies).dropDuplicates()


def op6_repeated_passages(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))
