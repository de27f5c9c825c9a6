"""Near-duplicates by Order MinHash, verified by banded alignment.

Texts are taken as sequences of five-word shingles, labelled by occurrence.  A sketch of a text holds, for each of
``TABLES`` hashes, its few smallest labelled shingles in text order, so that texts agree on it the likelier the more
shingles they share in the same order.  Sketches that agree propose pairs; a pair is a link if the longest common
subsequence L of the two shingle sequences within a diagonal band gives L / (m + n - L) of 0.8 or more (the band is as wide
as that bound allows, so it loses nothing).  Classes are the connected components of links and exact copies.

Copies are folded into one representative first.  A bucket of up to ``ALL_PAIRS`` texts proposes all its pairs; a larger
one proposes each text with the bucket's most central text and with its first, and the same again for the sketch of
``DEEP`` shingles, so pairs stay proportional to rows.  Pairs whose
sketches agree in fewer than ``AGREE`` tables go before texts are fetched, and pairs whose ends already share a class
aren't aligned again.  At last every pair of a larger bucket whose ends are still in different classes is proposed, so
no link is lost to the stars; a bucket of one class has no such pair.  Of those, a pair goes at once if the parities of its
texts' shingles differ in more bits than two texts of the bound can have shingles apart: each such shingle flips one bit.
"""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BASE, batch_bytes, grams, mix64, shared_table, slices, table, words_of

SHINGLE, SIMILARITY = 5, 0.8
TABLES, SHALLOW, DEEP = 24, 3, 10
AGREE = 3  # tables in which a link's sketches agree at least; at a similarity of 0.8 fewer have a chance of 5e-6
ALL_PAIRS = 12
SLICE = 2048  # texts outside a bucket's main class that meet the bucket in one task
PARITY = 1024  # bits of the parity of a text's shingles
BATCH = 1 << 21
_ODD = (mix64(np.arange(1, TABLES + 1, dtype=np.uint64)) | np.uint64(1))[:, None]


def labelled_shingles(rows, h, n_rows):
    """Row bounds and hashes of the labelled shingles, in text order; a text of one to four words is one shingle."""
    at, g = grams(h, rows, SHINGLE)
    r = rows[at]
    counts = np.bincount(rows, minlength=n_rows)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        first = np.searchsorted(rows, few)
        odd = np.arange(1, 2 * SHINGLE, 2, dtype=np.uint64) * np.uint64(BASE)
        short = mix64(np.array([np.add.reduce(h[f:f + counts[i]] * odd[:counts[i]]) for i, f in zip(few, first)], np.uint64))
        order = np.argsort(np.concatenate([r, few]), kind="stable")
        r, g = np.concatenate([r, few])[order], np.concatenate([g, short])[order]
    order = np.lexsort((g, r))
    same = np.zeros(len(g), bool)
    same[1:] = (g[order][1:] == g[order][:-1]) & (r[order][1:] == r[order][:-1])
    starts = np.flatnonzero(~same)
    nth = np.empty(len(g), np.uint64)
    nth[order] = (np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))).astype(np.uint64)
    return np.searchsorted(r, np.arange(n_rows + 1)), mix64(g + nth * np.uint64(BASE))


def sketch(x):
    """(shallow, deep) keys of one text's labelled shingles, one per table."""
    v = x[None, :] * _ODD
    keys = []
    n = len(x)
    where = np.argpartition(v, [k - 1 for k in (SHALLOW, DEEP) if k < n], axis=1) if n > SHALLOW else np.broadcast_to(np.arange(n), v.shape)
    for k in (SHALLOW, DEEP):
        own = np.sort(where[:, :k], axis=1)
        key = np.arange(1, TABLES + 1, dtype=np.uint64)
        for j in range(own.shape[1]):
            key = key * np.uint64(BASE) + x[own[:, j]]
        keys.append(mix64(key).view(np.int64))
    return keys


def parity(x):
    """The labelled shingles counted modulo 2 in ``PARITY`` bits: two texts differ in no more bits than they have shingles apart."""
    odd = np.bincount((x & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(rep, content, shallow, deep, parity, n) of each different text with words, in one pass; copies are folded map-side."""
    import pyarrow as pa
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        for b in it:
            data, off = batch_bytes(b.column("text"))
            for lo, hi in slices(np.diff(off), BATCH):
                rows, _, _, h = words_of(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                bounds, x = labelled_shingles(rows, h, hi - lo)
                got = [(*sketch(x[s:e]), parity(x[s:e])) if e > s else None for s, e in zip(bounds[:-1], bounds[1:])]
                keep = [i for i, g in enumerate(got) if g is not None]
                take = pa.array([lo + i for i in keep], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("content").take(take),
                    *[pa.array([got[i][j] for i in keep], pa.list_(pa.int64())) for j in (0, 1, 2)], pa.array(np.diff(bounds)[keep])], ["doc_id", "content", "shallow", "deep", "parity", "n"])
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("content"), "text")
    rows = rows.mapInArrow(run, f"doc_id {id_type}, content binary, shallow array<long>, deep array<long>, parity array<long>, n long")
    return rows.groupBy("content").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("shallow", "deep", "parity", "n")]).filter("rep IS NOT NULL")


def buckets(reps: DataFrame) -> DataFrame:
    """(shallow, rep, deep, size, first): texts of each bucket of more than one."""
    b = reps.select("rep", F.explode(F.arrays_zip("shallow", "deep")).alias("k")).select("rep", "k.shallow", "k.deep")
    sizes = b.groupBy("shallow").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first")).filter("size > 1")
    return shared_table(b.join(sizes, "shallow"), "buckets")


def proposed(reps: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, votes): pairs, a < b, proposed by small buckets and by the stars of large ones, and in how many tables their sketches agree."""
    reach = b.groupBy("rep").agg(F.sum("size").alias("reach"))
    small = b.filter(F.col("size") <= ALL_PAIRS).select("shallow", "rep")
    pairs = small.join(small.withColumnRenamed("rep", "other"), "shallow").filter("rep < other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    large = shared_table(b.filter(F.col("size") > ALL_PAIRS).join(reach, "rep"), "large")
    central = large.groupBy("shallow").agg(F.max(F.struct("reach", (-F.col("rep")).alias("r")))["r"].alias("r"))
    deep = large.groupBy("deep").agg(F.min("rep").alias("p"), F.max(F.struct("reach", (-F.col("rep")).alias("r")))["r"].alias("r"))
    stars = [large.select(F.col("first").alias("p"), "rep"), large.join(central, "shallow").select((-F.col("r")).alias("p"), "rep")]
    joined = large.select("rep", "deep").join(deep, "deep")
    stars += [joined.select("p", "rep"), joined.select((-F.col("r")).alias("p"), "rep")]
    for s in stars:
        pairs = pairs.unionByName(s.filter("p <> rep").select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b")))
    pairs = pairs.distinct()
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("rep").alias(side), F.col("shallow").alias(f"s{side}")), side)
    votes = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda v, x: v + x)
    return pairs.select("a", "b", votes.alias("votes")).filter(F.col("votes") >= AGREE)


def within(px, py, nx, ny):
    """Whether two texts of these parities and numbers of shingles may reach the bound; true wherever they do."""
    apart = sum((F.bit_count(F.get(px, F.lit(i)).bitwiseXOR(F.get(py, F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    most = (nx + ny) * ((1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9)  # L is 0.8 / 1.8 of both at least
    return (F.abs(nx - ny) <= most) & (apart <= most)


def unproposed(reps: DataFrame, b: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of large buckets whose ends are in different classes and whose sketches agree often enough.

    The texts outside a bucket's main class meet the whole bucket, in slices of ``SLICE`` of them.  Sketches travel with the
    texts and a pair leaves only the first table it agrees in, so neither pairs nor votes are shuffled.  Parities, where
    ``reps`` has them, let only those leave that may reach the bound.
    """
    large = b.filter(F.col("size") > ALL_PAIRS).select("shallow", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class", F.coalesce("label", "rep")).drop("label")
    main = large.groupBy("shallow", "class").count().groupBy("shallow").agg(F.max_by("class", F.struct("count", "class")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    main = main.filter("most < n").select("shallow", "main", F.ceil((F.col("n") - F.col("most")) / SLICE).cast("int").alias("slices"))
    marks = [c for c in ("parity", "n") if c in reps.columns]
    some = shared_table(large.join(main, "shallow").join(reps.select("rep", F.col("shallow").alias("keys"), *marks), "rep"), "crowded")
    left = some.filter("class <> main").select("shallow", F.pmod(F.hash("rep"), "slices").alias("slice"), F.col("rep").alias("x"), F.col("class").alias("cx"), F.col("keys").alias("kx"), *[F.col(c).alias(f"{c}_x") for c in marks])
    right = some.select("shallow", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("rep").alias("y"), F.col("class").alias("cy"), (F.col("class") == F.col("main")).alias("in_main"), "keys", *marks)
    near = within(*[F.col(c) for c in ("parity_x", "parity", "n_x", "n")]) if marks else F.lit(True)
    met = left.join(right, ["shallow", "slice"]).filter(F.expr("cx <> cy AND (in_main OR x < y)") & near).withColumn("same", F.array_intersect("kx", "keys"))
    return met.filter((F.size("same") >= AGREE) & (F.get("same", F.lit(0)) == F.col("shallow"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similarity(x, y, least=SIMILARITY):
    """L / (m + n - L) of two sequences of distinct labelled shingles, by banded bit-vector alignment; 0 if it can't reach ``least``."""
    m, n = len(x), len(y)
    if not m or not n:
        return 0.0
    most = np.intersect1d(x, y, assume_unique=True).size
    if most < least * (m + n - most):
        return 0.0
    k = min(m, n)
    differ = np.flatnonzero(x[:k] != y[:k])
    head = int(differ[0]) if len(differ) else k
    k -= head
    differ = np.flatnonzero(x[m - k:][::-1] != y[n - k:][::-1]) if k else []
    tail = int(differ[0]) if len(differ) else k
    a, b = x[head:m - tail].tolist(), y[head:n - tail].tolist()
    common = head + tail
    if a and b:
        band = int((m + n) * (1 - 2 * least / (1 + least))) + 1  # insertions and deletions that the bound leaves
        where = {v: i for i, v in enumerate(a)}
        v = full = (1 << len(a)) - 1
        for j, w in enumerate(b):
            i = where.get(w)
            if i is not None and abs(i - j) <= band:
                u = v & 1 << i
                v = (v + u | v - u) & full
        common += len(a) - v.bit_count()
    return common / (m + n - common)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the bound; ``texts`` (rep, text)."""
    import pyarrow as pa
    both = (pairs.select("a", "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a")
            .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b"))

    def shingled(column):
        data, off = batch_bytes(column)
        for lo, hi in slices(np.diff(off), BATCH):
            rows, _, _, h = words_of(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            bounds, g = labelled_shingles(rows, h, hi - lo)
            yield from (g[s:e] for s, e in zip(bounds[:-1], bounds[1:]))

    def run(it):
        for b in it:
            s = np.array([similarity(x, y) for x, y in zip(shingled(b.column("x")), shingled(b.column("y")))])
            keep = pa.array(np.flatnonzero(s >= SIMILARITY))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep), pa.array(s[s >= SIMILARITY], pa.float64())], ["a", "b", "similarity"])
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, by neighbours' least label and pointer jumps."""
    both = shared_table(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = shared_table(both.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("end"))
        moved = shared_table(stepped.join(jump, "to", "left").select("node", F.col("label").alias("was"), F.least("to", "end").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("label < was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, class_id); the class id is the least document id of the class.

    One row per given row.  Texts without words and null texts are classes of their own; a null id is in its text's class.
    """
    reps = shared_table(sketches(docs), "sketches")
    crowds = buckets(reps)
    pairs = shared_table(proposed(reps, crowds), "pairs")

    def texts_of(pairs):
        ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        texts = docs.select(F.col("doc_id").alias("rep"), "text", F.unhex(F.md5("text")).alias("content")).join(ids.hint("merge"), "rep")  # one plan at every size
        return shared_table(texts.join(reps.select("rep", "content"), ["rep", "content"], "left_semi").dropDuplicates(["rep"]).select("rep", "text"), "texts")
    texts = texts_of(pairs)
    # first the pair of each text that most tables propose, then what joins different classes
    best = pairs.groupBy("b").agg(F.max(F.struct("votes", (-F.col("a")).alias("a")))["a"].alias("a")).select((-F.col("a")).alias("a"), "b")
    links = shared_table(verified(best, texts), "links")
    labels = components(links)
    proposed_ids = pairs.select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left")
    rest = pairs.filter("coalesce(la, a) <> coalesce(lb, b)").join(best, ["a", "b"], "left_anti")
    more = shared_table(verified(rest, texts), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    rest = shared_table(unproposed(reps, crowds, labels).join(proposed_ids, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = shared_table(verified(rest, texts_of(rest)), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    classes = reps.join(labels, reps.rep == labels.node, "left").select("content", F.coalesce("label", "rep").alias("class"))
    own = docs.select("doc_id", F.unhex(F.md5("text")).alias("content"))
    return own.join(classes, "content", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))


def op5_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
