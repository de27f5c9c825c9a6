"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to ``FEATURES`` columns.  A randomised SVD of the TF-IDF matrix ``A`` of all passages gives the latent
axes: one pass over the texts sums ``A'A``, a table of ``FEATURES`` rows, which the distributed products ``(A'A) X`` read.  Passages of documents and all items
are folded into the latent space: a passage's vector is a difference of running sums, so windows of any place and length
cost one lookup per word.  Items meet the passages in blocks by a matrix product; pairs of sufficient cosine are checked
by the longest common subsequence of their words and by the item's answer.  Passages that hold fewer of an item's words
than that subsequence needs are left out before: an exact bound, from one product of segments and items by words.
"""
import collections

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_bytes, shared_table, slices, table, words_of

FEATURES, RANK, POWER = 4096, 128, 2
PASSAGE = 64          # words of a passage that the axes are fitted on
GATHERED = 1 << 17    # passages, about, whose products one task adds up: a task leaves FEATURES rows, however many passages it had
COSINE, LCS, ANSWER = 0.4, 0.6, 0.6  # items of 15 to 59 words with 62% kept, put into sf0.1 texts, reach the cosine in 98% of the cases
BLOCK = 2048          # items that meet the documents in one pass
BATCH = 1 << 21       # bytes of text that one numpy step takes
STEP = 4              # words between the starts of windows; a window is some steps long
FOLDED = 4096         # columns of words in the bound; words beyond share columns, which only raises it


def _feature(h):
    return (h >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def _batches(it, ids):
    """(ids, words) of bounded pieces of Arrow batches, whole rows."""
    for b in it:
        data, off = batch_bytes(b.column("text"))
        keys = b.column(ids)
        for lo, hi in slices(np.diff(off), BATCH):
            yield keys[lo:hi], words_of(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], folded=True)


def _arrow(columns, schema):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def _counts(docs: DataFrame):
    """(number of texts, of passages, IDF of each hashed feature) over all texts: tasks add up their counts, Spark adds the tasks'."""
    import pyarrow as pa

    def run(it):
        total, n, passages = np.zeros(FEATURES, np.int64), 0, 0
        for keys, (rows, _, _, h) in _batches(it, "text"):
            n += len(keys)
            passages += int((-(-np.bincount(rows) // PASSAGE)).sum())
            f = _feature(h)
            for lo in range(0, len(keys), 1024):
                a, z = np.searchsorted(rows, (lo, lo + 1024))
                held = np.zeros((min(1024, len(keys) - lo), FEATURES), np.uint16)
                held[rows[a:z] - lo, f[a:z]] = 1
                total += held.sum(0, dtype=np.uint16)  # 1,024 rows at most
        at = np.flatnonzero(total)
        yield _arrow([np.append(at, [-1, -2]), np.append(total[at], [n, passages])], [("feature", pa.int64()), ("n", pa.int64())])
    counts = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # FEATURES + 2 rows at most
    by = {r.feature: r.n for r in counts}
    n, passages = by.pop(-1, 0), by.pop(-2, 0)
    idf = np.full(FEATURES, np.log(1.0 + n))
    for f, c in by.items():
        idf[f] = np.log((1.0 + n) / (1.0 + c))
    return n, passages, idf.astype(np.float32)


def document_frequencies(docs: DataFrame):
    """(number of texts, IDF of each hashed feature) over all texts."""
    n, _, idf = _counts(docs)
    return n, idf


def _unit_rows(it, idf, size):
    """(features, weights, row lengths) of bounded pieces: unit TF-IDF rows of every passage of ``size`` words, features ascending."""
    for _, (rows, _, _, h) in _batches(it, "text"):
        if len(h):
            place = np.arange(len(h)) - np.searchsorted(rows, rows)
            passage = np.cumsum(place % size == 0) - 1
            key, tf = np.unique(passage * FEATURES + _feature(h), return_counts=True)
            f, starts = key % FEATURES, np.flatnonzero(np.append(True, np.diff(key // FEATURES) > 0))
            lengths = np.diff(np.append(starts, len(key)))
            w = tf * idf[f]
            w /= np.repeat(np.maximum(np.sqrt(np.add.reduceat(w * w, starts)), 1e-9), lengths)
            yield f, w.astype(np.float32), lengths


def sample_passages(docs: DataFrame, idf, size, share=1.0):
    """(features, weights) of every passage of ``size`` words; there is no other ``share`` than all."""
    import pyarrow as pa
    if share != 1:
        raise ValueError("the axes are fitted on all passages")

    def run(it):
        for f, w, lengths in _unit_rows(it, idf, size):
            ends = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(f.astype(np.int16))), pa.ListArray.from_arrays(ends, pa.array(w))], ["features", "weights"])
    return docs.select("text").mapInArrow(run, "features array<short>, weights array<float>")


def _add_products(total, f, w, lengths):
    """Adds the products of every two features of a row (first, not after second) to the flat ``total``; features ascend in a row."""
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[lengths > 0]):
        i, j = np.triu_indices(n)
        first = starts[lengths == n]
        for lo in range(0, len(first), 64):
            at = first[lo:lo + 64, None] + np.arange(n)
            ff, ww = f[at], w[at]
            np.add.at(total, (ff[:, i] * FEATURES + ff[:, j]).ravel(), (ww[:, i] * ww[:, j]).ravel())


def gram(passages: DataFrame, idf=None) -> DataFrame:
    """(feature, row): upper triangle of the passages' A'A, row by row, as bytes of float32.  Each partition leaves one triangle.

    ``passages``: features and weights, or, with ``idf``, the texts whose passages are meant.
    """
    import pyarrow as pa
    schema = [("feature", pa.int64()), ("row", pa.binary())]

    def rows_of(it):
        for b in it:
            f, w = b.column("features"), b.column("weights")
            yield f.flatten().to_numpy(zero_copy_only=False).astype(np.int64), w.flatten().to_numpy(zero_copy_only=False).astype(np.float32), f.value_lengths().to_numpy(zero_copy_only=False)

    def products(it):
        total = np.zeros(FEATURES * FEATURES, np.float32)
        for f, w, lengths in rows_of(it) if idf is None else _unit_rows(it, idf, PASSAGE):
            _add_products(total, f, w, lengths)
        total = total.reshape(FEATURES, FEATURES)
        for lo in range(0, FEATURES, 64):
            at = lo + np.flatnonzero(total[lo:lo + 64].any(1))
            if len(at):
                yield _arrow([at, [total[i, i:].tobytes() for i in at]], schema)

    def add(it):
        sums = {}
        for b in it:
            for i, row in zip(b.column("feature").to_pylist(), b.column("row")):
                row = np.frombuffer(row.as_buffer(), np.float32)
                if i in sums:
                    sums[i] += row
                else:
                    sums[i] = row.astype(np.float64)
        at = list(sums)
        for lo in range(0, len(at), 256):
            yield _arrow([at[lo:lo + 256], [sums[i].astype(np.float32).tobytes() for i in at[lo:lo + 256]]], schema)
    kind = "feature long, row binary"
    return passages.mapInArrow(products, kind).repartition("feature").mapInArrow(add, kind)


def latent_axes(passages: DataFrame, rank=RANK, power=POWER, seed=5, idf=None):
    """FEATURES x rank axes of the matrix A of ``gram``'s passages: subspace iteration with (A'A) X, a distributed sum per step."""
    import pyarrow as pa
    triangle = shared_table(gram(passages, idf), "gram")  # FEATURES rows at most

    def product(x):
        def run(it):
            total = np.zeros(x.shape)
            for b in it:
                at = b.column("feature").to_numpy()
                for lo in range(0, len(at), 256):
                    rows = np.zeros((min(256, len(at) - lo), FEATURES), np.float32)
                    for k, row in enumerate(b.column("row")[lo:lo + 256]):
                        rows[k, at[lo + k]:] = np.frombuffer(row.as_buffer(), np.float32)
                    mine = at[lo:lo + 256]
                    np.add.at(total, mine, rows @ x)
                    rows[np.arange(len(mine)), mine] = 0  # the diagonal counts once
                    total += rows.T @ x[mine]
            yield _arrow([np.arange(FEATURES), list(total)], [("feature", pa.int64()), ("row", pa.list_(pa.float64()))])
        k = x.shape[1]
        parts = triangle.mapInArrow(run, "feature long, row array<double>")
        sums = parts.groupBy("feature").agg(*[F.sum(F.get("row", F.lit(j))).alias(f"c{j}") for j in range(k)])
        got = sums.toArrow()  # FEATURES rows of k numbers
        y = np.zeros((FEATURES, k))
        y[got.column("feature").to_numpy()] = np.column_stack([got.column(f"c{j}").to_numpy() for j in range(k)]) if got.num_rows else 0
        return y
    q = np.random.default_rng(seed).standard_normal((FEATURES, rank + 8)).astype(np.float32)
    for _ in range(power):
        q = np.linalg.qr(product(q))[0].astype(np.float32)
    small = q.T @ product(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-values)[:rank]
    return (q @ vectors[:, keep] / np.sqrt(np.sqrt(np.maximum(values[keep], 1e-9)))).astype(np.float32)


def common_subsequence(a, b):
    """Length of the longest common subsequence of two word arrays, by bit-vectors."""
    return _common(_places(a), len(a), b)


def _places(a):
    where = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def _common(where, n, b):
    v = full = (1 << n) - 1
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


class Items:
    """A block of benchmark items with latent vectors, words and answers; words are numbered by ``vocabulary``."""

    def __init__(self, ids, texts, answers, axes):
        self.ids = ids
        hashed = [_hashes(t) for t in texts]
        # without an answer column the item's last quarter of words stands for it
        right = [_hashes(a) if a else h[-max(1, len(h) // 4):] for a, h in zip(answers, hashed)]
        self.vocabulary = np.unique(np.concatenate([*hashed, *right, np.zeros(0, np.uint64)]))
        self.lengths = [len(h) for h in hashed]
        self.words = [self.numbered(h).tolist() for h in hashed]
        self.bags = [collections.Counter(w) for w in self.words]
        self.holds = np.zeros((len(ids), len(self.vocabulary) + 1), bool)  # the last column stands for words of no item
        for i, w in enumerate(self.words):
            self.holds[i, w] = True
        self.needs = np.zeros((min(FOLDED, max(1, len(self.vocabulary))), len(ids)), np.float32)
        for i, w in enumerate(self.words):
            np.add.at(self.needs[:, i], np.array(w, np.int64) % len(self.needs), 1)
        self.places = [_places(w) for w in self.words]
        self.answers = [self.numbered(h).tolist() for h in right]
        self.vectors = np.zeros((len(ids), axes.shape[1]), np.float32)
        for i, h in enumerate(hashed):
            if len(h):
                self.vectors[i] = axes[_feature(h)].sum(0)
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-9)

    def numbered(self, h):
        """Numbers of word hashes, -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def shares(self, i, part, least):
        """LCS share and answer share of item ``i`` in the numbered words ``part``; zeros where too few of its words are there."""
        left, common = dict(self.bags[i]), 0
        for w in part:  # words in common, as often as both have them: a common subsequence isn't longer
            if left.get(w):
                left[w] -= 1
                common += 1
        if common < least * self.lengths[i]:
            return 0.0, 0.0
        a = self.answers[i]
        return _common(self.places[i], self.lengths[i], part) / self.lengths[i], common_subsequence(a, part) / len(a) if a else 1.0


    def possible(self, numbers, offset, segment, of_word, n_segments, least):
        """Segments x items: could a segment of two lengths hold enough of an item's words, however ordered?

        ``offset``: a word's place in its row; a word stands in segment ``of_word`` and, past the first length, in the one before.
        """
        known = numbers >= 0
        columns = numbers[known] % len(self.needs)
        mine, again = of_word[known], offset[known] >= segment
        bound = least * np.array(self.lengths) - 1e-6
        out = np.zeros((n_segments, len(self.ids)), bool)
        order = np.argsort(mine, kind="stable")
        mine, columns, again = mine[order], columns[order], again[order]
        for lo in range(0, n_segments, 2048):
            hi = min(lo + 2048, n_segments)
            a, z = np.searchsorted(mine, (lo, hi + 1))  # words of the segment after the last stand in it too
            holds = np.zeros((hi - lo, len(self.needs)), np.float32)
            inside = mine[a:z] < hi
            holds[mine[a:z][inside] - lo, columns[a:z][inside]] = 1
            before = again[a:z] & (mine[a:z] - 1 >= lo)
            holds[mine[a:z][before] - 1 - lo, columns[a:z][before]] = 1
            out[lo:hi] = holds @ self.needs >= bound
        return out


def _hashes(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]), folded=True)[3]


def _blocks(rows, n_rows):
    """First words of the blocks of ``STEP`` words of each row, and each row's first block."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    counts = -(-np.diff(bounds) // STEP)
    first = np.append(0, np.cumsum(counts))
    own = np.repeat(np.arange(n_rows), counts)
    return bounds[own] + (np.arange(first[-1]) - first[own]) * STEP, first, own


def retrieve(docs: DataFrame, items: Items, axes, cosine=COSINE, lcs=LCS, answer=ANSWER, exhaustive=False) -> DataFrame:
    """(doc_id, item_id, start_word, cosine, lcs, answer) of each checked pair of document and item, its best window.

    ``axes`` holds the IDF already.  Items meet windows of their own length rounded up to 8 words, and, for items
    with words put in between, of that rounded up to a power of two; windows start at every quarter of their size.
    ``exhaustive`` checks every pair, to measure the recall of the cosine search.
    """
    import pyarrow as pa
    classes = {}
    for i, n in enumerate(items.lengths):
        if n:
            for size in {-(-n // 8) * 8, max(8, 1 << int(n - 1).bit_length())}:
                classes.setdefault(size // STEP, []).append(i)

    lengths = np.array(items.lengths)
    padded = np.vstack([axes, np.zeros((1, axes.shape[1]), axes.dtype)])
    # a window with its margins lies within one segment of two of these lengths
    reach = max([size * STEP + 2 * (items.lengths[i] // 2) for size, members in classes.items() for i in members], default=STEP)

    def run(it):
        schema = [("doc_id", docs_type), ("item_id", item_type), ("start_word", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]
        for keys, (rows, _, _, h) in _batches(it, "doc_id"):
            if not len(h):
                continue
            numbered = items.numbered(h)
            begins = np.searchsorted(rows, np.arange(len(keys)))
            offset = np.arange(len(h)) - begins[rows]
            segments = np.maximum(1, -(-np.bincount(rows, minlength=len(keys)) // reach))
            head = np.append(0, np.cumsum(segments))
            of_word = head[rows] + offset // reach
            if exhaustive:
                possible = np.ones((head[-1], len(items.ids)), bool)
            else:
                possible = items.possible(numbered, offset, reach, of_word, head[-1], lcs)
                some = np.flatnonzero(np.maximum.reduceat(possible.any(1), head[:-1]))  # rows with a passage to look at
                if not len(some):
                    continue
                kept = np.isin(rows, some)
                rows, h, numbered = np.searchsorted(some, rows[kept]), h[kept], numbered[kept]
                possible = possible[np.isin(np.repeat(np.arange(len(keys)), segments), some)]
                keys, segments = keys.take(pa.array(some)), segments[some]
                head = np.append(0, np.cumsum(segments))
            starts, first, own = _blocks(rows, len(keys))
            word_end = np.searchsorted(rows, np.arange(len(keys)), "right")
            word_start = np.searchsorted(rows, np.arange(len(keys)))
            # sums run over the blocks that a window of a segment with a passage to look at can hold: its own and the next one's
            live = possible.any(1)
            live[1:] |= live[:-1]
            segment = head[own] + (starts - word_start[own]) // reach
            held = live[segment] | live[np.minimum(head[own] + (starts + STEP - 1 - word_start[own]) // reach, head[own + 1] - 1)]
            place_of = np.append(0, np.cumsum(held))
            s = starts[held]
            sums = np.zeros((len(s) + 1, axes.shape[1]))
            features = np.append(_feature(h), np.full(STEP, FEATURES))  # a row of zeros stands after a row's end
            ends = np.minimum(s + STEP, word_end[own[held]])
            block = padded[features[s]]
            for j in range(1, STEP):
                block += padded[np.where(s + j < ends, features[s + j], FEATURES)]
            np.cumsum(block, axis=0, out=sums[1:])
            numbers = numbered.tolist()
            best = {}
            for size, members in classes.items():
                # windows begin at every block, from a row's last whole window on only at its start
                last = np.maximum(first[1:] - size, first[:-1])[own]
                s = np.flatnonzero(np.arange(len(starts)) <= last)
                s = s[(s - first[own[s]]) % max(1, size // 4) == 0]
                tail = np.unique(last)
                s = np.union1d(s, tail)
                half = max(items.lengths[i] for i in members) // 2
                of_window = head[own[s]] + np.maximum(starts[s] - half - word_start[own[s]], 0) // reach
                members = np.array(members)
                alive = possible[:, members].any(1)[of_window]
                s, of_window = s[alive], of_window[alive]
                e = np.minimum(s + size, first[own[s] + 1])
                for at in range(0, len(s), 16384):
                    ss, ee = s[at:at + 16384], e[at:at + 16384]
                    z = (sums[place_of[ee]] - sums[place_of[ss]]).astype(np.float32)
                    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                    scores = z @ items.vectors[members].T
                    near = np.argwhere((scores >= (-2 if exhaustive else cosine)) & possible[np.ix_(of_window[at:at + 16384], members)])
                    for lo in range(0, len(near), 16384):
                        w, j = near[lo:lo + 16384].T
                        i, row, begin = members[j], own[ss[w]], starts[ss[w]]
                        half = lengths[i] // 2
                        a, z = np.maximum(begin - half, word_start[row]), np.minimum(np.minimum(begin + size * STEP, word_end[row]) + half, word_end[row])
                        # words of the part that the item holds: fewer than the subsequence needs leave nothing to compare
                        place = a[:, None] + np.arange((z - a).max())
                        inside = items.holds[i[:, None], np.where(place < z[:, None], numbered[np.minimum(place, len(h) - 1)], -1)].sum(1)
                        for k in np.flatnonzero(inside >= lcs * lengths[i]).tolist():
                            i_k, row_k = int(i[k]), int(row[k])
                            share, right = items.shares(i_k, numbers[a[k]:z[k]], lcs)
                            if share >= lcs and right >= answer:
                                key, got = (row_k, i_k), (share, right, float(scores[w[k], j[k]]), int(begin[k] - word_start[row_k]))
                                best[key] = max(best.get(key, got), got)
            if best:
                yield _arrow([keys.take(pa.array([k[0] for k in best])).to_pylist(), [items.ids[k[1]] for k in best], [v[3] for v in best.values()],
                              [v[2] for v in best.values()], [v[0] for v in best.values()], [v[1] for v in best.values()]], schema)
    from pyspark.sql.pandas.types import to_arrow_type
    docs_type, item_type = to_arrow_type(docs.schema["doc_id"].dataType), pa.int64()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, start_word long, cosine double, lcs double, answer double")


def leaks(docs: DataFrame, benchmark: DataFrame, block=BLOCK, cosine=COSINE, lcs=LCS, answer=ANSWER) -> DataFrame:
    """Pairs of documents (doc_id, text) and benchmark items (item_id, text, and answer where there is one).

    A pair is there if a window of the document passes cosine, LCS and answer shares; repeated rows repeat their pairs, and
    items alike are items of their own.  Null and empty texts have no pairs; empty tables give an empty result.  Items
    are read in blocks of ``block``, each of which passes over the documents once.
    """
    texts = docs.select("text").unionByName(benchmark.select("text"))
    _, passages, idf = _counts(texts)
    axes = latent_axes(texts.coalesce(max(1, -(-passages // GATHERED))), idf=idf)
    weighted = axes * (idf * idf)[:, None]  # TF-IDF rows, and the IDF again so that rare words tell windows apart
    columns = ["item_id", "text"] + (["answer"] if "answer" in benchmark.columns else [])
    ordered = shared_table(benchmark.select(*columns), "items")
    out, parts = None, max(1, -(-ordered.count() // block))
    for part in range(parts):
        rows = ordered.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect() if parts > 1 else ordered.collect()
        items = Items([r.item_id for r in rows], [r.text for r in rows], [r["answer"] if "answer" in columns else None for r in rows], weighted)
        found = retrieve(docs, items, weighted, cosine, lcs, answer)
        out = found if out is None else out.unionByName(found)
    return out


def op7_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
