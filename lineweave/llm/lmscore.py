"""Language-model scoring by cross-entropy difference.

A target model (documents labelled good and not toxic) and a background model (all documents) are bigram models over one
vocabulary, all different words of all texts, so that the models grow with the input.  They are matched: same order, same
smoothing, and the background's counts are scaled to the target's number of words.  A document's score is its mean loss
per word under the target less that under the background; low is target-like.

A text's different pairs of words are dealt out by pair, those that end in a rare word by that word, so one task sees all
texts of a pair and the counts that its loss needs.  Losses then add up by text.  Counts of the most frequent words and
pairs (``HOT_WORDS``, ``HOT_PAIRS``) are known to every task and their pairs stay where they are: that spreads the work and
leaves the models as they are.
"""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BASE, batch_bytes, mix64, shared_table, slices, table, words_of

PRIOR = 20.0  # words of unigram evidence added to each history
HOT_WORDS, HOT_PAIRS = 1 << 17, 1 << 18
SAMPLE = 8192           # documents that show which pairs are frequent, about; their counts come from all
BUCKET = 1 << 20        # words of text for each bucket of pairs, about
GROUP = 1 << 20         # texts for each group of sums, about; GROUPS at least
GROUPS = 64
BATCH = 1 << 22
START = (1 << 64) - 1   # the history of a text's first word
RARE = 1 << 63          # set in the code of a word that isn't among the frequent ones


def entries(h, words, classes):
    """Vocabulary entry of each word hash: its own, or the class it shares; without ``words`` the hash itself."""
    if words is None:
        return h
    at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
    known = words[at] == h if len(words) else np.zeros(len(h), bool)
    return np.where(known, at.astype(np.uint64), np.uint64(len(words)) + h % np.uint64(classes))


def _pieces(it, words, classes):
    """(batch, first row, end row, row of each word, its entry, begins a text, ends a text)."""
    for b in it:
        data, off = batch_bytes(b.column("text"))
        for lo, hi in slices(np.diff(off), BATCH):
            rows, _, _, h = words_of(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], folded=True)
            new = rows[1:] != rows[:-1]
            some = np.ones(min(len(h), 1), bool)
            yield b, lo, hi, rows, entries(h, words, classes), np.append(some, new), np.append(new, some)


def _flags(batch, lo, hi):
    return np.array(batch.column("target").slice(lo, hi - lo).to_pylist(), bool)


def _record(columns, names):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _added(parts):
    """Keys and summed columns of several (keys, columns)."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    out = np.zeros((parts[0][1].shape[0], len(keys)), np.int64)
    for row, values in zip(out, np.concatenate([v for _, v in parts], axis=1)):
        row += np.bincount(at, values, len(keys)).astype(np.int64)
    return keys, out


def word_counts(docs: DataFrame, words, classes) -> DataFrame:
    """(word, t, n, ht, hn): occurrences in target and all texts, and those that another word follows.  START has the last two only."""
    names = ["word", "t", "n", "ht", "hn"]

    def run(it):
        parts, held = [], 0
        for b, lo, hi, rows, e, begins, ends in _pieces(it, words, classes):
            if not len(e):
                continue
            wanted = _flags(b, lo, hi)[rows]
            keys, at = np.unique(e, return_inverse=True)
            sums = np.stack([np.bincount(at[m], minlength=len(keys)) for m in (wanted, slice(None), wanted & ~ends, ~ends)])
            starts = np.array([[0], [0], [(wanted & begins).sum()], [begins.sum()]])
            parts.append((np.append(keys, np.uint64(START)), np.append(sums, starts, axis=1)))
            held += len(keys)
            if held > 1 << 21:
                parts = [_added(parts)]
                held = len(parts[0][0])
                if held > 1 << 20:
                    yield _record([parts[0][0].view(np.int64), *parts[0][1]], names)
                    parts, held = [], 0
        if parts:
            keys, sums = _added(parts)
            yield _record([keys.view(np.int64), *sums], names)
    counts = docs.select("text", "target").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in names[1:]])


class Model:
    """Sizes of both models, and the counts of frequent words and pairs: bounded by ``HOT_WORDS`` and ``HOT_PAIRS``."""

    def __init__(self, counts: DataFrame, size, prior):
        total = counts.agg(F.sum("t"), F.sum("n"), F.count_if(F.col("n") > 0)).first()
        self.total, self.words = int(total[0] or 0), int(total[1] or 0)
        self.scale = self.total / max(self.words, 1)
        self.size, self.prior = size or int(total[2]), prior
        start = counts.filter(F.col("word") == -1).first()
        top = counts.filter("n > 0").orderBy(F.desc("n"), "word").limit(HOT_WORDS).toArrow()
        word = top.column("word").to_numpy().view(np.uint64)
        order = np.argsort(word)
        self.hot = word[order]
        t, n, ht, hn = (top.column(c).to_numpy()[order] for c in ("t", "n", "ht", "hn"))
        self.unigram = self.unigrams(t, n)
        # the start of a text is the entry after the last frequent word
        self.history = self.histories(np.append(ht, start.ht if start else 0), np.append(hn, start.hn if start else 0))
        self.pairs = np.zeros(0, np.uint64)

    def unigrams(self, t, n):
        """Smoothed share of words of these counts, times the prior: target, background."""
        below = max(self.total + self.size, 1)
        return self.prior * np.stack([(t + 1) / below, (n * self.scale + 1) / below])

    def histories(self, t, n):
        return np.log(np.stack([t + self.prior, n * self.scale + self.prior]))

    def losses(self, t, n, unigram):
        """-log of the numerators of p(word | history); what the histories add is in ``histories``."""
        return -np.log(np.stack([t, n * self.scale]) + unigram)

    def coded(self, e, begins):
        """(history, word) codes of each entry: the number of a frequent word, the marked hash of another."""
        if not len(e):
            return e, e
        at = np.minimum(np.searchsorted(self.hot, e), max(len(self.hot) - 1, 0))
        code = np.where(self.hot[at] == e, at.astype(np.uint64), e | np.uint64(RARE))
        before = np.append(code[:1], code[:-1])
        before[begins] = len(self.hot)
        return before, code

    def frequent(self, before, code):
        """(pair keys, places among the frequent pairs, or -1)."""
        key = mix64(before * np.uint64(BASE) + code)
        if not len(self.pairs):
            return key, np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return key, np.where(self.pairs[at] == key, at, -1)


def frequent_pairs(docs: DataFrame, n_docs, model, words, classes):
    """Keys of the pairs of frequent words that most sampled documents hold."""
    def run(it):
        for _, _, _, rows, e, begins, _ in _pieces(it, words, classes):
            before, code = model.coded(e, begins)
            known = code < RARE
            key = model.frequent(before[known], code[known])[0]
            _, at = np.unique(mix64(key + rows[known].astype(np.uint64) * np.uint64(BASE)), return_index=True)
            key, n = np.unique(key[at], return_counts=True)
            yield _record([key.view(np.int64), n], ["pair", "n"])
    share = int(1e6 * min(1.0, SAMPLE / max(n_docs, 1)))
    sampled = docs.filter(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < share).select("text")
    counts = sampled.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
    return np.sort(counts.orderBy(F.desc("n"), "pair").limit(HOT_PAIRS).toArrow().column("pair").to_numpy().view(np.uint64))


def frequent_counts(docs: DataFrame, model, words, classes):
    """(target, background) counts of the frequent pairs over all texts."""
    def run(it):
        sums = np.zeros((2, len(model.pairs)), np.int64)
        for b, lo, hi, rows, e, begins, _ in _pieces(it, words, classes):
            at = model.frequent(*model.coded(e, begins))[1]
            found = at >= 0
            sums[1] += np.bincount(at[found], minlength=sums.shape[1])
            sums[0] += np.bincount(at[found & _flags(b, lo, hi)[rows]], minlength=sums.shape[1])
        at = np.flatnonzero(sums[1])
        yield _record([at, sums[0][at], sums[1][at]], ["at", "t", "n"])
    out = np.zeros((2, len(model.pairs)), np.int64)
    if len(model.pairs):
        got = docs.select("text", "target").mapInArrow(run, "at long, t long, n long").groupBy("at").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).toArrow()
        out[:, got.column("at").to_numpy()] = got.column("t").to_numpy(), got.column("n").to_numpy()
    return out


def _packed(columns):
    """Integers of 64 bits as bytes, equal bytes of all values side by side, compressed."""
    import pyarrow as pa
    planes = np.stack(columns).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data, n, k):
    import pyarrow as pa
    planes = np.frombuffer(pa.decompress(data, n * k * 8, codec="zstd", asbytes=True), np.uint8).reshape(k, 8, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64).reshape(k, n)


def other_pairs(docs: DataFrame, shared, n_buckets, words, classes) -> DataFrame:
    """(bucket, n, data): pairs of each text that aren't frequent, as packed columns word, history, row and 4 x times + 2 x ends the text + target."""
    def flush(parts):
        c = np.concatenate(parts, axis=1)
        key = np.where(c[0] < RARE, mix64(c[1] * np.uint64(BASE) + c[0]), mix64(c[0]))
        bucket = (key % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0))
        ends = np.append(at[1:], len(order))
        yield _record([bucket[order][at], ends - at, [_packed(c[:, order[s:e]]) for s, e in zip(at, ends)]], ["bucket", "n", "data"])

    def run(it):
        model = shared.value
        parts, held = [], 0
        for b, lo, hi, rows, e, begins, ends in _pieces(it, words, classes):
            before, code = model.coded(e, begins)
            key, at = model.frequent(before, code)
            left = np.flatnonzero(at < 0)
            if not len(left):
                continue
            _, first, own = np.unique(mix64(key[left] + rows[left].astype(np.uint64) * np.uint64(BASE)), return_index=True, return_inverse=True)
            times, last = np.bincount(own), np.bincount(own, ends[left]).astype(np.int64)
            order = np.argsort(first)
            pick = left[first[order]]
            marks = 4 * times[order] + 2 * last[order] + _flags(b, lo, hi)[rows[pick]]
            row = b.column("row").to_numpy()[lo:hi][rows[pick]]
            parts.append(np.stack([code[pick], before[pick], row.astype(np.uint64), marks.astype(np.uint64)]))
            held += len(pick)
            if held > 1 << 20:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)
    return docs.select("row", "text", "target").mapInArrow(run, "bucket long, n long, data binary")


def _summed(at, values):
    return np.stack([np.add.reduceat(v, at) for v in values])


def _by_key(it, key):
    """(key, [(n, data)]) of packed rows that come in the order of their keys."""
    last, blobs = None, []
    for b in it:
        for k, n, d in zip(b.column(key).to_pylist(), b.column("n").to_pylist(), b.column("data")):
            if blobs and k != last:
                yield last, blobs
                blobs = []
            last = k
            blobs.append((n, d.as_buffer()))
    if blobs:
        yield last, blobs


def other_losses(packed: DataFrame, shared, n_groups) -> DataFrame:
    """(row, lt, lb): what the pairs of ``other_pairs`` add to each text.

    Buckets are settled one after the other; their sums by text go on in ``n_groups`` packed parts, and each group of texts adds up its own.
    """
    def settled(model, blobs):
        word, before, row, marks = np.concatenate([_unpacked(d, n, 4) for n, d in blobs], axis=1)
        order = np.lexsort((before, word))
        word, before, row, marks = word[order], before[order], row[order], marks[order].astype(np.int64)
        times, last, target = marks >> 2, marks >> 1 & 1, marks & 1
        new_word = np.append(True, word[1:] != word[:-1])
        new_pair = new_word | np.append(True, before[1:] != before[:-1])
        in_pair, in_word = np.cumsum(new_pair) - 1, np.cumsum(new_word) - 1
        t, n = _summed(np.flatnonzero(new_pair), (times * target, times))[:, in_pair]
        all_t, all_n, ht, hn = _summed(np.flatnonzero(new_word), (times * target, times, (times - last) * target, times - last))[:, in_word]
        rare = word >= RARE  # all its pairs are here; the counts of a frequent word are known
        unigram = model.unigrams(all_t, all_n)
        unigram[:, ~rare] = model.unigram[:, word[~rare].astype(np.int64)]
        loss = times * model.losses(t, n, unigram) + rare * (times - last) * model.histories(ht, hn)
        rows, at = np.unique(row, return_inverse=True)
        group = (mix64(rows) % np.uint64(n_groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        columns = np.stack([rows, *[np.bincount(at, x, len(rows)).view(np.uint64) for x in loss]])[:, order]
        starts = np.flatnonzero(np.append(True, np.diff(group[order]) > 0))
        ends = np.append(starts[1:], len(order))
        return _record([group[order][starts], ends - starts, [_packed(columns[:, s:e]) for s, e in zip(starts, ends)]], ["group", "n", "data"])

    def settle(it):
        for _, blobs in _by_key(it, "bucket"):
            yield settled(shared.value, blobs)

    def add(it):
        for _, blobs in _by_key(it, "group"):
            rows, sums = np.zeros(0, np.uint64), np.zeros((2, 0))
            for i in range(0, len(blobs), 64):
                part = np.concatenate([_unpacked(d, n, 3) for n, d in blobs[i:i + 64]], axis=1)
                rows, at = np.unique(np.append(rows, part[0]), return_inverse=True)
                sums = np.stack([np.bincount(at, np.append(x, y.view(np.float64)), len(rows)) for x, y in zip(sums, part[1:])])
            yield _record([rows.view(np.int64), *sums], ["row", "lt", "lb"])
    parts = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settle, "group long, n long, data binary")
    return parts.repartition("group").sortWithinPartitions("group").mapInArrow(add, "row long, lt double, lb double")


def frequent_losses(docs: DataFrame, shared, words, classes) -> DataFrame:
    """(row, doc_id, words, lt, lb): each text's words, and what frequent pairs and frequent histories add."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        model = shared.value
        for b, lo, hi, rows, e, begins, ends in _pieces(it, words, classes):
            before, code = model.coded(e, begins)
            at = model.frequent(before, code)[1]
            found = at >= 0
            loss = np.zeros((2, len(e)))
            if found.any():
                loss[:, found] = model.losses(*model.counts[:, at[found]], model.unigram[:, code[found].astype(np.int64)])
            known = before < RARE
            loss[:, known] += model.history[:, before[known].astype(np.int64)]
            yield _record([b.column("row").slice(lo, hi - lo), b.column("doc_id").slice(lo, hi - lo), np.bincount(rows, minlength=hi - lo), *[np.bincount(rows, x, hi - lo) for x in loss]],
                          ["row", "doc_id", "words", "lt", "lb"])
    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {id_type}, words long, lt double, lb double")


def score(docs: DataFrame, labels: DataFrame, own=None, classes=256, prior=PRIOR) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_words, loss_target, loss_background, score), means per word.

    One row per given row; a text without words has null losses.  ``labels`` (doc_id, quality, toxic): of several labels
    of a document every one must be good; nulls aren't.  Without target documents the target model is the prior alone.
    Every word is an entry of the vocabulary; with ``own`` only so many most frequent words are, and the rest shares
    ``classes`` by hash.
    """
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") >= 1) & (F.col("toxic") < 1), F.lit(False))).alias("target"))
    flagged = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")  # one plan at every size
    flagged = shared_table(flagged.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"), F.monotonically_increasing_id().alias("row")), "lm-texts")
    counts, words = shared_table(word_counts(flagged, None, classes), "lm-words"), None
    if own is not None:
        words = np.sort(np.array([r.word for r in counts.filter("n > 0").orderBy(F.desc("n"), "word").limit(own).collect()], np.int64).view(np.uint64))
        counts = shared_table(word_counts(flagged, words, classes), "lm-words")
    model = Model(counts, None if own is None else len(words) + classes, prior)
    n_docs = flagged.count()
    model.pairs = frequent_pairs(flagged, n_docs, model, words, classes)
    model.counts = frequent_counts(flagged, model, words, classes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = other_pairs(flagged, shared, max(1, model.words // BUCKET), words, classes)
    here = frequent_losses(flagged, shared, words, classes)
    there = other_losses(packed, shared, max(GROUPS, n_docs // GROUP)).select("row", F.lit(None).cast(here.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("words"), "lt", "lb")
    sums = here.unionByName(there).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("words").alias("n_words"), F.sum("lt").alias("lt"), F.sum("lb").alias("lb"))
    some = F.col("n_words") > 0
    means = [F.when(some, F.col(c) / F.col("n_words")).alias(name) for c, name in (("lt", "loss_target"), ("lb", "loss_background"))]
    return sums.select("doc_id", "n_words", *means).withColumn("score", F.col("loss_target") - F.col("loss_background"))


def op9_lm_scores(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
