"""Removal of repeated 50-byte strings with suffix arrays made by two-stage sorting.

Every string of ``LENGTH`` bytes holds an anchor: the least hash among its ``GRAM``-byte grams, the leftmost at ties.  Equal
strings have equal anchors, so only strings of an anchor found in two documents can repeat.  Anchors are counted first
(a hash and a document id each); then the documents cut, around each shared anchor, the fragment of text whose strings
it governs, and fragments meet by anchor.

A task takes whole anchor groups in chunks and sorts the fragments' suffixes in two stages: those smaller than their
successors are sorted directly, the others are induced by scanning the buckets of first bytes in order, each sorted suffix
placing its predecessor.  Neighbours with a common prefix of ``LENGTH`` bytes are equal strings; all but those in the
first document are removed.  Anchors in more than ``MOST`` places don't go to one task: their strings are grouped by hash
with Spark's own partial aggregates.
"""
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BASE, batch_bytes, mix64, shared_table, slices, table

LENGTH, GRAM, MOST = 50, 16, 32768
BATCH = 1 << 21
CHUNK = 1 << 20  # fragment bytes that are sorted together


def anchors(data, off):
    """(row, first string, last string, hash) of each anchor: strings are named by their starts in ``data``."""
    n = len(data)
    z = np.zeros(0, np.int64)
    if n < LENGTH:
        return z, z, z, np.zeros(0, np.uint64)
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:  # GRAM is a power of two
        h = h[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + h[width:]
        width *= 2
    h = mix64(h)
    v = (h >> np.uint64(32)) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    span, done = LENGTH - GRAM + 1, 1
    while done < span:
        step = min(done, span - done)
        v = np.minimum(v[:-step], v[step:])
        done += step
    at = (v & np.uint64((1 << 32) - 1)).astype(np.int64)  # the anchor of the string that starts here
    start = np.arange(len(at))
    row = np.searchsorted(off, start, "right") - 1
    whole = start + LENGTH <= off[row + 1]  # strings don't cross documents
    start, row, at = start[whole], row[whole], at[whole]
    if not len(at):
        return z, z, z, np.zeros(0, np.uint64)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return row[new], start[new], start[np.append(new[1:], len(start)) - 1], h[at[new]]


def two_stage(text, ends):
    """Suffix array (without end marks) of the strings that fill ``text`` and end at ``ends``; an end is less than any byte.

    Suffixes smaller than their successors are sorted by their first ``LENGTH`` bytes, the others are induced.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    ends = ends[np.append(True, ends[1:] != ends[:-1]) & (ends > 0)]
    stop = np.zeros(n, bool)
    stop[ends - 1] = True
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[stop] = -1
    known = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(known[::-1])[::-1]  # an equal successor has the same type
    smaller = step[following] > 0
    keys = words_at(text)
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(keys[0][direct], kind="stable")]
    tied = np.zeros(len(direct), bool)  # with the one before, as far as it has been compared
    tied[1:] = keys[0][direct[1:]] == keys[0][direct[:-1]]
    for key in keys[1:]:
        again = tied | np.append(tied[1:], False)
        at = np.flatnonzero(again)
        if not len(at):
            break
        some = direct[at]
        order = np.lexsort((key[some], np.cumsum(~tied)[at]))
        direct[at] = some[order]
        own = key[direct[at]]
        tied[at[1:]] &= own[1:] == own[:-1]
    heads = text[direct].astype(np.int64)
    bounds = np.searchsorted(heads, np.arange(257))
    induced = [[] for _ in range(256)]

    def file(p):
        by = np.argsort(text[p], kind="stable")
        p, t = p[by], text[p[by]]
        cut = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.append(cut[1:], len(t))):
            induced[t[a]].append(p[a:b])

    def scan(bucket, c):
        """File the predecessors that are larger than their successors in ``bucket``; those of bucket ``c`` itself are returned."""
        p = bucket[bucket > 0] - 1
        p = p[~stop[p] & ~smaller[p]]
        file(p[text[p] > c])
        return p[text[p] == c]
    file(ends - 1)  # the predecessors of the end marks
    out = []
    for c in range(256):
        current = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(current):
            out.append(current)
            current = scan(current, c)
        own = direct[bounds[c]:bounds[c + 1]]
        if len(own):
            out.append(own)
            scan(own, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def words_at(text):
    """The ``LENGTH`` bytes from each place on as big-endian words; places near the end are padded."""
    padded = np.append(text, np.zeros(LENGTH + 8, np.uint8)).astype(np.uint64)
    word = padded
    for width in (1, 2, 4):
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
    keys = [word[8 * k:8 * k + len(text)] for k in range(-(-LENGTH // 8))]
    if LENGTH % 8:
        keys[-1] = keys[-1] >> np.uint64(64 - 8 * (LENGTH % 8))
    return keys


def repeated(text, ends, docs):
    """Which strings of the fragments also start in a fragment of a smaller document; a mask over ``text``."""
    owner = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    sa = two_stage(text, ends)
    sa = sa[sa + LENGTH <= ends[owner[sa]]]
    mask = np.zeros(len(text), bool)
    if len(sa):
        alike = np.ones(len(sa) - 1, bool)  # adjacent common prefix of LENGTH bytes
        for k in words_at(text):
            own = k[sa]
            alike &= own[1:] == own[:-1]
        groups = np.flatnonzero(np.append(True, ~alike))
        doc = docs[owner[sa]]
        least = np.repeat(np.minimum.reduceat(doc, groups), np.diff(np.append(groups, len(sa))))
        mask[sa[doc > least]] = True
    return mask


def _runs(mask, owner):
    """(first, last) of each run of true places with one owner."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])))
    return at[new], at[np.append(new[1:], len(at)) - 1]


def _record(columns, names):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _all_anchors(it):
    """(h, doc) of the anchors."""
    for b in it:
        data, off = batch_bytes(b.column("text"))
        docs = b.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, hi in slices(np.diff(off), BATCH):
            row, _, _, h = anchors(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            yield _record([h.view(np.int64), docs[lo:hi][row]], ["h", "doc_id"])


def _shared(most):
    """Of rows in the order of ``h``, those whose hash two documents have, with a flag for more than ``most`` rows.

    What is carried over from batch to batch is one group while it is small or has one document.
    """
    def run(it):
        held, state = (np.zeros(0, np.int64),) * 2, None  # state: hash of a group that is being passed on as large
        for b in it:
            h = np.concatenate([held[0], b.column("h").to_numpy()])
            d = np.concatenate([held[1], b.column("doc_id").to_numpy()])
            held, state, out = _groups(h, d, state, most, False)
            yield out
        yield _groups(*held, state, most, True)[2]
    return run


def _groups(h, d, state, most, over):
    names, none = ["h", "doc_id", "large"], np.zeros(0, np.int64)
    if not len(h):
        return (h, d), state, _record([none, none, np.zeros(0, bool)], names)
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(at, len(h)))
    many = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
    large = (size > most) | (h[at] == state) if state is not None else size > most
    go = many | (h[at] == state) if state is not None else many
    keep = len(at) - 1
    if over or large[keep] and go[keep]:  # the last group ends here, or is passed on
        state = h[at[keep]] if not over and large[keep] else None
        take, rest = np.repeat(go, size), len(h)
    else:
        go[keep] = False
        take, rest = np.repeat(go, size), at[keep]
        state = None
    return (h[rest:], d[rest:]), state, _record([h[take], d[take], np.repeat(large, size)[take]], names)


def spans(docs: DataFrame, later: DataFrame | None = None, most=MOST) -> DataFrame:
    """(doc_id, start, end): byte ranges that repeat strings of smaller documents; ``docs``: doc_id, text.

    Documents in ``later`` (doc_id: copies of a smaller one) are left out.
    """
    import zstandard
    rows = docs.select("doc_id", "text")
    found = rows.mapInArrow(_all_anchors, "h long, doc_id long").repartition("h").sortWithinPartitions("h").mapInArrow(_shared(most), "h long, doc_id long, large boolean")
    if later is not None:
        found = found.join(later, "doc_id", "left_anti")
    wanted = found.groupBy("doc_id").agg(F.collect_list(F.struct("h", "large")).alias("shared"))  # a document's own anchors

    def packed(it):
        z = zstandard.ZstdCompressor(level=3)
        for b in it:
            yield _record([b.column("doc_id"), [z.compress(t) if t is not None else None for t in map(lambda x: x.as_buffer(), b.column("text"))]], ["doc_id", "z"])

    def cut(it):
        for b in it:
            z = zstandard.ZstdDecompressor()
            for doc, packed_text, shared in zip(b.column("doc_id"), b.column("z"), b.column("shared")):
                data = np.frombuffer(z.decompress(packed_text.as_py()), np.uint8)
                values = shared.values
                wanted_h = values.field("h").to_numpy()
                order = np.argsort(wanted_h)
                wanted_h, large = wanted_h[order], values.field("large").to_numpy(zero_copy_only=False)[order]
                _, first, last, h = anchors(data, np.array([0, len(data)]))
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(wanted_h, h), len(wanted_h) - 1)
                ok = wanted_h[at] == h
                text = data.tobytes()
                first, last, h, big = first[ok], last[ok], h[ok], large[at[ok]]
                pieces, keys, starts, flags = [], [], [], []
                for f, e, k, g in zip(first.tolist(), last.tolist(), h.tolist(), big.tolist()):
                    # a large group's strings go one by one, as digests
                    for s, t in ([(i, i) for i in range(f, e + 1)] if g else [(f, e)]):
                        piece = text[s:t + LENGTH]
                        pieces.append(hashlib.blake2b(piece, digest_size=16).digest() if g else piece)
                        keys.append(k)
                        starts.append(s)
                        flags.append(g)
                import pyarrow as pa
                for a in range(0, len(keys), 65536):
                    s = slice(a, a + 65536)
                    yield _record([pa.array(keys[s], pa.int64()), pa.array([doc.as_py()] * len(keys[s]), pa.int64()), pa.array(starts[s], pa.int64()), pa.array(pieces[s], pa.binary()), pa.array(flags[s], pa.bool_())],
                                  ["h", "doc_id", "start", "piece", "large"])

    def sort(it):
        def go(parts):
            import pyarrow as pa
            t = pa.Table.from_batches(parts).combine_chunks()
            doc, start = t.column("doc_id").to_numpy(), t.column("start").to_numpy()
            # fragments alike are sorted once, for their first document; later ones go as a whole
            alike = t.column("piece").combine_chunks().dictionary_encode()
            data, ends = batch_bytes(alike.dictionary)
            which = alike.indices.to_numpy()
            least = np.full(len(ends) - 1, np.iinfo(np.int64).max)
            np.minimum.at(least, which, doc)
            owner = np.repeat(np.arange(len(least)), np.diff(ends))
            a, b = _runs(repeated(data, ends[1:], least), owner)
            a, b, owner = a - ends[owner[a]], b - ends[owner[a]] + LENGTH, owner[a]
            later = np.flatnonzero(doc > least[which])
            first = np.flatnonzero(doc == least[which])
            lo, n = np.searchsorted(owner, which[first]), np.bincount(owner, minlength=len(least))[which[first]]
            row = np.repeat(first, n)
            run = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            return _record([np.concatenate([doc[later], doc[row]]), np.concatenate([start[later], start[row] + a[run]]),
                            np.concatenate([start[later] + np.diff(ends)[which[later]], start[row] + b[run]])], ["doc_id", "start", "end"])
        held, size = [], 0
        for b in it:
            held.append(b)
            size += b.column("piece").nbytes
            if size >= CHUNK:
                import pyarrow as pa
                t = pa.Table.from_batches(held).combine_chunks()
                h = t.column("h").to_numpy()
                end = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if end:
                    yield go(t.slice(0, end).to_batches())
                held = t.slice(end).to_batches()
                size = sum(x.column("piece").nbytes for x in held)
        if held:
            yield go(held)
    texts = rows.mapInArrow(packed, "doc_id long, z binary")
    pieces = shared_table(texts.join(wanted, "doc_id").mapInArrow(cut, "h long, doc_id long, start long, piece binary, large boolean"), "fragments")
    small = pieces.filter("NOT large").repartition("h").sortWithinPartitions("h").mapInArrow(sort, "doc_id long, start long, end long")
    large = pieces.filter("large")
    least = large.groupBy("piece").agg(F.min("doc_id").alias("least"))
    return small.unionByName(large.join(least, "piece").filter("doc_id > least").select("doc_id", "start", (F.col("start") + LENGTH).alias("end")))


def keep_first(docs: DataFrame, most=MOST) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per given row.

    Each byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller id is removed.  A null text
    is empty; texts under ``LENGTH`` bytes are kept whole.  A null id is neither smaller nor larger than others: such rows
    are kept and remove nothing.  Rows alike have the same result.
    Of an id with several texts each loses the ranges found in any of them.
    """
    bytes_ = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", bytes_.alias("text"), F.unhex(F.md5(bytes_)).alias("content"))
    firsts = own.filter(f"doc_id IS NOT NULL AND octet_length(text) >= {LENGTH}").groupBy("content").agg(F.min("doc_id").alias("first"))
    facts = shared_table(own.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")).join(firsts, "content", "left").drop("content"), "facts")
    cut = spans(own.filter("doc_id IS NOT NULL"), facts.filter("doc_id > first").select("doc_id").distinct(), most)
    merged = cut.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))  # of one text
    merged = shared_table(merged.select("doc_id", joined(F.col("cuts")).alias("cuts")), "cuts")
    # a later copy goes as a whole; only texts that lose a part are looked at again
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    parts = shared_table(shortened(own.select("doc_id", "text").join(merged, "doc_id")).dropDuplicates(["doc_id", "whole"]), "parts")
    out = facts.join(parts, ["doc_id", "whole"], "left")
    return out.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                      F.when(copy, 1).otherwise(F.coalesce(F.size("cuts"), F.lit(0))).cast("long").alias("n_spans"),
                      F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
                      F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.col("cuts")).alias("spans"))


def joined(cuts):
    """Maximal ranges of ranges in order."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    def add(a, x):
        last = F.element_at(a, -1)
        more = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["start"]), more).otherwise(F.array_append(a, x))
    return F.aggregate(cuts, none, add)


def shortened(rows: DataFrame) -> DataFrame:
    def run(it):
        import pyarrow as pa
        for b in it:
            whole, n, kept = [], [], []
            for text, cuts in zip(b.column("text"), b.column("cuts")):
                data, at, digest, removed = text.as_buffer().to_pybytes(), 0, hashlib.sha256(), 0
                for s, e in zip(cuts.values.field("start").to_pylist(), cuts.values.field("end").to_pylist()):
                    s, e = min(s, len(data)), min(e, len(data))
                    digest.update(data[at:s])
                    removed += e - s
                    at = e
                digest.update(data[at:])
                whole.append(hashlib.sha256(data).hexdigest())
                n.append(removed)
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(whole, pa.string()), b.column("cuts"), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "whole", "cuts", "n_removed", "kept"])
    return rows.mapInArrow(run, "doc_id long, whole string, cuts array<struct<start:bigint,end:bigint>>, n_removed long, kept string")


def op2_suffix_dedup(spark, sf_dir):
    return keep_first(table(spark, sf_dir, "documents")).drop("spans")
