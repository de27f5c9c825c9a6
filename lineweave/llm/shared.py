"""Helpers of the corpus operators: reading, shared tables, and whole-batch text arithmetic in numpy."""
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WORD_CHARS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: lineage ends, columns stay prunable."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text) -> F.Column:
    """Words of a text, null: 0.  Each becomes one letter; counting matches would hold a string for each of them."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD_CHARS, "w"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


# ---- text of one Arrow batch as one byte array -------------------------------------------------------------------

MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def mix64(x):
    """Finaliser of splitmix64 over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def batch_bytes(column):
    """Bytes and row offsets of an Arrow string column; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cased letters and digits keep a value, all other ASCII separates words.  Bytes over 127 are letters.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD_SEP = np.ones(256, bool)
FOLD_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def slices(lengths, most):
    """Index ranges of consecutive rows whose lengths sum to ``most`` at most, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


_POWERS = {}


def _powers(n, base):
    """The first ``n`` powers, kept for the next batch: batches are of bounded size, longer ones aren't kept."""
    p = _POWERS.get(base)
    if p is None or len(p) < n:
        p = np.full(n, np.uint64(base), np.uint64)
        if n:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        if n <= 1 << 22:
            _POWERS[base] = p
    return p[:n]


def words_of(data, offsets, folded=False):
    """(row, start, end, hash) of every word of the rows, in order; row ends separate words.

    Hash: polynomial in the word's bytes modulo 2**64, mixed; ``folded`` lower-cases ASCII and drops punctuation.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    sep = (FOLD_SEP if folded else SPACE)[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = sep[:-1]
    row_starts = offsets[:-1][offsets[:-1] < n]
    first[row_starts] = True
    starts = np.flatnonzero(first & ~sep)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = sep[1:] | first[1:]
    ends = np.flatnonzero(last & ~sep) + 1
    values = (FOLD[data] if folded else data).astype(np.uint64) + np.uint64(1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(n, BASE), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _powers(n + 1, BASE_INV)[starts]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return rows, starts, ends, mix64(h)


def grams(h, rows, k):
    """(index, hash) of every run of ``k`` words within a row."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(m, np.uint64)
    for i in range(k):
        g = g * np.uint64(BASE) + h[i:i + m]
    at = np.flatnonzero(rows[:m] == rows[k - 1:k - 1 + m])
    return at, mix64(g[at])
