"""Shared helpers of the operators."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df, keys, order):
    """First row of each key: an aggregate with a map-side step and no window (rows with texts are aggregated in sorted order).

    ``order`` is a tuple of columns that is unique within the key; the smallest wins.
    """
    return _pick(df, keys, order, F.min_by)


def last_per_key(df, keys, order):
    return _pick(df, keys, order, F.max_by)


def _pick(df, keys, order, agg):
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(o) for o in order]) if len(order) > 1 else F.col(order[0])
    picked = df.groupBy(*keys).agg(agg(F.struct(*rest), by).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def ranked(df, keys, order, name="rank"):
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def soft_filter(pairs, item, predicate):
    """Keep rows that satisfy the test; an item none of whose rows do keeps them all."""
    q = F.coalesce(predicate, F.lit(False))
    return (pairs.withColumn("_q", q)
            .withColumn("_any", F.max("_q").over(W.partitionBy(item)))
            .filter(F.col("_q") | ~F.col("_any")).drop("_q", "_any"))


def soft_rank(tests):
    """One number that replaces a chain of soft filters.

    Each soft filter keeps the rows that pass it unless none of the item's rows
    do, so the survivors of the whole chain are exactly the rows whose pass/fail
    vector is the lexicographic maximum of the item.
    """
    n = len(tests)
    total = F.lit(0)
    for i, t in enumerate(tests):
        total = total + F.when(F.coalesce(t, F.lit(False)), F.lit(1 << (n - 1 - i))).otherwise(0)
    return total


def contained(texts, key, text, needles, value, block=100_000):
    """(``key``, needle): every needle that a text contains, once per row of ``texts``.

    A block of needles becomes one automaton that runs over each text once, so only hits leave a task, whatever the texts
    hold.  Blocks are bounded by ``block``; more needles are more passes over the texts.  Empty and null ones match nothing.
    """
    t = texts.select(F.col(key).alias("k"), text.alias("t")).filter("length(t) > 0")
    n = needles.select(value.alias("v")).filter("length(v) > 0").distinct()
    parts = max(1, -(-n.count() // block))
    out = None
    for part in range(parts):
        mine = n if parts == 1 else n.filter(F.pmod(F.xxhash64("v"), F.lit(parts)) == part)
        words = t.sparkSession.sparkContext.broadcast([r.v for r in mine.collect()])  # about ``block`` needles
        found = t.mapInArrow(_scan(words), f"{key} {t.schema['k'].dataType.simpleString()}, needle string")
        out = found if out is None else out.unionByName(found)
    return out


def _scan(words):
    def run(batches):
        import ahocorasick
        import pyarrow as pa
        automaton = ahocorasick.Automaton()
        for w in words.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            at, hits = [], []
            if len(words.value):
                for i, t in enumerate(batch.column(1)):
                    mine = {w for _, w in automaton.iter(t.as_py())}
                    at += [i] * len(mine)
                    hits += mine
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], [batch.schema.names[0], "needle"])
    return run


def exact_quantile(df, column, q=0.5, bits=16):
    """Interpolated quantile of a long column by radix selection; None without values.

    Each pass counts one digit of the values that share the digits found so far, so no task or driver ever holds more than
    ``2 ** bits`` counts, however many different values there are.
    """
    v = df.select(F.col(column).cast("long").alias("v")).filter("v IS NOT NULL").withColumn("v", F.col("v").bitwiseXOR(F.lit(-1 << 63)))  # unsigned order
    n = v.count()
    if not n:
        return None

    def kth(k):
        found = 0
        for shift in range(64 - bits, -1, -bits):
            rest = v if shift == 64 - bits else v.filter(F.shiftrightunsigned("v", shift + bits) == found)
            digit = F.shiftrightunsigned("v", shift).bitwiseAND((1 << bits) - 1)
            for r in sorted(rest.groupBy(digit.alias("d")).count().collect()):
                if k < r["count"]:
                    found = found << bits | r["d"]
                    break
                k -= r["count"]
        return found - (1 << 63)
    at = (n - 1) * q
    low = kth(int(at))
    high = low if at == int(at) else kth(int(at) + 1)
    return low + (high - low) * (at - int(at))
