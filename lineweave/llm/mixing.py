"""Mixing sources to target weights by pivotal dependent rounding.

A document's copies are ``target / source_size``: a whole part and a fractional probability.  Items of one leaf of a
source meet from the longest to the shortest; each meeting moves word mass from one probability to the other, in a direction drawn
so that expectations stay, until one of the two is 0 or 1.  The item left over at a leaf goes to the next level of the
tree, where the leftovers of ``FAN`` leaves meet, until one item of a source is left, which is drawn.  Words are
conserved by every meeting, so a source ends within one document of its target.
"""
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import n_words, shared_table, table

LEAF, FAN, CAP = 4096, 64, 3
ITEM = "doc_id long, source string, leaf long, size long, source_size long, target double, base long, p double, done boolean"


def source_targets(sized: DataFrame, weights=(1, 2, 3), cap=CAP) -> DataFrame:
    """(source, source_size, n, target): ``weights`` repeat over the sources by code point, null last; shares of all words.

    A target ends at ``cap`` times its source; what is over goes to the others by weight, until none is above.  The
    level ``words / weight`` that all uncapped sources share follows from the sources in the order of ``cap*size/weight``.
    Its windows run over one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("w", F.element_at(F.lit(list(weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    rank = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = rank.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({"total": F.sum("source_size").over(every), "wsum": F.sum("w").over(every),
                       "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap, "wcapped": F.coalesce(F.sum("w").over(before), F.lit(0))})
    level = (F.col("total") - F.col("capped")) / (F.col("wsum") - F.col("wcapped"))
    s = s.withColumn("level", F.when(level * F.col("w") <= cap * F.col("source_size"), level))
    # the first source whose share of the level stays under its cap sets the level of all after it
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(rank.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.least(F.col("level") * F.col("w"), (F.col("source_size") * cap).cast("double")), (F.col("source_size") * cap).cast("double"))
    return s.select("source", "source_size", "n", target.alias("target"))


def meet(items):
    """Meetings in the given order: yields (item index, chance left or drawn, done).  ``items``: (key, size, p, uniform)."""
    held = None
    for i, (key, size, p, u) in enumerate(items):
        if held is not None and held[0] != key:
            yield held[1], held[3], False
            held = None
        if not 0.0 < p < 1.0 or not size:
            yield i, p if size else 0.0, True
            continue
        if held is None:
            held = (key, i, size, p)
            continue
        _, j, size_j, q = held
        up = min((1.0 - p) * size, q * size_j)      # words that can go from the held item to this one
        down = min((1.0 - q) * size_j, p * size)    # and the other way
        if u * (up + down) < down:
            p, q = (1.0 if up == (1.0 - p) * size else p + up / size), (0.0 if up == q * size_j else q - up / size_j)
        else:
            p, q = (0.0 if down == p * size else p - down / size), (1.0 if down == (1.0 - q) * size_j else q + down / size_j)
        held = None
        for k, s, x in ((i, size, p), (j, size_j, q)):
            x = 0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x
            if 0.0 < x < 1.0 and held is None:
                held = (key, k, s, x)
            else:
                yield k, x, True
    if held is not None:
        yield held[1], held[3], False


def _rounds(last):
    def run(batches):
        import pandas as pd
        kept = None  # the items of a leaf come in order; one item at most is carried over a batch's end
        for b in batches:
            b = b if kept is None else pd.concat([kept, b], ignore_index=True)
            keys = list(zip(b.source, b.leaf))
            got = list(meet(zip(keys, b["size"].tolist(), b.p.tolist(), b.u.tolist())))
            at = np.array([g[0] for g in got], np.int64)
            b.loc[b.index[at], "p"] = [g[1] for g in got]
            b.loc[b.index[at], "done"] = [g[2] for g in got]
            end = ~b.done & (np.arange(len(b)) >= (at[-1] if len(at) else 0)) if len(b) else b.done
            kept = b[end] if len(b) and bool(end.any()) and keys[int(np.flatnonzero(end)[0])] == keys[-1] else None
            out = b if kept is None else b[~end]
            yield _drawn(out, last)
        if kept is not None:
            yield _drawn(kept, last)
    return run


def _drawn(b, last):
    """On the last level an item left over is drawn by its own number."""
    if last:
        left = ~b.done.astype(bool)
        b.loc[left, "p"] = (b.u[left] < b.p[left]).astype(float)
        b.loc[left, "done"] = True
    return b[["doc_id", "source", "leaf", "size", "source_size", "target", "base", "p", "done"]]


def mix(docs: DataFrame, weights=(1, 2, 3), cap=CAP, seed=20) -> DataFrame:
    """``docs`` (doc_id, text, source) as (doc_id, source, size, source_size, target, copies, taken).

    One row per given row.  Null texts and texts without words have size 0 and are not taken; a null source is a source;
    rows alike are items of their own, in any order.  Draws depend on doc_id, text size and ``seed`` only.
    """
    sized = shared_table(docs.select("doc_id", "source", n_words("text").alias("size")), "sizes")
    targets = shared_table(source_targets(sized, weights, cap), "targets")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = sized["source"].eqNullSafe(targets["source"])
    items = (sized.join(targets, same, "left").select("doc_id", sized["source"], "size", "source_size", "target",
             F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.ceil(F.col("n") / LEAF)).alias("leaf"), F.floor(x).alias("base"), (x - F.floor(x)).alias("p"))
             .withColumn("done", F.lit(False)))
    most = targets.agg(F.max("n")).first()[0] or 0
    levels = 1
    while math.ceil(most / LEAF) > FAN ** (levels - 1):
        levels += 1
    out, columns = None, [c.split()[0] for c in ITEM.split(", ")]
    for level in range(levels):
        u = (F.shiftrightunsigned(F.xxhash64("doc_id", "size", F.lit(seed + 1 + level)), 11) / float(1 << 53)).alias("u")
        dealt = items.select(*columns, u).repartition("source", "leaf").sortWithinPartitions("source", "leaf", F.desc("size"), "u", "doc_id")
        met = shared_table(dealt.mapInPandas(_rounds(level == levels - 1), ITEM), "mixed")
        out = met.filter("done") if out is None else out.unionByName(met.filter("done"))
        items = met.filter("NOT done").withColumn("leaf", F.floor(F.col("leaf") / FAN))
    copies = F.col("base") + F.col("p").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op3_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
