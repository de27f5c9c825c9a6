"""Exact thresholded text similarity without forming all pairs."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.scores import lcs_lengths

SLICE = 20_000  # distinct texts of one side that meet in one task


def _histogram(texts):
    out = np.zeros((len(texts), 64), dtype=np.int16)
    for i, t in enumerate(texts):
        cp = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) % 64
        out[i] = np.bincount(cp, minlength=64)
    return out


def _meet(a, b, floor):
    """Pairs of one block whose insert/delete ratio reaches ``floor``.

    Shared characters bound the common subsequence from above, so the sequence
    itself is computed only for pairs that survive that bound.
    """
    empty = pd.DataFrame({"a": pd.Series(dtype=str), "b": pd.Series(dtype=str), "ratio": pd.Series(dtype=float)})
    if not len(a) or not len(b):
        return empty
    ta, tb = a["a"].tolist(), b["b"].tolist()
    ha, hb = _histogram(ta), _histogram(tb)
    la, lb = ha.sum(axis=1), hb.sum(axis=1)
    left, right = [], []
    for j in range(len(tb)):
        total = la + lb[j]
        close = np.flatnonzero(2 * np.minimum(la, lb[j]) >= floor * total - 1e-9)
        if len(close):
            shared = np.minimum(ha[close], hb[j]).sum(axis=1)
            hit = close[2 * shared >= floor * total[close] - 1e-9]
            left.extend(ta[i] for i in hit)
            right.extend([tb[j]] * len(hit))
    if not left:
        return empty
    lcs = lcs_lengths(left, right)
    n = np.fromiter((len(x) + len(y) for x, y in zip(left, right)), dtype=np.float64, count=len(left))
    ratio = 2.0 * lcs / n
    keep = ratio >= floor - 1e-9
    return pd.DataFrame({"a": np.array(left, dtype=object)[keep], "b": np.array(right, dtype=object)[keep], "ratio": ratio[keep]})


def _closest(a, b, floor):
    """Best text of ``b`` for each text of ``a`` in one block, first by place on equal ratios.

    Candidates come by falling bound of shared characters and end below the best ratio found, so few sequences are computed.
    """
    empty = pd.DataFrame({"a": pd.Series(dtype=str), "b": pd.Series(dtype=str), "place": pd.Series(dtype="int64"), "ratio": pd.Series(dtype=float)})
    if not len(a) or not len(b):
        return empty
    b = b.sort_values("place", kind="stable")
    ta, tb, place = a["a"].tolist(), b["b"].tolist(), b["place"].to_numpy()
    ha, hb = _histogram(ta), _histogram(tb)
    la, lb = ha.sum(axis=1, dtype=np.int64), hb.sum(axis=1, dtype=np.int64)
    best, at = np.full(len(ta), -1.0), np.full(len(ta), -1)
    for start in range(0, len(ta), 512):  # bounds of a few hundred texts are held at a time
        queue = {}
        for i in range(start, min(start + 512, len(ta))):
            bound = 2.0 * np.minimum(la[i], lb) / (la[i] + lb)
            close = np.flatnonzero(bound >= floor - 1e-9)
            bound = 2.0 * np.minimum(hb[close], ha[i]).sum(axis=1, dtype=np.int64) / (la[i] + lb[close])
            hit = bound >= floor - 1e-9
            order = np.argsort(-bound[hit], kind="stable")
            if len(order):
                queue[i] = close[hit][order], bound[hit][order]
        done, step = 0, 4
        while queue:
            part = {i: j[done:done + step] for i, (j, _) in queue.items()}
            left, right = np.repeat(list(part), [len(j) for j in part.values()]), np.concatenate(list(part.values()))
            ratio = 2.0 * lcs_lengths([ta[i] for i in left], [tb[j] for j in right]) / (la[left] + lb[right])
            for i, j, r in zip(left, right, ratio):
                if r >= floor - 1e-9 and (r > best[i] or (r == best[i] and j < at[i])):
                    best[i], at[i] = r, j
            done, step = done + step, step * 2
            queue = {i: (j, u) for i, (j, u) in queue.items() if done < len(j) and u[done] >= best[i] - 1e-9}
    hit = np.flatnonzero(at >= 0)
    return pd.DataFrame({"a": [ta[i] for i in hit], "b": [tb[j] for j in at[hit]], "place": place[at[hit]], "ratio": best[hit]})


def closest(left, right, floor):
    """For each text of ``left`` (a) the best of ``right`` (b, place, one row each) by insert/delete ratio, at ``floor`` or above.

    Equal ratios go by place.  Blocks are those of ``near_pairs``; one row per text and block leaves a task.
    """
    kind = "a string, b string, place bigint, ratio double"
    return _blocks(left, right, floor, lambda x, y: _closest(x, y, floor), kind).groupBy("a").agg(F.min_by(F.struct("b", "place", "ratio"), F.struct(-F.col("ratio"), "place")).alias("_b")).select("a", "_b.*")


def near_pairs(left, right, floor):
    """Distinct pairs (a, b) with an insert/delete ratio of at least ``floor``.

    Texts meet only texts of a length that can reach the floor: the length class
    is the join key, and each class is cut into slices of bounded size on both
    sides.  Only pairs at or above the floor leave a task.  A matching-blocks
    ratio never exceeds the insert/delete ratio, so the result also holds every
    pair that reaches the floor by that measure.
    """
    return _blocks(left, right.select("b").distinct(), floor, lambda x, y: _meet(x, y, floor), "a string, b string, ratio double")


def _blocks(left, right, floor, meet, kind):
    step = float(np.log((2.0 - floor) / floor))
    a = left.select("a").filter("length(a) > 0").distinct().withColumn("c", F.floor(F.log(F.length("a").cast("double")) / step).cast("int"))
    b = right.filter("length(b) > 0").withColumn("c", F.floor(F.log(F.length("b").cast("double")) / step).cast("int"))
    n = b.agg(F.count("*").alias("n")).first()["n"] // SLICE + 1
    m = a.agg(F.count("*").alias("n")).first()["n"] // SLICE + 1
    m = max(m, 8)
    a = a.withColumn("s", F.pmod(F.xxhash64("a"), F.lit(m))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    b = b.withColumn("t", F.pmod(F.xxhash64("b"), F.lit(n))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))) \
        .withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    return a.groupBy("c", "s", "t").cogroup(b.groupBy("c", "s", "t")).applyInPandas(meet, kind)
