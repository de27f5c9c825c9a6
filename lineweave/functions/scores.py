"""Similarity scores, money rounding and price expressions.

The three text ratios need a longest-common-subsequence length.  It is computed
in Arrow batches: all different pairs of a batch advance together, one machine word
per pair, so the Python side never loops over rows for texts up to 64 characters.
"""
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as t

from . import text as T


def _codes(strings, width):
    out = np.zeros((len(strings), width), dtype=np.uint32)
    n = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    out[np.arange(width) < n[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)
    return out


def _lcs_long(a, b):
    """One pair, any length: the same recurrence on a Python integer."""
    marks = {}
    for i, ch in enumerate(a):
        marks[ch] = marks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & marks.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - bin(row).count("1")


def lcs_lengths(a, b):
    """Common-subsequence length of each pair of two lists of strings."""
    (ia, ta), (ib, tb) = (_distinct(pa.array([v or "" for v in x], pa.string())) for x in (a, b))
    return _lcs_pairs(ia, ta, ib, tb)


def _distinct(column):
    """(place of each row's text, the different texts) of an Arrow string column; a null is an empty text."""
    d = pc.fill_null(column, "").dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _lcs_pairs(ia, ta, ib, tb):
    """Common-subsequence length of the texts ``ta[ia]`` and ``tb[ib]``, computed once per different pair, a few thousand at a time."""
    pairs, back = np.unique(ia * max(1, len(tb)) + ib, return_inverse=True)
    left, right = pairs // max(1, len(tb)), pairs % max(1, len(tb))
    res = np.zeros(len(pairs), dtype=np.int64)
    la = np.fromiter(map(len, ta), dtype=np.int64, count=len(ta))[left]
    lb = np.fromiter(map(len, tb), dtype=np.int64, count=len(tb))[right]
    some = (la > 0) & (lb > 0)
    short = np.flatnonzero(some & (la <= 64) & (lb <= 512))
    for i in np.flatnonzero(some & ((la > 64) | (lb > 512))):
        res[i] = _lcs_long(ta[left[i]], tb[right[i]])
    for start in range(0, len(short), 4096):
        idx = short[start:start + 4096]
        (ua, xa), (ub, xb) = np.unique(left[idx], return_inverse=True), np.unique(right[idx], return_inverse=True)
        wa, n = int(la[idx].max()), la[idx]
        A, B = _codes([ta[i] for i in ua], wa), _codes([tb[i] for i in ub], int(lb[idx].max()))
        # places of each character in each text, as bits; code 0 fills up short texts and never fits
        known = np.zeros(int(max(A.max(), B.max())) + 1, dtype=bool)
        known[0] = True
        known[A] = known[B] = True
        sign = np.cumsum(known) - 1
        A, B, signs = sign[A], sign[B][xb].T.copy(), int(sign[-1]) + 1
        own = np.arange(len(ua)) * signs
        places = np.zeros(len(ua) * signs, dtype=np.uint64)
        for i in range(wa):
            places[own + A[:, i]] |= np.uint64(1) << np.uint64(i)
        places[own] = 0
        mine = own[xa]
        full = np.uint64(2 ** 64 - 1) >> (64 - n).astype(np.uint64)
        row = full.copy()
        for j in range(B.shape[0]):
            u = row & places[mine + B[j]]
            row = ((row + u) | (row - u)) & full
        res[idx] = n - np.bitwise_count(row)
    return res[back]


def _ratio(a, b):
    """Insert/delete ratio of two Arrow string columns."""
    (ia, ta), (ib, tb) = _distinct(a), _distinct(b)
    total = np.fromiter(map(len, ta), dtype=np.float64, count=len(ta))[ia] + np.fromiter(map(len, tb), dtype=np.float64, count=len(tb))[ib]
    return np.where(total == 0, 1.0, 2.0 * _lcs_pairs(ia, ta, ib, tb) / np.where(total == 0, 1, total))


@F.arrow_udf(t.DoubleType())
def _indel(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_ratio(a, b))


@F.pandas_udf(t.DoubleType())
def _difflib(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def indel_ratio(a, b):
    """2 * LCS / (|a| + |b|)."""
    return _indel(T.text(a), T.text(b))


def sort_words(c):
    return F.array_join(F.array_sort(F.filter(F.split(T.text(c), r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a, b):
    """D2."""
    return _indel(sort_words(a), sort_words(b))


def token_set_ratio(a, b):
    """D3: best of common, common + rest a, common + rest b; 1 when one side is contained."""
    def toks(c):
        return F.array_sort(F.array_distinct(F.filter(F.split(T.text(c), r"\s+"), lambda w: w != "")))
    ta, tb = toks(a), toks(b)
    common = F.array_intersect(ta, tb)
    ra, rb = F.array_except(ta, tb), F.array_except(tb, ta)
    sect = F.array_join(common, " ")
    with_a = F.array_join(F.concat(common, ra), " ")
    with_b = F.array_join(F.concat(common, rb), " ")
    ls, l_a, l_b = F.length(sect), F.length(with_a), F.length(with_b)
    # the common part is a prefix of both others, so those two ratios need no LCS
    pre_a = F.when(ls > 0, 2.0 * ls / (ls + l_a)).otherwise(0.0)
    pre_b = F.when(ls > 0, 2.0 * ls / (ls + l_b)).otherwise(0.0)
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0) \
        .when((F.size(common) > 0) & ((F.size(ra) == 0) | (F.size(rb) == 0)), 1.0) \
        .otherwise(F.greatest(_indel(with_a, with_b), pre_a, pre_b))


def sequence_ratio(a, b):
    """Matching-blocks ratio; 0 when either side is blank."""
    a, b = F.upper(F.trim(T.text(a))), F.upper(F.trim(T.text(b)))
    return F.when((a == "") | (b == ""), 0.0).otherwise(_difflib(a, b))


def blended_ratio(a, b, sort_weight=0.70, plain_weight=0.30, words=None):
    """``words``: both texts by ``sort_words``, where pairs share texts whose words were sorted before they met."""
    return sort_weight * (_indel(*words) if words else token_sort_ratio(a, b)) + plain_weight * indel_ratio(a, b)


@F.arrow_udf(t.DoubleType())
def _best_blend(a: pa.Array, wa: pa.Array, b1: pa.Array, w1: pa.Array, b2: pa.Array, w2: pa.Array, b3: pa.Array, w3: pa.Array) -> pa.Array:
    out = np.zeros(len(a))
    for b, w in ((b1, w1), (b2, w2), (b3, w3)):
        at = np.flatnonzero(b.is_valid().to_numpy(zero_copy_only=False))
        if len(at):
            rows = pa.array(at)
            out[at] = np.maximum(out[at], 0.70 * _ratio(wa.take(rows), w.take(rows)) + 0.30 * _ratio(a.take(rows), b.take(rows)))
    return pa.array(out)


def best_blended_ratio(a, words, texts):
    """Best ``blended_ratio`` of a text (and its ``sort_words``) with three others, as (text, its words, whether to leave it out); 0 without any."""
    args = [T.text(a), T.text(words)]
    for b, w, skip in texts:
        args += [F.when(F.coalesce(skip, F.lit(False)), F.lit(None)).otherwise(T.text(b)), T.text(w)]
    return _best_blend(*args)


def text_score(query, *texts):
    """Best of several catalogue texts, 4 decimals; blank texts score 0."""
    parts = []
    for c in texts:
        n = T.norm_text(c)
        parts.append(F.when(n == "", 0.0).otherwise(blended_ratio(query, n)))
    return F.round(F.greatest(F.lit(0.0), *parts), 4)


def attribute_bonus(p):
    """Attribute agreement; ``p`` maps names to item/candidate columns."""
    diam = p["diameters"]
    cand = p["c_diameters"]
    inside = F.size(F.array_except(diam, cand)) == 0
    bonus = F.when(p["category"] == p["c_category"], 0.08).when(
        p["category"].isNotNull() & p["family_ok"], 0.04).otherwise(0.0)
    bonus += F.when(F.size(diam) == 0, 0.0).when(inside & (F.size(diam) >= 2), 0.10).when(inside, 0.08) \
        .when(F.arrays_overlap(diam, cand), 0.04).otherwise(0.0)
    bonus += F.when(p["angle"] == p["c_angle"], 0.06).otherwise(0.0)
    bonus += F.when((p["subcategory"] == "ESGOTO") & (p["c_series"] == "NORMAL"), 0.04).when(
        (p["subcategory"] == "REFORCADA") & (p["c_series"] == "REFORCADA"), 0.04).otherwise(0.0)
    bonus += F.when(p["line"] == p["c_line"], 0.04).otherwise(0.0)
    bonus += F.when(p["board"] == p["c_board"], 0.08).otherwise(0.0)
    return bonus


def min_score(sole, anchors, n_tokens, category, diameters):
    """D7."""
    return F.when(sole & (anchors >= 2), 0.35).when(n_tokens < 4, 0.32) \
        .when(category.isNotNull() & (F.size(diameters) > 0), 0.40).otherwise(0.45)


def structure_score(cat, c_cat, tube, c_tube, diam, c_diam, length, c_length):
    """D8, structural half."""
    def near(a, b):
        return F.coalesce(F.abs(a - b) <= 0.0001, F.lit(False))
    return F.round(F.when(cat.eqNullSafe(c_cat), 0.20).otherwise(0.0)
                   + F.when(tube.eqNullSafe(c_tube), 0.20).otherwise(0.0)
                   + F.when(near(diam, c_diam), 0.30).otherwise(0.0)
                   + F.when(near(length, c_length), 0.20).otherwise(0.0), 4)


def fallback_text(a, b):
    a, b = F.upper(T.text(a)), F.upper(T.text(b))
    return F.round(0.65 * indel_ratio(a, b) + 0.35 * token_sort_ratio(a, b), 4)


def fallback_score(structure, textual):
    return F.round(0.6 * structure + 0.4 * textual, 4)


def vector_bonus(cat, c_cat, diam, c_diam, length, c_length):
    """Capped at 0.30."""
    b = F.when(cat == F.upper(c_cat), 0.10).otherwise(0.0) \
        + F.when(F.abs(diam - c_diam) < 0.01, 0.12).otherwise(0.0) \
        + F.when(F.abs(length - c_length) < 0.01, 0.08).otherwise(0.0)
    return F.round(F.least(b, F.lit(0.30)), 4)


def dot(a, b):
    """Inner product of two float arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def token_overlap(a, b):
    """D10."""
    def toks(c):
        return F.array_distinct(F.regexp_extract_all(F.upper(T.text(c)), F.lit("[A-Z0-9]+"), F.lit(0)))
    ta, tb = toks(a), toks(b)
    size = F.greatest(F.size(ta), F.size(tb))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0) \
        .otherwise(100.0 * F.size(F.array_intersect(ta, tb)) / size)


MONEY = "decimal(18,6)"


def discount(quote, order):
    """Per cent, rounded up at five decimals; 0 when the quote is not above."""
    q, o = quote.cast(MONEY), order.cast(MONEY)
    ratio = ((q - o) * F.lit(100).cast("decimal(3,0)")).cast("decimal(28,6)") / q
    return F.when(q.isNull() | o.isNull() | (q <= 0), F.lit(None)) \
        .when(q <= o, F.lit(0)).otherwise(F.ceil(ratio.cast("decimal(38,12)"), F.lit(5))).cast("decimal(18,5)")


def safe_price(calc, order):
    """Never above the order price in whole cents."""
    cents = F.floor(order.cast(MONEY), F.lit(2)).cast("decimal(18,2)")
    rounded = F.round(calc, 2).cast("decimal(18,2)")
    return F.when(calc.isNull() | order.isNull(), F.lit(None).cast("decimal(18,2)")) \
        .when(calc >= order, cents).otherwise(F.least(rounded, cents))


def return_discount(table_price, given):
    """Two decimals, may be negative."""
    return F.when((table_price != 0) & given.isNotNull(),
                  F.round((table_price - given) / table_price * 100, 2))


def to_multiple(qty, lot):
    """D14."""
    return F.when(lot.isNull() | (lot <= 0), qty).otherwise(F.ceil(qty / lot) * lot)


def almost_equal(a, b, tol=0.02):
    """D15."""
    return F.when(a.isNull() | b.isNull(), F.lit(False)).when(b == 0, F.abs(a - b) <= tol) \
        .otherwise(F.abs(a - b) / F.abs(b) <= tol)


def price_verdict(ratio, factor):
    """True within 5 %, false outside 0.5..2, otherwise null."""
    rel = ratio / F.coalesce(factor, F.lit(1.0))
    return F.when(F.abs(rel - 1) <= 0.05, F.lit(True)).when((rel < 0.5) | (rel > 2.0), F.lit(False))


def total_check(qty, price, stated):
    """Computed total in half-up cents, and stated minus computed."""
    calc = F.round((qty.cast(MONEY) * price.cast(MONEY)).cast("decimal(38,12)"), 2).cast("decimal(18,2)")
    return F.struct(calc.alias("computed"), (stated.cast("decimal(18,2)") - calc).cast("decimal(19,2)").alias("difference"))
