"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a share between 0 and 1 and rejects above a cutoff.  Labelled good documents of a stratum (language) are its
holdout: a cutoff that rejects ``k`` of ``n`` is safe if the exact binomial upper bound of its false-rejection rate is at
most ``alpha``, that is if P(Bin(n, alpha) <= k) <= ``delta``.  A rule's cutoffs are nested, so testing from the most
lenient one needs no correction among them (fixed sequence); over rules and strata ``delta`` is divided (Bonferroni), and
``alpha`` over the rules, so a stratum's rules together keep it.  Among the safe cutoffs the one with the largest gap
between rejected bad and rejected good shares is taken; a stratum with too few labels rejects nothing beyond the base.
"""
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .shared import shared_table, table

SPACES = r"[\x20\x09-\x0D]+"
GRID = 64
ALPHA, DELTA = 0.04, 0.05
RULES = ("symbols", "capitals", "dup_lines", "repeats")


def _covered(h, width):
    """Positions within ``width`` of a window whose hash occurs twice or more in ``h``."""
    def repeated(s):
        def alike(x, i):
            return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, alike), lambda x: x["i"]))

    def reach(at):
        return F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x)
    s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(let(s, repeated), reach)


def signals(docs: DataFrame, whole=False) -> DataFrame:
    """Counts and rule shares of each whole text, one row per given row; a null text has no words.

    Windows of five words are compared by 64-bit hashes within one text.  ``whole`` keeps the given row in ``given``.
    """
    text = F.coalesce("text", F.lit(""))
    also = ["given"] if whole else []
    d = docs.select("doc_id", "lang", text.alias("t"), *([F.struct(*docs.columns).alias("given")] if whole else []))
    d = d.select(*also, "doc_id", "lang", "t", F.array_remove(F.split("t", SPACES), "").alias("w"),
                 F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    h = F.when(F.size("w") >= 5, F.transform(F.slice("w", F.lit(1), F.size("w") - 4), lambda x, i: F.xxhash64(x, *[F.get("w", i + j) for j in range(1, 5)])))
    d = d.select(*also, "doc_id", "lang", F.size("w").cast("long").alias("n_words"), F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
                 F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("l").alias("n_lines"),
                 (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), h.alias("h"),
                 F.regexp_count("t", F.lit("[A-Z]")).alias("n_capitals"))
    repeated = F.when(F.col("h").isNotNull() & (F.size(F.array_distinct("h")) < F.size("h")), _covered(F.col("h"), 5)).otherwise(0)
    d = d.withColumn("n_repeat_words", repeated.cast("long")).drop("h")

    def level(a, b):  # the least cutoff on the grid that doesn't reject
        return F.coalesce(F.ceil(GRID * F.try_divide(F.col(a), F.col(b))), F.lit(0)).cast("int")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return d.select(*also, "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                    F.array(level("n_symbols", "word_chars"), level("n_capitals", "word_chars"), level("n_dup_lines", "n_lines"), level("n_repeat_words", "n_words")).alias("levels"))


def _log_gamma(x):
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    for i in range(8):
        series = series - F.log(x + i)
    return series


def binomial_cdf(k, n, p):
    """P(Bin(n, p) <= k) for k below the mean, else 1: the largest term times the falling ratios below it."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    terms = F.least(k, F.ceil(60 + 12 * F.sqrt(n * (p * (1 - p)))).cast("double")).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), terms), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
                       lambda a, t: F.struct((a["term"] * (k - t) * (1 - p) / ((n - k + t + 1) * p)).alias("term"), (a["sum"] + a["term"]).alias("sum")), lambda a: a["sum"])
    return F.when(k < n * p, top * tail).otherwise(1.0)


def cutoffs(scored: DataFrame, labels: DataFrame, alpha=ALPHA, delta=DELTA) -> DataFrame:
    """(lang, cutoffs): per stratum the chosen level of each rule, null where none is safe and useful.

    ``labels`` (doc_id, quality): null qualities don't count; of several labels of a document the best holds.
    """
    truth = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = scored.filter("NOT base_failed").join(truth, "doc_id").select("lang", "quality", F.posexplode("levels").alias("rule", "level"))
    counts = shared_table(held.groupBy("lang", "rule", "level").agg(F.count_if(F.col("quality") >= 1).alias("good"), F.count_if(F.col("quality") < 1).alias("bad")), "holdout")
    tests = max(1, counts.select("lang", "rule").distinct().count())
    every = Window.partitionBy("lang", "rule")
    above = every.orderBy(F.desc("level"))
    c = counts.select("lang", "rule", (F.col("level") - 1).alias("cut"), F.sum("good").over(above).alias("k"), F.sum("good").over(every).alias("n"),
                      F.sum("bad").over(above).alias("b"), F.sum("bad").over(every).alias("m"))
    c = c.filter("cut >= 0 AND n > 0 AND m > 0").withColumn("gap", F.col("b") / F.col("m") - F.col("k") / F.col("n"))
    safe = c.filter((F.col("gap") > 0) & (binomial_cdf(F.col("k"), F.col("n"), alpha / len(RULES)) <= delta / tests))
    best = safe.groupBy("lang", "rule").agg(F.max_by("cut", F.struct("gap", "cut")).alias("cut"))
    return best.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, alpha=ALPHA, delta=DELTA) -> DataFrame:
    """``docs`` (doc_id, text, lang) with counts, ``base_failed`` and ``kept``; one row per given row.

    A null language is a stratum.  Empty tables and empty texts are fine: a text without ten words fails the base.
    """
    scored = shared_table(signals(docs), "signals")
    return (_against(scored, cutoffs(scored, labels, alpha, delta))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def _against(scored, chosen):
    """``kept``: by the base and the stratum's cutoffs.  As a written table the cutoffs have a known size, by which Spark may broadcast them."""
    chosen = shared_table(chosen.withColumnRenamed("lang", "stratum"), "cutoffs")
    over = F.exists(F.transform(F.col("levels"), lambda x, i: F.coalesce(x > F.try_element_at("cutoffs", i), F.lit(False))), lambda x: x)
    return (scored.join(chosen, F.col("lang").eqNullSafe(F.col("stratum")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False))))


def good_documents(docs: DataFrame, labels: DataFrame, alpha=ALPHA, delta=DELTA) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, as they are."""
    scored = shared_table(signals(docs, whole=True), "signals")
    return _against(scored, cutoffs(scored, labels, alpha, delta)).filter("kept").select("given.*")


def op1_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, lang, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
v AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest(range(0, 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
s AS (SELECT d.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals FROM d LEFT JOIN v USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      [ceil(64 * n_symbols / word_chars), ceil(64 * n_capitals / word_chars), ceil(64 * n_dup_lines / nullif(len(l), 0)), ceil(64 * n_repeat_words / nullif(n_words, 0))] AS levels FROM s),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY ALL),
e AS (SELECT lang, unnest([0, 1, 2, 3]) AS rule, unnest(levels) AS level, quality FROM f JOIN q USING (doc_id) WHERE NOT base_failed),
c AS (SELECT lang, rule, coalesce(level, 0) AS level, count(*) FILTER (quality >= 1) AS good, count(*) FILTER (quality < 1) AS bad FROM e GROUP BY ALL),
k AS (SELECT lang, rule, level - 1 AS cut, sum(good) OVER (PARTITION BY lang, rule ORDER BY level DESC) AS k, sum(good) OVER (PARTITION BY lang, rule) AS n,
      sum(bad) OVER (PARTITION BY lang, rule ORDER BY level DESC) AS b, sum(bad) OVER (PARTITION BY lang, rule) AS m, (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM c)) AS tests FROM c),
a AS (SELECT *, b / m - k / n AS gap FROM k WHERE cut >= 0 AND n > 0 AND m > 0),
z AS (SELECT lang, rule, max_by(cut, gap * 1000 + cut * 1e-9) AS cut FROM a WHERE gap > 0 AND k < n * {ALPHA / 4}
      AND list_sum(list_transform(range(0, k::BIGINT + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA / 4}) + (n - i) * ln(1 - {ALPHA / 4})))) <= {DELTA} / tests GROUP BY ALL),
o AS (SELECT r FROM (SELECT r, lang, unnest([0, 1, 2, 3]) AS rule, unnest(levels) AS level FROM f) x JOIN z ON x.lang IS NOT DISTINCT FROM z.lang AND x.rule = z.rule WHERE level > cut GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND r NOT IN (SELECT r FROM o) AS kept FROM f
"""
