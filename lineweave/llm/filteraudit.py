"""Filter interaction audit: what each of five filters removes, in every order, by the Hart-Mas-Colell potential.

The removal game of a part gives a coalition S of filters the number v(S) of documents that fail any filter in S.  Texts
are read once, for a set of failed filters per document; a part is then 32 counts, and these give v of all 32 coalitions.
The potential is P({}) = 0, P(S) = (v(S) + sum of P(S without i)) / |S|, so a filter's Shapley value is P(all) less
P(all without it); 120 P is whole at every coalition.  A filter's step after the filters in S removes v(S with it) - v(S).
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD_CHARS, n_words, shared_table, table

FILTERS = "ABCDE"
ALL = 2 ** len(FILTERS) - 1


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, content, failed): bits of the filters A to D that a whole text fails, and its digest."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t"))
    words, distinct = n_words(F.col("t")), F.size(F.array_distinct(F.regexp_extract_all("t", F.lit(WORD_CHARS), F.lit(0)))).cast("long")
    fails = [words < 50, distinct * 100 < words * 65, F.regexp_count("t", F.lit("[A-Z]")).cast("long") * 100 > F.length("t").cast("long") * 5, F.col("t").rlike(r"[#$%&*|]")]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return d.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("content"), bits.alias("failed"))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents of each part by the whole set of filters they fail.

    E fails where a smaller doc_id has the same text: only the row that holds a text's least id is looked up, so a text
    or a null id that a third of all rows share is counted before it is shuffled.
    """
    judged = shared_table(failures(docs).groupBy("doc_id", "part", "content", "failed").agg(F.count(F.lit(1)).alias("n")), "failures")
    first = judged.groupBy("content").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = (labels.filter("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("is_toxic")))
    held = judged.filter("doc_id IS NOT NULL").join(first.filter("doc_id IS NOT NULL"), ["doc_id", "content"], "left").join(known, "doc_id", "left")
    repeated = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    held = held.select("part", (F.col("failed") + repeated).alias("failed"), "n", "is_good", "is_toxic")
    unnamed = judged.filter("doc_id IS NULL").select("part", "failed", "n", F.lit(False).alias("is_good"), F.lit(False).alias("is_toxic"))
    return (held.unionByName(unnamed).groupBy("part", "failed")
            .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic")))


def games(counts: DataFrame) -> DataFrame:
    """One row per part: its documents, and v of every coalition over all, good and toxic documents (``v``, ``good``, ``toxic``)."""
    def value(column):
        return F.array(*[F.sum(F.when(F.col("failed").bitwiseAND(s) != 0, F.col(column)).otherwise(0)) for s in range(ALL + 1)])
    return counts.groupBy("part").agg(F.sum("n").alias("documents"), value("n").alias("v"), value("good").alias("good"), value("toxic").alias("toxic"))


def with_potential(played: DataFrame) -> DataFrame:
    """``games`` with ``potential``: 120 times the potential of each coalition, one level of coalition sizes after the other."""
    n = len(FILTERS)
    played = played.withColumn("p_0", F.lit(0).cast("long"))
    for size in range(1, n + 1):
        level = [s for s in range(ALL + 1) if s.bit_count() == size]
        played = played.withColumns({f"p_{s}": F.expr(f"(120 * v[{s}] + {' + '.join(f'p_{s ^ (1 << i)}' for i in range(n) if s >> i & 1)}) div {size}") for s in level})
    return played.select("part", "documents", "v", "good", "toxic", F.array(*[F.col(f"p_{s}") for s in range(ALL + 1)]).alias("potential"))


def orders():
    """All orders of the filters, as strings."""
    from itertools import permutations
    return ["".join(p) for p in permutations(FILTERS)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step of ``docs`` (doc_id, text, source) with the contract's counts.

    A null text is empty, a null source is the part ``""`` together with the empty one.  Rows with a null id count, have no
    labels and never repeat a smaller id; rows alike are counted each; of several labels of a document any 1 counts.
    Without documents there are no parts and no rows.
    """
    played = with_potential(games(failure_counts(docs, labels)))
    each = played.withColumn("filter_order", F.explode(F.lit(orders())))
    each = each.select("*", F.posexplode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("at", "step"))
    each = each.withColumns({"mine": F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)"),
                             "before": F.expr(f"aggregate(filter(split(left(filter_order, step - 1), ''), x -> x != ''), 0, (a, x) -> a + shiftleft(1, instr('{FILTERS}', x) - 1))")})

    def at(values, coalition):
        return F.get(values, coalition)
    after = F.col("before") + F.col("mine")
    rest = F.lit(ALL) - F.col("mine")
    removed = at("v", after) - at("v", F.col("before"))
    return each.select("part", "filter_order", "step", (F.col("documents") - at("v", after)).alias("kept"), removed.alias("removed"), (at("v", F.col("mine")) - removed).alias("redundant"),
                       (F.get("v", F.lit(ALL)) - at("v", rest)).alias("unique_fails"), (at("good", after) - at("good", F.col("before"))).alias("good_lost"),
                       (at("toxic", after) - at("toxic", F.col("before"))).alias("toxic_lost"), (F.get("potential", F.lit(ALL)) - at("potential", rest)).alias("shapley"))


def op13_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every document goes through every order, filter by filter.
OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d LEFT JOIN l USING (doc_id)),
o(s) AS (SELECT '' UNION ALL SELECT s || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(x) WHERE NOT contains(s, x)),
w AS (SELECT part, good, toxic, fails, s AS filter_order, coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda x: instr(s, x))), 6) AS gone FROM f, o WHERE length(s) = 5),
k AS (SELECT part, filter_order, step, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
             count(*) FILTER (gone < step AND contains(fails, filter_order[step])) AS redundant, count(*) FILTER (fails = filter_order[step]) AS unique_fails,
             count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost
      FROM w, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step) GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM k
"""
