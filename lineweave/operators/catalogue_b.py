"""Second catalogue: import, search, list resolution and cart."""
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores as D
from ..functions import text as T
from .common import contained, first_per_key, last_per_key


def import_catalogue_b(src1, src2):
    """First SKU of source 1, last SKU of source 2; EAN and fiscal class prefer source 2."""
    raw = lambda c: F.upper(F.trim(T.text(F.col(c))))
    blank = lambda c: T.nullify(F.col(c))
    a = src1.withColumn("sku_raw", raw("sku")).withColumn("sku_norm", T.norm_sku(F.col("sku"))).filter("sku_norm <> '' and sku_raw not in ('NAN', 'NONE')")
    a = first_per_key(a, "sku_norm", "row_ord")
    b = last_per_key(src2.withColumn("sku_raw", raw("sku")).filter("sku_raw <> ''"), "sku_raw", "row_ord").select(
        "sku_raw", F.col("ean").alias("ean2"), F.col("ncm").alias("ncm2"), "lot", "tax_pct")
    lot = T.positive_number(F.col("lot"))
    return a.join(b, "sku_raw", "left").select(
        "row_ord", "sku_raw", "sku_norm", T.digits(F.col("sku_norm")).alias("sku_digits"), T.sku_prefix(F.col("sku_norm")).alias("sku_prefix"),
        F.coalesce(blank("description"), F.lit("")).alias("description"), F.floor(lot).cast("bigint").cast("string").alias("lot"),
        F.coalesce(blank("ncm2"), blank("ncm")).alias("ncm"), F.coalesce(blank("ean2"), blank("ean")).alias("ean"), T.parse_percent(F.col("tax_pct")).alias("tax_pct"))


def resolve_list(rows, cat):
    """Exact SKU, unique digits, digits plus wording, wording contained: each tier on what is left."""
    r = rows.select("code", "description").distinct().withColumn("k", T.norm_sku(F.col("code"))).withColumn("d", T.digits(F.col("k"))).withColumn("q", F.upper(F.trim(T.text(F.col("description")))))
    key = ["code", "description"]
    out = ["sku_raw", F.col("description").alias("found")]
    c = cat.select("row_ord", "sku_norm", "sku_digits", "sku_raw", F.col("description").alias("c_description"))

    def pick(p, tier):
        return p.groupBy(*key).agg(F.min_by(F.struct("sku_raw", "c_description"), "row_ord").alias("_b")).select(*key, F.lit(tier).alias("tier"), "_b.*")

    def left(done):
        return r.join(done.select(*key), key, "left_anti")

    t1 = pick(r.filter("k <> ''").join(c, F.col("k") == F.col("sku_norm")), 1)
    unique = c.groupBy("sku_digits").agg(F.count("*").alias("n"), F.min(F.struct("row_ord", "sku_raw", "c_description")).alias("_u")).filter("n = 1 and sku_digits <> ''")
    t2 = left(t1).join(unique, F.col("d") == F.col("sku_digits")).select(*key, F.lit(2).alias("tier"), "_u.sku_raw", "_u.c_description")
    done = t1.unionByName(t2)
    p3 = left(done).filter("d <> '' and q <> ''").join(c, F.col("d") == F.col("sku_digits")).withColumn("score", D.token_set_ratio(F.col("q"), F.upper(F.trim("c_description"))))
    t3 = p3.filter("score >= 0.80").groupBy(*key).agg(F.min_by(F.struct("sku_raw", "c_description"), F.struct((-F.col("score")).alias("s"), "row_ord")).alias("_b")).select(*key, F.lit(3).alias("tier"), "_b.*")
    done = done.unionByName(t3)
    # wordings that stand somewhere in a product's: one automaton over the catalogue
    asked = left(done).filter("q <> ''")
    p4 = contained(c, "row_ord", F.upper("c_description"), asked, F.col("q")).withColumnRenamed("needle", "q").join(asked, "q").join(c, "row_ord") \
        .withColumn("score", D.token_set_ratio(F.col("q"), F.upper("c_description")))
    t4 = p4.filter("score >= 0.85").groupBy(*key).agg(F.min_by(F.struct("sku_raw", "c_description"), F.struct((-F.col("score")).alias("s"), "row_ord")).alias("_b")).select(*key, F.lit(4).alias("tier"), "_b.*")
    found = done.unionByName(t4)
    return rows.join(found, key, "left")


STOP = ["DE", "DA", "DO", "PARA", "COM", "SEM", "EM", "NO", "NA", "E"]


def ranked_search(queries, cat, page=1, per_page=50):
    """The first tier with a hit answers: SKU, SKU prefix, digits, digits prefix, all words, any word."""
    per_page = max(1, min(per_page, 100))
    q = queries.select("query").distinct().withColumn("qn", F.upper(F.trim("query"))).withColumn("k", T.norm_sku(F.col("query")))
    q = q.withColumn("codey", ~F.col("qn").contains(" ") & F.col("k").rlike(r"^\d+$|^[A-Z]{1,4}\d+[A-Z0-9]*$"))
    c = cat.select("row_ord", "sku_norm", "sku_digits", "sku_raw", "description")
    pre = lambda col: F.explode(F.transform(F.sequence(F.lit(1), F.length(col)), lambda n: F.substring(F.col(col), F.lit(1), n)))
    code = q.filter("codey")
    num = code.filter(F.col("k").rlike(r"^\d+$"))
    hits = [code.join(c, F.col("k") == F.col("sku_norm")).withColumn("tier", F.lit(1)),
            code.join(c.filter("sku_norm <> ''").withColumn("p", pre("sku_norm")), F.col("k") == F.col("p")).drop("p").withColumn("tier", F.lit(2)),
            num.join(c, F.col("k") == F.col("sku_digits")).withColumn("tier", F.lit(3)),
            num.join(c.filter("sku_digits <> ''").withColumn("p", pre("sku_digits")), F.col("k") == F.col("p")).drop("p").withColumn("tier", F.lit(4))]
    letter = F.nullif(F.regexp_extract("qn", r"\bCURVA\s*([ABCD])\b", 1), F.lit(""))
    toks = F.filter(F.regexp_extract_all("qn", F.lit(r"[A-Z0-9+]+"), F.lit(0)), lambda t: ~t.isin(STOP) & (F.length(t) >= 2))
    w = q.withColumn("letter", letter).withColumn("toks", toks).withColumn("toks", F.when(F.col("letter").isNotNull(), F.concat(
        F.filter("toks", lambda t: t != "CURVA"), F.array(F.concat(F.lit("CURVA "), F.col("letter"))))).otherwise(F.col("toks"))).filter("size(toks) > 0")
    # the words of all queries run as one automaton over the catalogue
    word = w.select("query", "toks", F.explode(F.array_distinct("toks")).alias("tok"))
    hits_of = contained(c, "row_ord", F.upper("description"), word, F.col("tok")).withColumnRenamed("needle", "tok")
    per = word.join(hits_of, "tok").join(c.select("row_ord", "sku_raw"), "row_ord").groupBy("query", "toks", "row_ord", "sku_raw").agg(F.countDistinct("tok").alias("n"))
    texts = per.select("query", "row_ord", "sku_raw", F.when(F.col("n") == F.size(F.array_distinct("toks")), 5).otherwise(6).alias("tier"))
    every = reduce(lambda a, b: a.unionByName(b), [h.select("query", "row_ord", "sku_raw", "tier") for h in hits] + [texts])
    best = every.groupBy("query").agg(F.min("tier").alias("tier"))
    ranked = every.join(best, ["query", "tier"]).withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("row_ord")))
    return ranked.filter((F.col("rank") > (page - 1) * per_page) & (F.col("rank") <= F.when(F.col("tier").isin(1, 3), 1).otherwise(page * per_page)))


def cart_totals(adds):
    """Each addition is rounded up to the lot, then summed per user and code."""
    lot = F.coalesce(T.positive_number(F.col("lot")), F.lit(1.0))
    qty = F.coalesce(T.positive_number(F.col("qty")), lot)
    return adds.withColumn("_q", D.to_multiple(qty, lot)).groupBy("user", "code").agg(F.sum("_q").alias("_s")).select("user", "code", T.format_qty(F.col("_s")).alias("qty"))


def cart_sheet(cart):
    """S16."""
    return cart.select("description", "code", "qty")
