"""Queries over the second catalogue and the readers and writers."""
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue_b as B
from ..session import checkpoint_dir
from ..sources import readers, writers
from .registry import query

_S1 = "SELECT p_partkey AS row_ord, 'SK-' || CAST(p_partkey % 1500 AS STRING) || '.' || p_brand AS sku, p_name || ' ' || p_type AS description, CAST(p_size AS STRING) AS ncm, 'nan' AS ean FROM {part}"
_S2 = "SELECT p_partkey AS row_ord, ' sk-' || CAST(p_partkey % 1500 AS STRING) || '.' || p_brand || ' ' AS sku, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_partkey AS STRING) END AS ean, 'none' AS ncm, CASE WHEN p_size % 4 = 0 THEN 'sim' ELSE CAST(p_size AS STRING) || ',0' END AS lot, '12,5%' AS tax_pct FROM {part}"


def cat_b(s):
    return B.import_catalogue_b(s.sql(_S1), s.sql(_S2))


_CB = f"""SELECT a.row_ord, a.sku_norm, a.description, CASE WHEN b.lot <> 'sim' THEN CAST(CAST(replace(b.lot, ',', '.') AS DOUBLE) AS BIGINT) END AS lot, a.ncm, nullif(b.ean, '') AS ean FROM (SELECT * FROM (SELECT *, regexp_replace(upper(sku), '[^A-Z0-9]+', '', 'g') AS sku_norm, row_number() OVER (PARTITION BY regexp_replace(upper(sku), '[^A-Z0-9]+', '', 'g') ORDER BY row_ord) AS rn FROM ({_S1})) WHERE rn = 1) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY upper(trim(sku)) ORDER BY row_ord DESC) AS rn FROM ({_S2})) b ON upper(trim(a.sku)) = upper(trim(b.sku)) AND b.rn = 1"""
query("s18_import_catalogue_b", f"SELECT row_ord, sku_norm, description, CAST(lot AS VARCHAR) AS lot, ncm, ean FROM ({_CB})")(lambda s: cat_b(s).select("row_ord", "sku_norm", "description", "lot", "ncm", "ean"))
_UP = "SELECT DISTINCT CASE l_linenumber WHEN 1 THEN 'sk ' || CAST(l_partkey % 1500 AS STRING) || '/brand#' || CAST(l_suppkey % 25 + 1 AS STRING) WHEN 2 THEN CAST(l_partkey AS STRING) ELSE '' END AS code, CASE WHEN l_linenumber = 3 THEN p_name ELSE p_name || ' ' || p_type END AS description FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
query("j21_resolve_list")(lambda s: B.resolve_list(s.sql(_UP), cat_b(s)).groupBy("tier").agg(F.count("*").alias("n")))
_SQ = "SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'SK' || CAST(p_partkey AS STRING) WHEN 1 THEN CAST(p_partkey AS STRING) WHEN 2 THEN p_name ELSE p_name || ' para XYZ' END AS query FROM {part}"
_CBN = f"SELECT row_ord, sku_norm, regexp_replace(sku_norm, '[^0-9]', '', 'g') AS sku_digits, description FROM ({_CB})"
query("w16_ranked_search", f"""
WITH q AS (SELECT query, upper(trim(query)) AS qn, regexp_replace(upper(query), '[^A-Z0-9]+', '', 'g') AS k FROM ({_SQ})), c AS ({_CBN}),
w AS (SELECT *, NOT contains(qn, ' ') AND regexp_matches(k, '^[0-9]+$|^[A-Z]{{1,4}}[0-9]+[A-Z0-9]*$') AS codey, regexp_matches(k, '^[0-9]+$') AS num,
             list_distinct(list_filter(regexp_extract_all(qn, '[A-Z0-9+]+'), lambda t: length(t) >= 2 AND NOT list_contains(['DE', 'DA', 'DO', 'PARA', 'COM', 'SEM', 'EM', 'NO', 'NA', 'E'], t))) AS toks FROM q),
h AS (SELECT query, row_ord, CASE WHEN codey AND k = sku_norm THEN 1 WHEN codey AND sku_norm <> '' AND starts_with(sku_norm, k) THEN 2 WHEN codey AND num AND k = sku_digits THEN 3 WHEN codey AND num AND sku_digits <> '' AND starts_with(sku_digits, k) THEN 4
             WHEN len(toks) > 0 AND len(list_filter(toks, lambda t: contains(upper(description), t))) = len(toks) THEN 5 WHEN len(list_filter(toks, lambda t: contains(upper(description), t))) > 0 THEN 6 END AS tier FROM w, c),
b AS (SELECT query, min(tier) AS tier FROM h GROUP BY query), r AS (SELECT query, tier, row_number() OVER (PARTITION BY query ORDER BY row_ord) AS rank FROM h JOIN b USING (query, tier))
SELECT tier, count(*) AS rows, count(DISTINCT query) AS queries FROM r WHERE rank <= CASE WHEN tier IN (1, 3) THEN 1 ELSE 50 END GROUP BY tier""")(lambda s: B.ranked_search(s.sql(_SQ), cat_b(s)).groupBy("tier").agg(F.count("*").alias("rows"), F.countDistinct("query").alias("queries")))
query("a18_cart_totals", "SELECT CAST(l_suppkey AS VARCHAR) AS \"user\", CAST(l_partkey AS VARCHAR) AS code, CAST(CAST(sum(ceil(l_quantity / (1 + l_partkey % 6)) * (1 + l_partkey % 6)) AS BIGINT) AS VARCHAR) AS qty FROM {lineitem} GROUP BY 1, 2")(
    lambda s: B.cart_totals(s.lineitem.select(F.col("l_suppkey").cast("string").alias("user"), F.col("l_partkey").cast("string").alias("code"), (1 + F.col("l_partkey") % 6).cast("string").alias("lot"), F.col("l_quantity").cast("string").alias("qty"))))
query("s16_cart_sheet", "SELECT p_name AS description, p_brand AS code, CAST(p_size AS VARCHAR) AS qty FROM {part}")(
    lambda s: B.cart_sheet(s.part.select(F.col("p_name").alias("description"), F.col("p_brand").alias("code"), F.col("p_size").cast("string").alias("qty"), "p_partkey")))


def folder(s):
    """A folder every executor can write: below the shared checkpoint folder."""
    return f"{checkpoint_dir(s.spark)}/run-{uuid.uuid4().hex}"


def csv_round_trip(s, df, sep, read):
    path = folder(s) + "/csv"
    df.write.option("sep", sep).option("header", True).csv(path)
    return read(s.spark, path)


query("s1_read_catalogue", "SELECT CAST(p_partkey AS VARCHAR) AS product_code, p_name AS description FROM {part}")(
    lambda s: csv_round_trip(s, s.part.select(F.col("p_partkey").cast("string").alias("product_code"), F.col("p_name").alias("description"), "p_brand"), ";",
                             lambda sp, p: readers.read_catalogue(sp, p, ["product_code", "description"])).select("product_code", "description"))
query("s2_read_delimited", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM {supplier}")(lambda s: csv_round_trip(s, s.supplier.select("s_suppkey", "s_name"), "|", readers.read_delimited))
query("s3_read_csv_robust", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM {customer}")(lambda s: csv_round_trip(s, s.customer.select("c_custkey", "c_name"), ";", readers.read_csv_robust))
query("s4_resolve_columns", "SELECT p_partkey AS code, p_name AS description FROM {part}")(
    lambda s: readers.resolve_columns(s.part.withColumnRenamed("p_partkey", "Código Produto").withColumnRenamed("p_name", "DESCRIÇÃO"), {"code": ["sku", "codigo_produto"], "description": ["descricao", "nome"]}))
query("s6_code_map_regional", "SELECT p_partkey, state, price FROM (UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) + 0.5 AS PR, CASE WHEN p_size > 9 THEN CAST(p_size AS DOUBLE) END AS GO FROM {part}) ON PR, GO INTO NAME state VALUE price) UNION ALL SELECT p_partkey, 'GO', NULL FROM {part} WHERE p_size <= 9")(
    lambda s: readers.read_code_map_regional(s.part.select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(",5")).alias("PR"), F.when(F.col("p_size") > 9, F.col("p_size").cast("string")).otherwise("#N/D").alias("GO")), keys=("p_partkey",)))
_RAW = "SELECT p_partkey AS c0, CAST(p_partkey AS STRING) || '.0' AS c1, CASE WHEN p_size = 3 THEN '' ELSE p_name END AS c2, CASE WHEN p_size = 4 THEN '0' ELSE 'R$ 1.2' || CAST(10 + p_size AS STRING) || ',50' END AS c3 FROM {part}"
query("s7_import_price_table", f"SELECT CAST(c0 AS VARCHAR) AS product_code, c2 AS description, CAST(replace(replace(replace(c3, 'R$ ', ''), '.', ''), ',', '.') AS DOUBLE) AS price FROM ({_RAW}) WHERE c2 <> '' AND c3 <> '0' AND c0 >= 2")(
    lambda s: readers.import_price_table(s.sql(_RAW), {"client": "A", "validity": "1 SEM - 26", "first_row": 2, "row_column": "c0", "columns": {"product_code": 1, "description": 2, "price": 3}}).select("product_code", "description", "price"))


def replace_on_import(s):
    path = folder(s) + "/tables"
    t = s.price_table.select("client", "validity", "product_code", F.col("price").cast("double").alias("price"))
    writers.write_price_table(t, path)
    writers.write_price_table(t.filter("client = 'PROMO' and validity like '2%'").withColumn("price", F.lit(1.0)), path)
    return s.spark.read.parquet(path).groupBy("client", "validity").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


query("s8_write_price_table", "SELECT client, validity, count(*) AS n, round(sum(CASE WHEN client = 'PROMO' AND validity LIKE '2%' THEN 1.0 ELSE CAST(price AS DOUBLE) END), 2) AS total FROM {price_table} GROUP BY 1, 2")(replace_on_import)


def shadow_round_trip(s):
    path = folder(s) + "/log"
    s.events.select(F.col("event_type").alias("descricao_oc"), F.struct(F.col("user_id").cast("string").alias("codigo"), F.lit("x").alias("tipo_match"), F.col("value").alias("score")).alias("motor_atual"), (F.col("value") > 10).alias("concordam")).write.json(path)
    return readers.read_shadow_log(s.spark, path).groupBy("descricao_oc", "concordam").agg(F.count("*").alias("n"), F.countDistinct("motor_atual.codigo").alias("codes"))


query("s10_read_shadow_log", "SELECT event_type AS descricao_oc, value > 10 AS concordam, count(*) AS n, count(DISTINCT user_id) AS codes FROM {events} GROUP BY 1, 2")(shadow_round_trip)


def json_array_round_trip(s):
    path = folder(s) + "/arr"
    # one array per brand, one file each
    arrays = s.part.groupBy("p_brand").agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name"))).alias("value"))
    arrays.write.partitionBy("p_brand").text(path)
    return readers.read_json_array(s.spark, path, "p_partkey long, p_name string").select("p_partkey", "p_name")


query("s11_read_json_array", "SELECT p_partkey, p_name FROM {part}")(json_array_round_trip)


def processed_round_trip(s):
    path = folder(s) + "/out"
    writers.write_processed(s.orders.select("o_orderkey", "o_orderstatus"), path)
    return s.spark.read.option("sep", ";").option("header", True).csv(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


query("s12_write_processed", "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1")(processed_round_trip)
query("s13_entry_sheet", "SELECT CASE WHEN l_returnflag = 'R' THEN l_returnflag ELSE l_linestatus END AS description, CASE WHEN l_tax = 0 THEN 'BR' ELSE 'UN' END AS unit, l_partkey AS product_code, coalesce(CASE WHEN l_discount > 0 THEN l_quantity END, 1.0) AS qty FROM {lineitem}")(
    lambda s: writers.entry_sheet(s.lineitem.select(F.when(F.col("l_returnflag") == "R", F.col("l_returnflag")).alias("matched_description"), F.col("l_linestatus").alias("description"), F.lit(None).cast("string").alias("final_unit"),
        F.when(F.col("l_tax") == 0, "BR").alias("sale_unit"), F.lit(" ").alias("unit"), F.col("l_partkey").alias("product_code"), F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("final_qty"), F.lit(1.0).alias("adjusted_qty"))))


def validation_split(s):
    base = folder(s)
    writers.write_validation(s.lineitem.select("l_orderkey", (F.col("l_tax") > 0.04).alias("approved")), base + "/ok", base + "/review")
    read = lambda p: s.spark.read.option("sep", ";").option("header", True).csv(base + p).groupBy("approved").agg(F.count("*").alias("n"))
    return read("/ok").unionByName(read("/review"))


query("s14_write_validation", "SELECT CAST(l_tax > 0.04 AS VARCHAR) AS approved, count(*) AS n FROM {lineitem} GROUP BY 1")(validation_split)


def process_store(s):
    path = folder(s) + "/proc"
    writers.save_process(s.process_rows.select("process_id", "product_code", "qty", F.col("unit").alias("client")), path)
    return writers.load_process(s.spark, path, "100").select("product_code", "qty")


query("s17_save_process", "SELECT product_code, qty FROM {process_rows} WHERE process_id = '100'")(process_store)
