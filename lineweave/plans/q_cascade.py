"""Queries over the client's price table (J8-J12, A8, F10-F15, W5, M4, M14, M15) and the whole cascade."""
from pyspark.sql import functions as F

from ..functions import features as P
from ..functions import text as T
from ..operators import cascade as K
from ..operators import catalogue as C
from ..operators import clienttable as X
from ..operators import linkage as L
from .q_linkage import featured, texts
from .registry import query

LINES = "SELECT *, concat_ws('-', doc_id, line_no, part_ord, supp_ord, CAST(qty AS STRING), CAST(unit_price AS STRING)) AS line_key FROM {items}"


def lines(s):
    client = s.part.select(F.col("p_partkey").alias("part_ord"), F.col("p_type").alias("client"))
    return s.items.join(client, "part_ord").withColumn("line_key", F.concat_ws("-", "doc_id", "line_no", "part_ord", "supp_ord", "qty", "unit_price"))


_DIR = "SELECT i.doc_id, count(*) AS n, min(c.description) AS first_description FROM (SELECT * FROM {items}) i JOIN (SELECT * FROM {catalogue} WHERE product_code NOT IN ('0784', '01758', '01759', '01761')) c ON nullif(trim(i.own_code), '') IS NOT NULL AND coalesce(nullif(ltrim(trim(i.own_code), '0'), ''), '0') = coalesce(nullif(ltrim(c.product_code, '0'), ''), '0') GROUP BY 1"


def cat_min(s):
    """Catalogue with codes and descriptions only: the exact stages need no attributes."""
    return C.drop_blocked(s.catalogue.withColumn("code", T.drop_zeros(F.col("product_code"))).withColumn("product_code", T.drop_zeros(F.col("product_code"))))


query("m1_match_direct", _DIR)(lambda s: K.match_direct(s.items, cat_min(s), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("matched_description").alias("first_description")))
query("m2_match_code_map", "SELECT doc_id, count(*) AS n FROM (SELECT * FROM {items}) i WHERE layout = 'MRV' AND regexp_replace(client_code, '\\D', '', 'g') IN (SELECT regexp_replace(client_code, '\\D', '', 'g') FROM {code_map}) GROUP BY 1")(
    lambda s: K.match_code_map(s.items, s.code_map, cat_min(s), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n")))
query("m3_match_code_map_text", "SELECT doc_id, count(*) AS n FROM (SELECT * FROM {items}) i WHERE layout NOT IN ('GENERICO', 'DESCONHECIDO') AND trim(client_code) IN (SELECT client_code FROM {code_map}) GROUP BY 1")(
    lambda s: K.match_code_map_text(s.items, s.code_map, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n")))


def corrections(s):
    return s.sql("SELECT 'FVM - ' || description || ' BRANCO' AS description, product_code, description AS product_description, row_ord FROM {catalogue}")


query("j14_match_corrections")(lambda s: K.match_corrections(texts(s), corrections(s)))
query("m5_match_correction")(lambda s: K.match_corrections(texts(s), corrections(s)).groupBy("score").agg(F.count("*").alias("texts")))
query("m10_match_fallback")(lambda s: K.match_fallback(L.item_features(s.sql("SELECT DISTINCT p_name || ' ' || CAST(p_size AS STRING) || 'MM' AS description FROM {part}")), L.candidate_side(featured(s))))
query("m11_apply_verdicts", "SELECT description, product_code FROM (SELECT DISTINCT description FROM {items}) JOIN (SELECT description AS d, '0' || CAST(max(row_ord) AS VARCHAR) AS product_code FROM {catalogue} GROUP BY 1) ON description = d WHERE product_code NOT IN ('0784', '01758', '01759', '01761')")(
    lambda s: K.apply_verdicts(texts(s).select("description"), s.catalogue.groupBy("description").agg(F.concat(F.lit("0"), F.max("row_ord").cast("string")).alias("verdict_code"))
        .select("description", "verdict_code", F.lit("alta").alias("confidence"), F.lit("x").alias("justification"), F.lit(0.5).alias("score")), cat_min(s)).select("description", "product_code"))
_LK = "concat_ws('-', doc_id, line_no, part_ord, supp_ord, qty, unit_price)"
query("m12_exact_stages", """
WITH i AS (SELECT row_number() OVER () AS r, * FROM (SELECT * FROM {items})), c AS (SELECT coalesce(nullif(ltrim(product_code, '0'), ''), '0') AS code FROM {catalogue} WHERE product_code NOT IN ('0784', '01758', '01759', '01761')),
m AS (SELECT regexp_replace(client_code, '\\D', '', 'g') AS k, arg_max(product_code, row_ord) AS code FROM {code_map} GROUP BY 1), t AS (SELECT client_code AS k, arg_max(product_code, row_ord) AS code FROM {code_map} GROUP BY 1),
x AS (SELECT r, 0 AS p, trim(own_code) AS product_code, 'MATCH_CODIGO_DIRETO_OC' AS match_type FROM i WHERE nullif(trim(own_code), '') IS NOT NULL AND coalesce(nullif(ltrim(trim(own_code), '0'), ''), '0') IN (SELECT code FROM c)
      UNION ALL SELECT r, 1, m.code, 'MATCH_CODIGO_MRV' FROM i JOIN m ON regexp_replace(client_code, '\\D', '', 'g') = m.k WHERE layout = 'MRV'
      UNION ALL SELECT r, 2, t.code, 'BRASAL_DIRETO' FROM i JOIN t ON trim(client_code) = t.k WHERE layout NOT IN ('GENERICO', 'DESCONHECIDO'))
SELECT i.doc_id, i.line_no, i.part_ord, min_by(match_type, p) AS match_type, count(DISTINCT r) AS n FROM x JOIN i USING (r) GROUP BY ALL""".replace("min_by(match_type, p) AS match_type, count(DISTINCT r) AS n FROM x JOIN i USING (r) GROUP BY ALL", "match_type, count(*) AS n FROM (SELECT r, arg_min(match_type, p) AS match_type FROM x GROUP BY r) JOIN i USING (r) GROUP BY ALL"))(
    lambda s: (lambda i: K.exact_stages(i.withColumn("line_key", F.monotonically_increasing_id()), cat_min(s), s.code_map, s.code_map).join(i.withColumn("line_key", F.monotonically_increasing_id()).select("line_key", "doc_id", "line_no", "part_ord"), "line_key")
               .groupBy("doc_id", "line_no", "part_ord", "match_type").agg(F.count("*").alias("n")))(C.cut_lineage(s.items)))


def vectors_of(s):
    """Vector matches of order wordings: the product vectors are given, a wording takes the vector of a product of its part."""
    w = s.items.groupBy("description").agg(F.min("part_ord").alias("vec_id")).join(s.embeddings.select("vec_id", "embedding"), "vec_id")
    q = C.cut_lineage(L.vector_features(w.withColumn("query_id", F.xxhash64("description")), "description"))
    vec = s.embeddings.select(F.col("vec_id").alias("row_ord"), F.concat(F.lit("0"), F.col("vec_id").cast("string")).alias("product_code"), "embedding")
    return L.match_vector(L.knn(q.select("query_id", "embedding"), vec), q, featured(s)).join(q.select("query_id", "description"), "query_id")


def whole_cascade(s):
    return K.match_items(lines(s), s.catalogue, s.code_map, corrections(s), s.code_map, s.price_table.filter("client <> 'ECONOMY'"), vectors_of(s))[0]


query("m12_match_items")(lambda s: whole_cascade(s).select("line_key", "product_code", "score", "match_type", "reason", "manual_review", "composition", "candidates"))
query("m13_match_batch")(lambda s: K.match_batch(lines(s), s.catalogue, code_map=s.code_map, price_table=s.price_table).groupBy("match_type", "quantity_kind").agg(F.count("*").alias("n"), F.sum("adjusted_qty").alias("qty")))
query("m16_shadow_compare", """SELECT agree, count(*) AS n FROM (SELECT p_name AS k, CASE WHEN p_size > 25 THEN p_brand ELSE '' END = CASE WHEN p_size > 10 THEN p_brand ELSE '' END AND p_size > 25 AS agree FROM {part}) GROUP BY 1""")(
    lambda s: K.shadow_compare(s.part.select("p_partkey", F.lit("MATCH_DESCRICAO").alias("match_type"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("product_code"), F.lit(1.0).alias("score")),
                               s.part.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("product_code"), F.lit(1.0).alias("score")), "p_partkey").groupBy("agree").agg(F.count("*").alias("n")))

# ---- client tables ----
query("j11_latest_table", "SELECT client, max(validity) AS validity, count(*) AS n FROM (SELECT * FROM {price_table}) WHERE validity = '2 SEM - 2026' GROUP BY client")(
    lambda s: X.latest_table(s.price_table).groupBy("client").agg(F.max("validity").alias("validity"), F.count("*").alias("n")))
query("a21_tables_available", "SELECT client, validity, count(*) AS items FROM (SELECT * FROM {price_table}) WHERE validity = '2 SEM - 2026' GROUP BY client, validity")(lambda s: X.tables_available(s.price_table))
_IDS = "SELECT s_name AS client, 'term' AS kind, 'word ' || CAST(s_suppkey % 50 AS STRING) || ' end' AS value FROM {supplier} UNION ALL SELECT s_name, 'domain', 'mail' || CAST(s_suppkey AS STRING) || '.example' FROM {supplier} UNION ALL SELECT s_name, 'cnpj', CAST(10000000 + s_suppkey * 7 AS STRING) || '/0001' FROM {supplier}"
_IDD = "SELECT o_orderkey AS doc_id, 'Pedido word ' || CAST(o_custkey % 80 AS STRING) || ' end ' || CASE WHEN o_orderstatus = 'P' THEN 'x@mail' || CAST(o_custkey % 30 AS STRING) || '.example ' ELSE '' END || CASE WHEN o_orderstatus = 'F' THEN CAST(10000000 + o_custkey % 60 * 7 AS STRING) || '0001' ELSE '' END AS text FROM {orders}"
query("j12_identify_client", f"""WITH d AS ({_IDD}), i AS ({_IDS}) SELECT doc_id, arg_min(client, struct_pack(t := tier, c := client)) AS client FROM (SELECT doc_id, client, CASE kind WHEN 'cnpj' THEN 1 WHEN 'domain' THEN 2 ELSE 3 END AS tier FROM d JOIN i ON CASE kind
  WHEN 'cnpj' THEN contains(regexp_replace(text, '\\D', '', 'g'), regexp_replace(value, '\\D', '', 'g')) WHEN 'domain' THEN contains(array_to_string(regexp_extract_all(text, '@([\\w.-]+)', 1), ' '), value) ELSE contains(upper(text), upper(value)) END) GROUP BY doc_id""")(
    lambda s: X.identify_client(s.sql(_IDD), s.sql(_IDS)))
query("f14_codes_reliable", "SELECT l_orderkey AS doc_id, bool_and(l_tax > 0) AS codes_reliable FROM {lineitem} GROUP BY 1")(
    lambda s: X.codes_reliable(s.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row_ord"), F.when(F.col("l_tax") > 0, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).otherwise("").alias("client_code"))))
_RAT = "SELECT CAST(l_orderkey AS STRING) AS doc_id, CASE WHEN l_linenumber < 4 THEN CAST(900 + l_partkey % 7 AS DOUBLE) / 1000 ELSE CAST(l_partkey % 100 + 50 AS DOUBLE) / 100 END AS ratio FROM {lineitem}"
query("a8_price_factor", f"""WITH r AS ({_RAT}), u AS (SELECT doc_id, ratio, count(*) AS c FROM r GROUP BY 1, 2), g AS (SELECT a.doc_id, a.ratio, sum(b.c) AS size FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.ratio BETWEEN a.ratio / 1.015 AND a.ratio * 1.015 GROUP BY 1, 2),
  b AS (SELECT doc_id, arg_min(struct_pack(r := ratio, s := size), struct_pack(s := -size, r := ratio)) AS m FROM g GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS total FROM r GROUP BY 1)
  SELECT b.doc_id, (list_sort((SELECT list(r.ratio) FROM r WHERE r.doc_id = b.doc_id AND r.ratio BETWEEN m.r / 1.015 AND m.r * 1.015)))[CAST(m.s // 2 AS BIGINT) + 1] AS factor FROM b JOIN t USING (doc_id) WHERE m.s >= greatest(2, floor(0.3 * total))""")(
    lambda s: X.price_factor(s.sql(_RAT)))


def client_lines(s):
    """Distinct (client, wording, price) of order lines; the client is the family of the part."""
    return s.items.join(s.part.select(F.col("p_partkey").alias("part_ord"), F.col("p_type").alias("client")), "part_ord") \
        .groupBy("client", "description", F.round(F.col("unit_price").cast("double") / 20, 2).alias("price")).agg(F.count("*").alias("n_lines")) \
        .withColumn("item_key", F.md5(F.concat_ws("|", "client", "description", "price"))).withColumn("factor", F.lit(None).cast("double"))


def table_side(s):
    return K.table_side(s.price_table, C.build_catalogue(s.catalogue))


def wordings(s):
    w = client_lines(s).groupBy("client", "description").agg(F.count("*").alias("n_prices")).withColumn("item_key", F.md5(F.concat_ws("|", "client", "description")))
    return L.item_features(w)


def table_pairs(s):
    return X.restricted_pairs(wordings(s), table_side(s))


def table_choice(s):
    names, _, won = X.judged_wordings(wordings(s), table_side(s))
    return X.of_items(names, won)


def table_match(s):
    items = priced_items(s)
    names, judged, won = X.judged_wordings(wordings(s), table_side(s))
    names = names.join(items.select("item_key", "price", "factor"), "item_key")
    return X.match_price_table(items, X.of_items(names, judged, "price", "factor"), X.of_items(names, won))


query("f10_restrict_price_table")(lambda s: table_pairs(s).groupBy("client", "ptype").agg(F.sum("n").alias("pairs"), F.countDistinct("item_key").alias("items")))
query("w5_first_without_conflict")(lambda s: table_choice(s).select("item_key", "product_code", "score", "conflict"))


def priced_items(s):
    """One price per wording and client, so that the price rules have something to confirm."""
    return s.items.join(s.part.select(F.col("p_partkey").alias("part_ord"), F.col("p_type").alias("client"), "p_retailprice"), "part_ord") \
        .groupBy("client", "description").agg(F.max("p_retailprice").alias("price")).withColumn("item_key", F.md5(F.concat_ws("|", "client", "description"))).withColumn("factor", F.lit(None).cast("double"))


query("j8_price_band")(lambda s: X.price_band(table_pairs(s).select("item_key", "n", "table_price").join(priced_items(s).select("item_key", "price", "factor"), "item_key"), 0.10).groupBy("item_key").agg(F.sum("n").alias("products")))
query("m4_match_price_table")(table_match)
query("m15_retry_without_angle", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'JOELHO PVC ' || CAST(p_size AS VARCHAR) ELSE 'LUVA ' || CAST(p_size AS VARCHAR) || ' X 90' END AS out FROM {part}""")(
    lambda s: s.sql("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'JOELHO PVC ' || CAST(p_size AS STRING) || ' X 90' ELSE 'LUVA ' || CAST(p_size AS STRING) || ' X 90' END AS d FROM {part}").select("p_partkey", X.without_angle(F.col("d")).alias("out")))
_F13 = "SELECT l_orderkey, l_linenumber, 'TUBO ' || CAST(20 + l_partkey % 3 AS STRING) || 'mm' AS a, CASE WHEN l_tax = 0 THEN 'TUBO' ELSE 'DN ' || CAST(20 + l_suppkey % 3 AS STRING) END AS b, l_partkey % 3 = l_suppkey % 3 OR l_tax = 0 AS same FROM {lineitem}"
query("f13_measures_compatible", f"SELECT l_orderkey, count(*) FILTER (same) AS compatible FROM ({_F13}) GROUP BY 1")(
    lambda s: s.sql(_F13).withColumn("x", P.typed_measures(F.col("a"))).withColumn("y", P.typed_measures(F.col("b"))).groupBy("l_orderkey").agg(F.count_if(X.measures_compatible(F.col("x"), F.col("y"))).alias("compatible")))
_F15T = "SELECT DISTINCT p_type AS client, 'TUBO ' || upper(split_part(p_name, ' ', 1)) AS description, 'TUBO' AS ptype FROM {part}"
_F15I = "SELECT DISTINCT p_type AS client, 'TUBO ' || upper(p_name) AS description, 'TUBO' AS ptype, p_type || p_name AS text_id FROM {part}"
query("f15_missing_tokens", f"""
WITH w AS (SELECT text_id, client, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT text_id, client, regexp_extract_all(description, '[A-Z]{{2,}}') AS ws FROM ({_F15I}))),
v AS (SELECT DISTINCT client, unnest(regexp_extract_all(description, '[A-Z]{{2,}}')) AS word FROM ({_F15T})),
st(word, stem) AS (SELECT word, CASE WHEN length(s) >= 4 AND (ends_with(s, 'A') OR ends_with(s, 'O')) THEN s[:-2] ELSE s END FROM (SELECT word, CASE WHEN length(word) >= 5 AND ends_with(word, 'S') THEN word[:-2] ELSE word END AS s FROM (SELECT word FROM w UNION SELECT word FROM v))),
x AS (SELECT w.text_id, w.word, min(w.pos) AS pos FROM w JOIN st USING (word) WHERE length(st.stem) >= 4 AND st.stem <> 'TUB' AND NOT EXISTS (SELECT 1 FROM v JOIN st AS vs ON v.word = vs.word WHERE v.client = w.client
      AND (vs.stem = st.stem OR (length(vs.stem) >= 3 AND starts_with(st.stem, vs.stem)) OR starts_with(vs.stem, st.stem))) GROUP BY 1, 2)
SELECT text_id, array_to_string(list(lower(word) ORDER BY pos), ', ') AS missing FROM x GROUP BY text_id""")(lambda s: X.missing_tokens(s.sql(_F15I), s.sql(_F15T)))


def coded_items(s):
    return s.items.join(s.part.select(F.col("p_partkey").alias("part_ord"), F.col("p_type").alias("client")), "part_ord").filter("client_code is not null") \
        .groupBy("client", "client_code", "description").agg(F.count("*").alias("n_lines")).withColumn("item_key", F.md5(F.concat_ws("|", "client", "client_code", "description")))


def indexed(s):
    return C.price_index(X.latest_table(s.price_table), s.catalogue).withColumn("row_ord", F.col("row_ord"))


query("j9_join_client_code", """SELECT count(*) AS n, i.client, i.client_code, t.product_code AS index_code, CAST(t.price AS DOUBLE) AS table_price, 1 AS repeats FROM (SELECT DISTINCT p_type AS client, items.client_code, items.description FROM (SELECT * FROM {items}) AS items JOIN {part} ON part_ord = p_partkey WHERE items.client_code IS NOT NULL) i
  JOIN (SELECT * FROM {price_table}) t ON t.client = i.client AND t.client_code = i.client_code WHERE t.validity = '2 SEM - 2026' AND '0' || t.product_code IN (SELECT product_code FROM {catalogue}) GROUP BY ALL""")(
    lambda s: X.join_client_code(coded_items(s), indexed(s)).join(coded_items(s).select("item_key", "client", "client_code"), "item_key").groupBy("client", "client_code", "index_code", F.col("table_price").cast("double").alias("table_price"), F.col("repeats").cast("int").alias("repeats")).agg(F.count("*").alias("n")))
query("j10_join_product_code", """SELECT count(*) AS n, count(DISTINCT index_code) AS codes FROM (SELECT DISTINCT p_type AS client, CAST(p_partkey AS VARCHAR) AS index_code FROM (SELECT items.part_ord FROM {items}) JOIN {part} ON part_ord = p_partkey WHERE p_size > 5)""")(
    lambda s: X.join_product_code(s.items.select(F.col("part_ord").cast("string").alias("client_code")).distinct().join(s.part.select(F.col("p_partkey").cast("string").alias("client_code"), F.col("p_type").alias("client"), F.col("p_name").alias("description")), "client_code")
                                  .withColumn("item_key", F.col("client_code")), indexed(s)).agg(F.count("*").alias("n"), F.countDistinct("index_code").alias("codes")))


def compared(s):
    """Coded lines, lines whose code the table lacks, lines of other wordings and of the catalogue rules."""
    coded = coded_items(s).withColumn("unit", F.lit("M"))
    plain = priced_items(s).filter("pmod(hash(description), 4) = 0").withColumn("client_code", F.lit("")).withColumn("unit", F.lit("UN"))
    odd = s.sql("SELECT DISTINCT p_type AS client, '' AS client_code, 'BR' AS unit, CASE p_size % 5 WHEN 0 THEN 'PLUG PVC ROSC 3/4' WHEN 1 THEN 'JOELHO PVC SOLDAVEL 25 X 90' WHEN 2 THEN 'ANEL BORRACHA 50' WHEN 3 THEN 'Parafuso sextavado' ELSE 'TUBO PVC SOLDAVEL GALVANIZADO 50MM' END AS description FROM {part}") \
        .withColumn("item_key", F.md5(F.concat_ws("|", "client", "description")))
    columns = ["item_key", "client", "client_code", "description", "unit"]
    rows = coded.select(*columns).unionByName(plain.select(*columns)).unionByName(odd.select(*columns))
    return X.compare_to_table(rows, indexed(s).join(s.price_table.groupBy("client", F.col("product_code").alias("index_code")).agg(F.max("unit").alias("unit")), ["client", "index_code"], "left"), table_side(s), L.candidate_side(featured(s)))


query("m14_compare_to_table")(compared)
