"""Queries over scores and rounding (D), quantities (Q), comparisons (C, J7, J22, A2-A10, S15-S20)."""
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scores as D
from ..functions import text as T
from ..operators import pricing as X
from ..operators import quantity as Qn
from . import sqlkit as S
from .registry import query

# ---- scores ----
PAIRS = "SELECT DISTINCT p_name || ' ' || lower(p_brand) AS a, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' ' || lower(p_type) AS b FROM {part}"


def pair_query(key, fn, sql):
    query(key, f"SELECT a, b, round({sql}, 6) AS score FROM ({PAIRS})")(
        lambda s: s.sql(PAIRS).select("a", "b", F.round(fn(F.col("a"), F.col("b")), 6).alias("score")))


_SA, _SB = S.sort_words("a"), S.sort_words("b")
_SORTED = f"SELECT a, b, {_SA} AS x, {_SB} AS y FROM ({PAIRS})"
pair_query("d1_indel_ratio", D.indel_ratio, S.ratio("a", "b"))
query("d2_token_sort_ratio", f"SELECT a, b, round({S.ratio('x', 'y')}, 6) AS score FROM ({_SORTED})")(
    lambda s: s.sql(PAIRS).select("a", "b", F.round(D.token_sort_ratio(F.col("a"), F.col("b")), 6).alias("score")))
_SET = f"""SELECT a, b, ts, ra, rb, trim(array_to_string(list_concat(ts, ra), ' ')) AS x, trim(array_to_string(list_concat(ts, rb), ' ')) AS y, length(array_to_string(ts, ' ')) AS ls
  FROM (SELECT a, b, list_sort(list_intersect(ta, tb)) AS ts, list_sort(list_filter(ta, lambda w: NOT list_contains(tb, w))) AS ra, list_sort(list_filter(tb, lambda w: NOT list_contains(ta, w))) AS rb
  FROM (SELECT a, b, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM ({PAIRS})))"""
query("d3_token_set_ratio", f"""SELECT a, b, round(CASE WHEN len(ts) > 0 AND (len(ra) = 0 OR len(rb) = 0) THEN 1.0 ELSE greatest({S.ratio('x', 'y')},
   CASE WHEN ls > 0 THEN 2.0 * ls / (ls + length(x)) ELSE 0 END, CASE WHEN ls > 0 THEN 2.0 * ls / (ls + length(y)) ELSE 0 END) END, 6) AS score FROM ({_SET})""")(
    lambda s: s.sql(PAIRS).select("a", "b", F.round(D.token_set_ratio(F.col("a"), F.col("b")), 6).alias("score")))
query("d4_sequence_ratio")(lambda s: s.sql(PAIRS).select("a", "b", D.sequence_ratio(F.col("a"), F.col("b")).alias("score")))
query("d5_text_score", f"""SELECT a, b, round(greatest(0.7 * {S.ratio('x', 'y')} + 0.3 * {S.ratio('u', 'v')}, 0), 6) AS score
   FROM (SELECT a, b, {S.sort_words('u')} AS x, {S.sort_words('v')} AS y, u, v FROM (SELECT a, b, upper(a) AS u, {S.norm_text('b')} AS v FROM ({PAIRS})))""")(
    lambda s: s.sql(PAIRS).select("a", "b", F.round(D.blended_ratio(F.upper("a"), T.norm_text(F.col("b"))), 6).alias("score")))
query("d7_min_score", """SELECT l_linenumber, l_returnflag, l_tax, min(CASE WHEN l_linenumber = 1 AND l_tax > 0.02 THEN 0.35 WHEN l_linenumber < 4 THEN 0.32 WHEN l_returnflag = 'R' AND l_tax > 0.02 THEN 0.40 ELSE 0.45 END) AS v FROM {lineitem} GROUP BY ALL""")(
    lambda s: s.lineitem.select("l_linenumber", "l_returnflag", "l_tax", D.min_score(
        F.col("l_linenumber") == 1, F.when(F.col("l_tax") > 0.02, 2).otherwise(1), F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", "TE"),
        F.when(F.col("l_tax") > 0.02, F.array(F.lit(25))).otherwise(F.array().cast("array<int>"))).alias("v"))
    .groupBy("l_linenumber", "l_returnflag", "l_tax").agg(F.min("v").alias("v")))
query("d8_fallback_score", f"""SELECT a, b, round(0.6 * 0.5 + 0.4 * round(0.65 * {S.ratio('ua', 'ub')} + 0.35 * {S.ratio('x', 'y')}, 4), 4) AS score
   FROM (SELECT a, b, upper(a) AS ua, upper(b) AS ub, {S.sort_words('upper(a)')} AS x, {S.sort_words('upper(b)')} AS y FROM ({PAIRS}))""")(
    lambda s: s.sql(PAIRS).select("a", "b", D.fallback_score(
        D.structure_score(F.lit("TE"), F.lit("TE"), F.lit(True), F.lit(False), F.lit(25.0), F.lit(25.0), F.lit(None).cast("double"), F.lit(3.0)),
        D.fallback_text(F.col("a"), F.col("b"))).alias("score")))
query("d9_vector_bonus", """SELECT p_partkey, round(least(CASE WHEN p_type = 'PROMO' THEN 0.10 ELSE 0 END + CASE WHEN p_size = 25 THEN 0.12 ELSE 0 END
   + CASE WHEN p_size > 20 THEN 0.08 ELSE 0 END, 0.30), 4) AS bonus FROM {part}""")(
    lambda s: s.part.select("p_partkey", D.vector_bonus(F.lit("PROMO"), F.col("p_type"), F.lit(25.0), F.col("p_size").cast("double"),
                                                        F.lit(6.0), F.when(F.col("p_size") > 20, 6.0)).alias("bonus")))
query("d10_token_overlap", f"""SELECT a, b, round(100.0 * len(list_intersect(x, y)) / greatest(len(x), len(y)), 6) AS score FROM (SELECT a, b,
   list_distinct(regexp_extract_all(upper(a), '[A-Z0-9]+')) AS x, list_distinct(regexp_extract_all(upper(b), '[A-Z0-9]+')) AS y FROM ({PAIRS}))""")(
    lambda s: s.sql(PAIRS).select("a", "b", F.round(D.token_overlap(F.col("a"), F.col("b")), 6).alias("score")))

_PAIR_PRICES = "SELECT doc_id, row_ord, price AS o, CAST(price * CAST(0.97 + 0.001 * (row_ord % 90) AS DECIMAL(6,3)) AS DECIMAL(18,6)) AS q, qty, total FROM {order_prices}"
_DISC = "CASE WHEN q <= 0 THEN NULL WHEN q <= o THEN CAST(0 AS DECIMAL(18,5)) ELSE CAST(CAST(((CAST(q * 1000000 AS HUGEINT) - CAST(o * 1000000 AS HUGEINT)) * 10000000 + CAST(q * 1000000 AS HUGEINT) - 1) // CAST(q * 1000000 AS HUGEINT) AS DECIMAL(18,0)) / 100000 AS DECIMAL(18,5)) END"
query("d11_discount", f"SELECT d, count(*) AS n FROM (SELECT {_DISC} AS d FROM ({_PAIR_PRICES})) GROUP BY d")(
    lambda s: s.sql(_PAIR_PRICES).select(D.discount(F.col("q"), F.col("o")).alias("d")).groupBy("d").agg(F.count("*").alias("n")))
_CENTS = "CAST(floor(o * 100) / 100 AS DECIMAL(18,2))"
query("d12_safe_price", f"SELECT doc_id, row_ord, CASE WHEN c >= o THEN {_CENTS} ELSE least(CAST(round(c, 2) AS DECIMAL(18,2)), {_CENTS}) END AS p FROM (SELECT doc_id, row_ord, o, CAST(q - 1 AS DECIMAL(18,6)) AS c FROM ({_PAIR_PRICES}))")(
    lambda s: s.sql(_PAIR_PRICES).select("doc_id", "row_ord", D.safe_price((F.col("q") - 1).cast("decimal(18,6)"), F.col("o")).alias("p")))
query("d13_return_discount", "SELECT l_partkey, max(CASE WHEN l_partkey % 7 <> 0 THEN round((l_partkey % 7 - l_suppkey % 5) / CAST(l_partkey % 7 AS DOUBLE) * 100, 2) END) AS d FROM {lineitem} GROUP BY l_partkey")(
    lambda s: s.lineitem.select("l_partkey", D.return_discount((F.col("l_partkey") % 7).cast("double"), (F.col("l_suppkey") % 5).cast("double")).alias("d"))
    .groupBy("l_partkey").agg(F.max("d").alias("d")))
query("d14_to_multiple", "SELECT l_quantity, l_linenumber, max(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE ceil(l_quantity / l_linenumber) * l_linenumber END) AS m FROM {lineitem} GROUP BY ALL")(
    lambda s: s.lineitem.select("l_quantity", "l_linenumber", D.to_multiple(F.col("l_quantity"), F.nullif("l_linenumber", F.lit(1))).alias("m"))
    .groupBy("l_quantity", "l_linenumber").agg(F.max("m").cast("double").alias("m")))
query("d15_almost_equal", "SELECT l_orderkey, count(*) FILTER (abs(l_quantity * (1 + l_tax / 2) - l_quantity) / l_quantity <= 0.0201) AS n FROM {lineitem} GROUP BY l_orderkey")(
    lambda s: s.lineitem.groupBy("l_orderkey").agg(F.count_if(D.almost_equal(F.col("l_quantity") * (1 + F.col("l_tax") / 2), F.col("l_quantity"), 0.0201)).alias("n")))
query("d16_price_verdict", """SELECT v, count(*) AS n FROM (SELECT CASE WHEN abs(r / 0.9 - 1) <= 0.05 THEN 1 WHEN r / 0.9 < 0.5 OR r / 0.9 > 2 THEN 0 END AS v FROM (SELECT l_quantity / 20.3 AS r FROM {lineitem})) GROUP BY v""")(
    lambda s: s.lineitem.select(D.price_verdict(F.col("l_quantity") / 20.3, F.lit(0.9)).cast("int").alias("v")).groupBy("v").agg(F.count("*").alias("n")))
query("d17_total_check", "SELECT doc_id, row_ord, CAST(round(CAST(qty AS DECIMAL(18,0)) * price, 2) AS DECIMAL(18,2)) AS computed, total - CAST(round(CAST(qty AS DECIMAL(18,0)) * price, 2) AS DECIMAL(18,2)) AS difference FROM {order_prices}")(
    lambda s: s.order_prices.withColumn("t", D.total_check(F.col("qty"), F.col("price"), F.col("total"))).select("doc_id", "row_ord", "t.computed", "t.difference"))

# ---- quantities ----
_QIN = "SELECT i.*, c.bar_length_m, c.sale_unit, i.description LIKE '%TUBO%' AS is_tube FROM {items} JOIN {catalogue} ON items.part_ord = catalogue.row_ord"
_QIN = _QIN.replace("i.*", "items.*").replace("c.bar", "catalogue.bar").replace("c.sale", "catalogue.sale").replace("i.description", "items.description")
_CLS = "CASE unit WHEN 'M' THEN 'METRO' WHEN 'UN' THEN 'UNIDADE' WHEN 'Pç' THEN 'UNIDADE' WHEN 'BR' THEN 'BARRA' WHEN 'CX' THEN 'CAIXA' ELSE 'DESCONHECIDA' END"
_KIND = f"""CASE WHEN NOT is_tube AND {_CLS} = 'DESCONHECIDA' THEN 'ORIGINAL_NAO_TUBO_UNIDADE_DESCONHECIDA' WHEN NOT is_tube THEN 'ORIGINAL_NAO_TUBO_' || {_CLS}
  WHEN {_CLS} = 'UNIDADE' THEN 'BARRA_DIRETA_OC_UN' WHEN {_CLS} = 'BARRA' THEN 'BARRA_DIRETA_OC_BAR' WHEN {_CLS} = 'METRO' AND bar_length_m IS NULL THEN 'ERRO_TUBO_SEM_COMPRIMENTO'
  WHEN {_CLS} = 'METRO' AND bar_length_m < 1 THEN 'TUBO_COMPRIMENTO_NAO_E_BARRA_REVISAR' WHEN {_CLS} = 'METRO' THEN 'CONVERTIDO_METRO_PARA_BARRA_CEIL'
  WHEN {_CLS} = 'CAIXA' THEN 'TUBO_UNIDADE_CAIXA_REVISAR' ELSE 'UNIDADE_OC_NAO_MAPEADA(' || upper(unit) || ')' END"""
QTY = f"SELECT *, CASE WHEN kind = 'CONVERTIDO_METRO_PARA_BARRA_CEIL' THEN ceil(qty / bar_length_m) ELSE qty END AS adj FROM (SELECT *, {_KIND} AS kind FROM ({_QIN}))"


@query("q1_adjust_quantity", f"SELECT kind AS quantity_kind, count(*) AS n, sum(qty) AS qty, sum(adj) AS adjusted, count(*) FILTER (kind LIKE '%REVISAR' OR kind LIKE 'UNIDADE_OC%') AS to_review FROM ({QTY}) GROUP BY kind")
def _q1(s):
    return Qn.adjust_quantity(s.sql(_QIN)).groupBy("quantity_kind").agg(
        F.count("*").alias("n"), F.sum("qty").alias("qty"), F.sum("adjusted_qty").alias("adjusted"), F.count_if("unit_review").alias("to_review"))


query("q2_final_quantity", f"SELECT doc_id, sum(adj) AS total, count(*) FILTER (sale_unit = 'BR') AS bars FROM ({QTY}) GROUP BY doc_id")(
    lambda s: Qn.final_quantity(Qn.adjust_quantity(s.sql(_QIN))).groupBy("doc_id").agg(F.sum("final_qty").alias("total"), F.count_if(F.col("final_unit") == "BR").alias("bars")))
_VIN = """SELECT l_orderkey, l_returnflag <> 'R' AS matched, CASE l_linestatus WHEN 'O' THEN 'match_descricao ' ELSE 'TRADICIONAL' END AS match_type,
  CASE WHEN l_tax = 0 THEN ' ' ELSE CAST(l_partkey AS STRING) END AS product_code, CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity < 3 THEN 0.0 ELSE l_quantity END AS final_qty,
  l_discount - 0.01 AS discount_pct, l_discount < 0.08 AS discount_valid FROM {lineitem}"""
query("q3_validate", f"""SELECT validation_reason, count(*) AS n FROM (SELECT coalesce(nullif(concat_ws(' | ', CASE WHEN NOT matched THEN 'SEM_MATCH' END,
  CASE WHEN match_type = 'TRADICIONAL' THEN 'TIPO_MATCH_NAO_APROVADO:TRADICIONAL' END, CASE WHEN trim(product_code) = '' THEN 'SEM_CODIGO_{R.SUPPLIER}' END,
  CASE WHEN final_qty IS NULL THEN 'SEM_QUANTIDADE_FINAL' WHEN final_qty <= 0 THEN 'QUANTIDADE_FINAL_INVALIDA' END, CASE WHEN discount_pct < 0 THEN 'DESCONTO_NEGATIVO' END,
  CASE WHEN NOT discount_valid THEN 'DESCONTO_INVALIDO' END), ''), 'OK') AS validation_reason FROM ({_VIN})) GROUP BY validation_reason""")(
    lambda s: Qn.validate(s.sql(_VIN)).groupBy("validation_reason").agg(F.count("*").alias("n")))
_EIN = """SELECT CAST(l_orderkey AS STRING) AS doc_id, CASE WHEN l_tax = 0.05 THEN '' ELSE 'x' END AS description, l_quantity - 2 AS qty, l_returnflag AS unit, l_extendedprice / l_quantity AS unit_price,
  l_extendedprice * (1 - 2 * l_tax / (1 + l_quantity)) AS total, 'ok' AS status, 0.85 AS score, l_discount = 0.1 AS interrupted FROM {lineitem}"""
query("q4_validate_extraction", f"""SELECT status, round(sum(score), 4) AS score, count(*) AS n FROM (SELECT status, CASE status WHEN 'ok' THEN greatest(score, 0.92) WHEN 'duvidoso' THEN least(score, 0.55) ELSE least(score, 0.80) END AS score
  FROM (SELECT score, CASE WHEN interrupted THEN 'ok_com_ressalvas' WHEN description <> '' AND qty > 0 AND total >= 0 AND abs(qty * unit_price - total) / abs(total) <= 0.02 THEN 'ok'
  WHEN description <> '' AND qty > 0 THEN 'ok_com_ressalvas' ELSE 'duvidoso' END AS status FROM ({_EIN}))) GROUP BY status""")(
    lambda s: Qn.validate_extraction(s.sql(_EIN)).groupBy("status").agg(F.round(F.sum("score"), 4).alias("score"), F.count("*").alias("n")))
_SIN = """SELECT l_returnflag <> 'R' AS matched, CASE WHEN l_linenumber = 2 THEN 'SUGESTAO_COMPOSICAO' WHEN l_linenumber = 3 THEN 'MATCH_CODIGO_MRV' WHEN l_linenumber = 4 THEN 'MATCH_DESCRICAO_REVISAR' ELSE 'MATCH_DESCRICAO' END AS match_type,
  CASE WHEN l_tax = 0 THEN NULL ELSE '00' || CAST(l_partkey AS STRING) END AS product_code, l_discount > 0.08 AS manual_review, '12 TE PVC + 034 BUCHA' AS composition,
  CASE WHEN l_tax > 0.04 THEN l_extendedprice ELSE 0 END AS unit_price, CASE l_linestatus WHEN 'O' THEN 'un' ELSE 'br' END AS sale_unit FROM {lineitem}"""
query("q5_sheet_status", f"""SELECT sheet_code, sheet_status, price_unconfirmed, sheet_sale_unit, count(*) AS n FROM (SELECT c AS sheet_code,
  CASE WHEN c = '' THEN 'SEM_MATCH' WHEN manual_review OR c LIKE '%+%' OR match_type LIKE '%REVISAR' THEN 'REVISAR' ELSE 'COM_MATCH' END AS sheet_status,
  has AND match_type = 'MATCH_CODIGO_MRV' AND unit_price = 0 AS price_unconfirmed, CASE WHEN has AND sale_unit = 'br' THEN 'BR' ELSE '' END AS sheet_sale_unit
  FROM (SELECT *, CASE WHEN has THEN ltrim(product_code, '0') WHEN match_type = 'SUGESTAO_COMPOSICAO' THEN '12 + 034' ELSE '' END AS c FROM (SELECT *, matched AND product_code IS NOT NULL AS has FROM ({_SIN.replace("'00' || CAST(l_partkey AS STRING)", "'00' || CAST(l_partkey + 1 AS STRING)")})))) GROUP BY ALL""")(
    lambda s: Qn.sheet_status(s.sql(_SIN.replace("'00' || CAST(l_partkey AS STRING)", "'00' || CAST(l_partkey + 1 AS STRING)")))
    .groupBy("sheet_code", "sheet_status", "price_unconfirmed", "sheet_sale_unit").agg(F.count("*").alias("n")))
query("q6_needs_review", "SELECT document, count(*) AS n FROM {review_queue} WHERE score < 0.75 OR match_type = 'SEM_MATCH' GROUP BY document")(
    lambda s: Qn.needs_review(s.review_queue.withColumn("manual_review", F.lit(False))).groupBy("document").agg(F.count("*").alias("n")))
_AL = "SELECT CAST(p_partkey AS STRING) AS alert_code, 'verificar ' || p_type AS alert FROM {part} WHERE p_size = 50"
query("q7_equivalence_alert", f"SELECT doc_id, alert, count(*) AS n FROM {{items}} JOIN ({_AL}) ON ltrim(trim(own_code), '0') = alert_code WHERE trim(own_code) <> '' GROUP BY ALL")(
    lambda s: Qn.equivalence_alert(s.items.withColumn("client_code", F.col("own_code")), s.sql(_AL)).groupBy("doc_id", "alert").agg(F.count("*").alias("n")))
query("q8_unit_warning", """SELECT unit, sale_unit, count(*) AS n, CASE WHEN upper(unit) <> sale_unit AND (unit = 'M' OR sale_unit = 'M') AND (unit IN ('BR', 'UN') OR sale_unit IN ('BR', 'UN'))
  THEN 'unidade difere: documento ' || upper(unit) || ', tabela ' || sale_unit END AS warning FROM {items} JOIN {catalogue} ON items.part_ord = catalogue.row_ord GROUP BY unit, sale_unit""")(
    lambda s: s.items.join(s.catalogue.select("row_ord", "sale_unit"), F.col("part_ord") == F.col("row_ord")).groupBy("unit", "sale_unit", Qn.unit_warning(F.col("unit"), F.col("sale_unit")).alias("warning")).agg(F.count("*").alias("n")))
query("a9_value_counts", "SELECT doc_id, unit, count(*) AS n FROM {items} GROUP BY doc_id, unit")(lambda s: Qn.value_counts(s.items, ["doc_id"], "unit"))
_RIN = f"SELECT doc_id, CASE line_no WHEN 1 THEN 'ok' WHEN 2 THEN 'ok_com_ressalvas' WHEN 3 THEN 'duvidoso' ELSE 'falhou' END AS status, layout <> 'UAU' AS matched, kind AS quantity_kind FROM ({QTY})"
_RINS = "SELECT doc_id, CASE line_no WHEN 1 THEN 'ok' WHEN 2 THEN 'ok_com_ressalvas' WHEN 3 THEN 'duvidoso' ELSE 'falhou' END AS status, layout <> 'UAU' AS matched, unit, qty, is_tube, bar_length_m FROM (" + _QIN + ")"
query("a10_document_report", f"""SELECT doc_id, count(*) AS extracted, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'ok_com_ressalvas') AS with_reservations, count(*) FILTER (status = 'duvidoso') AS doubtful,
  count(*) FILTER (status = 'falhou') AS failed, count(*) FILTER (NOT matched) AS unmatched, count(*) FILTER (contains(quantity_kind, 'ERRO')) AS quantity_errors FROM ({_RIN}) GROUP BY doc_id""")(
    lambda s: Qn.document_report(Qn.adjust_quantity(s.sql(_RINS))))
query("f12_drop_failed", "SELECT doc_id, count(*) FILTER (l_linenumber < 4) AS kept, bool_and(l_linenumber >= 4) AS rejected FROM (SELECT l_orderkey AS doc_id, l_linenumber FROM {lineitem}) GROUP BY doc_id")(
    lambda s: (lambda kept, empty: kept.groupBy("doc_id").agg(F.count("*").alias("kept")).join(empty, "doc_id", "full_outer")
               .select("doc_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.col("reason").isNotNull().alias("rejected")))(
        *Qn.drop_failed(s.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") < 4, "ok").otherwise("falhou").alias("status")))))

# ---- order against quote ----
_LAST = "SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY row_ord DESC) AS rn FROM (SELECT *, CAST(CAST(product_code AS BIGINT) AS VARCHAR) AS code FROM {%s})"
_CMP = f"""SELECT doc_id, code, description, qty, o AS order_price, q AS quote_price, d AS discount, note, status,
   CASE WHEN d IS NOT NULL THEN least(CAST((q6 * (10000000 - CAST(d * 100000 AS HUGEINT)) + 50000000000) // 100000000000 AS DECIMAL(18,0)) / 100, floor(o * 100) / 100) END AS final_price FROM (
   SELECT *, CAST(q * 1000000 AS HUGEINT) AS q6, CASE WHEN has_o AND has_q THEN {_DISC} END AS d, CAST(NULL AS VARCHAR) AS note,
   CASE WHEN NOT has_o THEN 'SEM_OC' WHEN NOT has_q THEN 'SEM_ORC' WHEN q <= o THEN 'ABAIXO' ELSE 'OK' END AS status FROM (
   SELECT doc_id, code, coalesce(a.description, b.description) AS description, CASE WHEN a.code IS NOT NULL THEN a.qty ELSE b.qty END AS qty, a.price AS o, b.price AS q, a.code IS NOT NULL AS has_o, b.code IS NOT NULL AS has_q, a.total
   FROM (SELECT * FROM ({_LAST % 'order_prices'}) WHERE rn = 1) a FULL JOIN (SELECT * FROM ({_LAST % 'quote_prices'}) WHERE rn = 1) b USING (doc_id, code)))"""
_CCOLS = "doc_id, code, description, qty, order_price, quote_price, discount, CAST(final_price AS DECIMAL(18,2)) AS final_price, note, status"
query("c1_compare_order_quote", f"SELECT {_CCOLS} FROM ({_CMP})")(lambda s: X.compare_order_quote(s.order_prices, s.quote_prices))
query("j7_order_quote_join", f"SELECT status, count(*) AS n, sum(order_price) AS order_total, sum(quote_price) AS quote_total FROM ({_CMP}) GROUP BY status")(
    lambda s: X.compare_order_quote(s.order_prices, s.quote_prices).groupBy("status").agg(F.count("*").alias("n"), F.sum("order_price").alias("order_total"), F.sum("quote_price").alias("quote_total")))
_TOT = f"SELECT doc_id, code, total, CAST(round(CAST(qty AS DECIMAL(18,0)) * price, 2) AS DECIMAL(18,2)) AS computed FROM ({_LAST % 'order_prices'}) WHERE rn = 1"
query("c2_compare_priced", f"SELECT {_CCOLS}, t.total AS stated_total, t.computed AS computed_total, t.total - t.computed AS total_difference FROM ({_CMP}) LEFT JOIN ({_TOT}) t USING (doc_id, code)")(
    lambda s: X.compare_priced(s.order_prices, s.quote_prices))
query("a7_priced_stats", f"""SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'ABAIXO') AS abaixo, count(*) FILTER (status = 'SEM_ORC') AS sem_orc, count(*) FILTER (status = 'SEM_OC') AS sem_oc,
  count(*) FILTER (status = 'SEM_PRECO') AS sem_preco, count(*) FILTER (status IN ('OK', 'ABAIXO')) AS to_enter, count(*) FILTER (t.total <> t.computed) AS differences, sum(t.total) AS document_total FROM ({_CMP}) LEFT JOIN ({_TOT}) t USING (doc_id, code) GROUP BY doc_id""")(
    lambda s: X.priced_stats(X.compare_priced(s.order_prices, s.quote_prices)))
query("s15_discount_sheet", f"SELECT doc_id, description, code, qty, printf('%.5f', CAST(discount AS DOUBLE)) AS discount FROM ({_CMP}) WHERE status IN ('OK', 'ABAIXO')")(
    lambda s: X.discount_sheet(X.compare_order_quote(s.order_prices, s.quote_prices)))
query("s20_order_discount_sheet", f"""SELECT doc_id, code, description, qty, order_price, CAST(round(CAST(qty AS DECIMAL(18,0)) * order_price, 2) AS DECIMAL(18,2)) AS order_total, quote_price, printf('%.5f', CAST(discount AS DOUBLE)) AS discount,
  CAST(final_price AS DECIMAL(18,2)) AS final_price, '' AS note FROM ({_CMP}) WHERE status IN ('OK', 'ABAIXO')""")(
    lambda s: X.order_discount_sheet(X.compare_order_quote(s.order_prices, s.quote_prices)))
query("c5_reject_invalid_quote", """SELECT doc_id, count(*) AS n FROM {quote_prices} WHERE doc_id NOT IN (SELECT doc_id FROM {quote_prices} GROUP BY doc_id, product_code HAVING count(*) > 1) GROUP BY doc_id""")(
    lambda s: X.reject_invalid_quote(s.quote_prices)[0].groupBy("doc_id").agg(F.count("*").alias("n")))

# ---- consolidation and returns ----
_PR = "SELECT *, process_id AS doc_id, 'n' AS note FROM {process_rows}"
_PRS = "SELECT process_id AS doc_id, row_ord, product_code, description, qty, unit, table_price, client_code, status, document_price, 'n' AS note FROM {process_rows}"
_CON = """SELECT doc_id, min(row_ord) AS row_ord, arg_min(product_code, row_ord) AS product_code, arg_min(description, row_ord) AS description, arg_min(status, row_ord) AS status, arg_min(table_price, row_ord) AS table_price,
  round(sum(qty), 3) AS qty, count(*) AS lines, arg_max(document_price, row_ord) FILTER (document_price IS NOT NULL) AS document_price,
  round(round(sum(qty), 3) * arg_min(table_price, row_ord), 2) AS total, CASE WHEN count(*) > 1 THEN 'n; ' || CAST(count(*) AS VARCHAR) || ' linhas do documento somadas' ELSE 'n' END AS note
  FROM (SELECT *, CASE WHEN product_code <> '' THEN product_code ELSE 'SEM|' || client_code || '|' || description || '|' || unit END AS k FROM (""" + _PRS + ")) GROUP BY doc_id, k"
query("a2_consolidate_rows", _CON)(lambda s: X.consolidate_rows(s.sql(_PRS)))
query("a5_summary", f"""SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'REVISAR') AS revisar, count(*) FILTER (status = 'SEM') AS sem, 0 AS unpriced,
  count(*) FILTER (document_price IS NOT NULL) AS with_document_price, round(sum(total), 2) AS value FROM ({_CON}) GROUP BY doc_id""")(lambda s: X.summary(X.consolidate_rows(s.sql(_PRS))))
query("s19_comparison_sheet", f"""SELECT doc_id, 0 AS is_total, product_code, description, qty, table_price, total, status FROM ({_CON}) UNION ALL
  SELECT doc_id, 1, '', 'TOTAL (0 sem preço)', NULL, NULL, round(sum(total), 2), '' FROM ({_CON}) GROUP BY doc_id""")(lambda s: X.comparison_sheet(X.consolidate_rows(s.sql(_PRS))))
_RET = """SELECT process_id, min(row_ord) AS row_ord, arg_min(product_code, row_ord) AS product_code, arg_min(description, row_ord) AS description, round(sum(qty), 3) AS qty, arg_min(price, row_ord) AS price, count(*) AS lines
  FROM (SELECT *, CASE WHEN product_code = '' THEN '|' || CAST(row_ord AS VARCHAR) ELSE product_code END AS k FROM {return_rows}) GROUP BY process_id, k"""
query("a3_consolidate_quote", _RET)(lambda s: X.consolidate_quote(s.return_rows))
_LIN = "SELECT user_id AS doc_id, event_type AS code, event_id AS row_ord, CASE WHEN value > 50 THEN 'big' ELSE 'small' END AS description, value AS qty FROM {events}"
query("a4_consolidate_lines", f"""SELECT doc_id, code, min(row_ord) AS row_ord, min(description) AS description, round(sum(qty), 3) AS qty FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id, code ORDER BY row_ord) AS run FROM (
  SELECT *, CASE WHEN lag(description) OVER (PARTITION BY doc_id, code ORDER BY row_ord) IS DISTINCT FROM description THEN 1 ELSE 0 END AS c FROM ({_LIN}))) GROUP BY doc_id, code, run""")(
    lambda s: X.consolidate_lines(s.sql(_LIN)))
_C4 = """SELECT process_id, row_ord, qty, unit, table_price, table_total, qty + CASE WHEN status = 'OK' THEN 0 ELSE 2 END AS r_qty, document_price AS r_price,
  CASE WHEN document_price IS NOT NULL THEN 'via' END AS via, 0.6 AS score FROM {process_rows}"""
query("c4_return_row", """SELECT process_id, row_ord, round(CASE WHEN tube THEN table_price * 6 ELSE table_price END, 4) AS table_price, round(CASE WHEN tube THEN round(qty * table_price * 6, 2) ELSE table_total END, 2) AS table_total,
  round(r_qty * r_price, 2) AS return_total, round((p - r_price) / p * 100, 2) AS discount_pct, CASE WHEN via IS NULL THEN 'SEM' WHEN qty <> r_qty THEN 'REVISAR' ELSE 'OK' END AS status FROM (
  SELECT *, CASE WHEN tube THEN table_price * 6 ELSE table_price END AS p FROM (SELECT *, via IS NOT NULL AND unit = 'BR' AS tube FROM (""" + _C4 + ")))")(
    lambda s: X.return_row(s.sql(_C4)).select("process_id", "row_ord", "table_price", "table_total", "return_total", "discount_pct", "status"))
query("c3_compare_return")(lambda s: X.compare_return(s.process_rows, s.return_rows))
query("a6_return_summary")(lambda s: X.return_summary(X.compare_return(s.process_rows, s.return_rows)))

# ---- plan against what was read ----
_PLAN = "SELECT CAST(l_orderkey AS STRING) AS doc_id, '0' || CAST(l_partkey AS STRING) AS product_code, ' item ' AS description, CASE WHEN l_tax = 0 THEN '' ELSE 'R$ ' || replace(CAST(CAST(l_extendedprice / l_quantity + 0.00003 AS DECIMAL(12,2)) AS STRING), '.', ',') END AS target_price, CASE WHEN l_discount > 0.03 THEN '5,5' END AS discount, CAST(CAST(l_quantity AS INTEGER) AS STRING) AS qty FROM {lineitem}"
query("c6_execution_plan", f"SELECT doc_id, ltrim(product_code, '0') AS product_code, 'item' AS description, try_cast(replace(replace(target_price, 'R$ ', ''), ',', '.') AS DOUBLE) AS target_price, try_cast(replace(discount, ',', '.') AS DOUBLE) AS discount, CAST(qty AS DOUBLE) AS qty FROM ({_PLAN}) WHERE ltrim(product_code, '0') <> ''")(
    lambda s: X.execution_plan(s.sql(_PLAN)).filter("product_code <> '0'"))
_LA = """SELECT l_orderkey, l_linenumber, CAST(l_partkey AS STRING) AS planned, CAST(l_partkey + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS STRING) AS seen, CASE WHEN l_tax > 0.01 THEN 100.0 END AS target_price, CASE WHEN l_tax < 0.08 THEN l_quantity * 4 END AS final, CASE WHEN l_discount > 0.04 THEN 3.0 END AS discount FROM {lineitem}"""
query("c7_line_action", f"""SELECT action, verdict, count(*) AS n FROM (SELECT CASE WHEN seen <> planned THEN 'AVANCAR_PROXIMA_LINHA' WHEN target_price IS NULL THEN 'VALIDAR_MANUALMENTE' WHEN final IS NULL THEN 'RELER_PRECO_FINAL' WHEN final <= target_price + 0.02 THEN 'ITEM_OK_VALIDAR_E_SEGUIR'
  WHEN discount IS NULL THEN 'CALCULAR_DESCONTO_OU_VALIDAR' ELSE 'APLICAR_DESCONTO' END AS action, CASE WHEN seen <> planned THEN 'VALIDAR_MANUALMENTE' WHEN final IS NULL OR target_price IS NULL THEN 'RELER_PRECO_FINAL' WHEN final <= target_price + 0.02 THEN 'SUCESSO_VALIDADO' ELSE 'REAPLICAR_OU_VALIDAR' END AS verdict FROM ({_LA})) GROUP BY ALL""")(
    lambda s: X.post_check(X.line_action(s.sql(_LA))).groupBy("action", "verdict").agg(F.count("*").alias("n")))
_OBS = """SELECT CAST(l_orderkey AS STRING) AS doc_id, l_linenumber * 1000 + l_suppkey AS line_index, CAST(l_partkey AS STRING) AS code, l_returnflag <> 'N' AS code_valid, '1,00' AS last_price, CASE WHEN l_discount > 0.02 THEN CAST(CAST(l_quantity * 40 AS INTEGER) AS STRING) || ',00' ELSE '' END AS final_price,
  l_tax AS code_confidence, l_tax AS last_confidence, l_discount AS final_confidence FROM {lineitem}"""
_PLN = "SELECT CAST(l_orderkey AS STRING) AS doc_id, '0' || CAST(l_partkey AS STRING) AS product_code, max(CASE WHEN l_tax > 0.02 THEN 1000.0 END) AS target_price, max(CASE WHEN l_discount > 0.05 THEN 3.0 END) AS discount FROM {lineitem} GROUP BY 1, 2"
query("j22_plan_actions", f"""WITH o AS (SELECT *, try_cast(replace(regexp_extract(final_price, '[0-9]{{1,3}},[0-9]{{2}}'), ',', '.') AS DOUBLE) AS final, NOT code_valid AS bad FROM ({_OBS})),
  again AS (SELECT doc_id, arg_max(struct_pack(i := line_index, a := CASE WHEN bad THEN 'RELER_CODIGO' ELSE 'RELER_PRECO_FINAL' END), struct_pack(c := CASE WHEN bad THEN code_confidence ELSE final_confidence END, k := -line_index)) AS r FROM o WHERE bad OR final IS NULL GROUP BY doc_id),
  hit AS (SELECT doc_id, p.product_code, arg_min(struct_pack(i := line_index, f := final, a := CASE WHEN final <= target_price + 0.02 THEN 'ITEM_OK_VALIDAR_E_SEGUIR' ELSE 'APLICAR_DESCONTO' END), line_index) AS h
    FROM ({_PLN}) p JOIN o USING (doc_id) WHERE o.code = ltrim(p.product_code, '0') AND NOT bad AND final IS NOT NULL AND target_price IS NOT NULL AND (final <= target_price + 0.02 OR discount IS NOT NULL) GROUP BY doc_id, p.product_code)
  SELECT doc_id, product_code, coalesce(h.a, r.a, 'SCROLL_PROXIMA_PAGINA') AS action, coalesce(h.i, r.i) AS line_index, round(h.f - target_price, 4) AS over_target FROM ({_PLN}) LEFT JOIN hit USING (doc_id, product_code) LEFT JOIN again USING (doc_id) WHERE product_code <> '00'""")(
    lambda s: X.plan_actions(s.sql(_PLN), s.sql(_OBS)).filter("product_code <> '00'").select("doc_id", "product_code", "action", "line_index", "over_target"))
