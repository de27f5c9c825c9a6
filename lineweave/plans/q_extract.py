"""Queries over text extraction (E, W11-W13, A19, F11, F17, U10-U15)."""
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import extraction as X
from .registry import query



def lines(s):
    return s.order_lines


def classed(s):
    return X.classify_lines(lines(s), X.vote_format(lines(s)))


def items(s):
    return X.structure_items(X.build_blocks(classed(s)))


_HAS = "(SELECT DISTINCT o FROM {order_numbers})"
query("e25_split_pages", "SELECT doc_id, count(*) AS n, max(line_no) AS last FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM {documents}) WHERE trim(t) <> '') GROUP BY doc_id")(
    lambda s: X.split_pages(s.doc_pages).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("line_no").alias("last")))
query("a19_vote_format", f"SELECT layout, count(*) AS n FROM (SELECT CASE WHEN h.o IS NULL THEN CASE o_orderkey % 3 WHEN 0 THEN 'UAU' WHEN 1 THEN 'MRV' ELSE 'DESCONHECIDO' END WHEN o_orderkey % 3 = 0 THEN 'UAU' WHEN o_orderkey % 3 = 1 THEN 'MRV' ELSE 'DESCONHECIDO' END AS layout FROM {{orders}} LEFT JOIN {_HAS} h ON o_orderkey = h.o) GROUP BY 1")(
    lambda s: X.vote_format(lines(s)).groupBy("layout").agg(F.count("*").alias("n")))
query("e3_classify_lines", """SELECT line_class, count(*) AS n FROM (SELECT CASE k WHEN 2 THEN 'DESCONHECIDA' ELSE 'INICIO_ITEM' END AS line_class FROM {order_numbers} UNION ALL SELECT CASE k WHEN 0 THEN CASE WHEN q > 40 THEN 'BLOCO_ADMINISTRATIVO' ELSE 'DESCRICAO_ITEM' END WHEN 1 THEN 'DESCRICAO_ITEM' ELSE 'DESCONHECIDA' END FROM {order_numbers}
  UNION ALL SELECT CASE o_orderkey % 3 WHEN 0 THEN 'CABECALHO_PAGINA' ELSE 'DESCONHECIDA' END FROM {orders}) GROUP BY 1""")(lambda s: classed(s).groupBy("line_class").agg(F.count("*").alias("n")))
query("w11_sessionise", "SELECT CAST(o AS VARCHAR) AS doc_id, count(*) AS blocks, count(*) FILTER (k = 0 AND q > 40) AS closed FROM {order_numbers} WHERE k < 2 GROUP BY 1")(
    lambda s: X.sessionise(classed(s)).groupBy("doc_id").agg(F.max("block").alias("blocks"), F.count("closes").alias("closed")))
query("e4_build_blocks", "SELECT CAST(o AS VARCHAR) AS doc_id, n AS block, CASE WHEN k = 0 AND q > 40 THEN 1 ELSE 2 END AS lines FROM {order_numbers} WHERE k < 2")(
    lambda s: X.build_blocks(classed(s)).select("doc_id", "block", F.size("lines").alias("lines")))
query("e5_structure_items", """SELECT CAST(o AS VARCHAR) AS doc_id, n AS block, CASE k WHEN 0 THEN CAST(n AS VARCHAR) ELSE CAST(1100000 + pk AS VARCHAR) END AS client_code, CASE k WHEN 0 THEN 'TUBO PVC SOLDAVEL ' || CAST(pk AS VARCHAR) || 'MM' ELSE 'TUBO ' || CAST(pk AS VARCHAR) END AS description, qty,
  CAST(total_value AS DOUBLE) AS total, CASE WHEN k = 0 AND q > 40 THEN 'ok_com_ressalvas' ELSE 'ok' END AS status FROM {order_numbers} WHERE k < 2""")(
    lambda s: items(s).select("doc_id", "block", "client_code", "description", "qty", "total", "status"))
query("e10_extract_by_text", "SELECT CAST(o AS VARCHAR) AS doc_id, 'TUBO SOLDAVEL BRANCO ' || CAST(pk AS VARCHAR) AS description, 'UN' AS unit, qty FROM (SELECT DISTINCT o, pk, qty FROM {order_numbers} WHERE k = 2) UNION ALL SELECT CAST(o AS VARCHAR), 'PVC SOLDAVEL ' || CAST(pk AS VARCHAR) || 'MM', 'UN', qty FROM (SELECT DISTINCT o, pk, qty FROM {order_numbers} WHERE k = 0)")(
    lambda s: X.extract_by_text(lines(s)).select("doc_id", "description", "unit", "qty"))
query("u13_dedup_lines", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM {lineitem})")(
    lambda s: X.dedup_lines(s.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").cast("string").alias("description"), F.col("l_quantity").alias("qty"))).agg(F.count("*").alias("n")))
query("f11_valid_item", "SELECT valid, count(*) AS n FROM (SELECT l_returnflag <> 'R' AND l_tax < 0.08 AND l_quantity > 2 AS valid FROM {lineitem}) GROUP BY 1")(
    lambda s: s.lineitem.select(X.valid_item(F.when(F.col("l_returnflag") == "R", "TE 1").when(F.col("l_tax") >= 0.08, "Valor do frete").otherwise("TUBO PVC"), F.col("l_quantity") - 2).alias("valid")).groupBy("valid").agg(F.count("*").alias("n")))


def strategies(s):
    a = s.lineitem.filter("l_returnflag = 'R' and l_quantity > 25").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("item"))
    b = s.lineitem.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("item"))
    return [("TABELA_CABECALHO", a), ("TABELA_CONTEUDO", b), ("TEXTO", s.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("item")))]


_STRAT = """SELECT doc_id, CASE WHEN a >= 3 THEN 'TABELA_CABECALHO' WHEN b >= 3 THEN 'TABELA_CONTEUDO' WHEN c >= 3 THEN 'TEXTO' WHEN a >= b AND a >= c THEN 'TABELA_CABECALHO' WHEN b >= c THEN 'TABELA_CONTEUDO' ELSE 'TEXTO' END AS strategy,
  CASE WHEN a >= 3 THEN a WHEN b >= 3 THEN b WHEN c >= 3 THEN c ELSE greatest(a, b, c) END AS n FROM (SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS a, count(*) FILTER (l_returnflag <> 'R') AS b, count(*) AS c FROM {lineitem} GROUP BY 1)"""
query("u10_best_strategy", _STRAT)(lambda s: X.best_strategy(strategies(s)).groupBy("doc_id", "strategy").agg(F.count("*").alias("n")))
query("u11_quality_gate", "SELECT l_orderkey AS doc_id, CASE WHEN bool_or(l_tax > 0.06) THEN count(*) ELSE 1 END AS n FROM {lineitem} GROUP BY 1")(
    lambda s: X.quality_gate(s.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_tax") > 0.06, "ok").otherwise("falhou").alias("status")),
                             s.lineitem.select(F.col("l_orderkey").alias("doc_id")).distinct()).groupBy("doc_id").agg(F.count("*").alias("n")))
_SIGNED = "list_distinct(list_filter(string_split(substr(trim(regexp_replace(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss')), '\\d+', '#', 'g'), '[^A-Z# ]+', ' ', 'g'), '\\s+', ' ', 'g')), 1, 400), ' '), lambda w: length(w) >= 4))"
query("u15_match_template", f"""WITH d AS (SELECT doc_id, {_SIGNED} AS w FROM {{documents}}), t AS (SELECT item_id AS template, {_SIGNED} AS w FROM {{benchmark}}),
  s AS (SELECT doc_id, template, len(list_intersect(d.w, t.w)) / len(t.w) AS share FROM d, t WHERE len(t.w) > 0)
  SELECT doc_id, arg_max(template, struct_pack(s := share, t := template)) AS template, max(share) AS share FROM s WHERE share >= 0.7 GROUP BY doc_id""")(lambda s: X.match_template(s.documents.select("doc_id", T.doc_signature(F.col("text")).alias("signature")), s.benchmark.select(F.col("item_id").alias("template"), T.doc_signature(F.col("text")).alias("signature"))))
query("e1_classify_document", """SELECT doc_id, CASE WHEN file_name LIKE '%manual%' THEN 'COTACAO' WHEN k = 0 THEN 'OC' WHEN k = 1 THEN 'COTACAO' WHEN k = 2 THEN 'OC' WHEN k = 3 THEN 'OC' ELSE 'UI' END AS kind FROM (SELECT page_id AS doc_id, url || CASE WHEN page_id % 7 = 0 THEN ' manual' ELSE '' END AS file_name, page_id % 5 AS k FROM {pages})""")(
    lambda s: X.classify_document(
        s.pages.select(F.col("page_id").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("line_no"), t.alias("text")) for i, t in enumerate([
            F.when(F.col("page_id") % 5 == 0, "ORDEM DE COMPRA").when(F.col("page_id") % 5 == 1, "Coleta de").when(F.col("page_id") % 5 == 2, "Pedido de compra, ver cotação nº 7").otherwise("x"),
            F.when(F.col("page_id") % 5 == 1, "Preços").otherwise("y"), F.lit("z" * 120)])])).alias("l")).select("doc_id", "l.*"),
        s.pages.select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 5 == 3, "PEDIDO_12.pdf").otherwise("file.pdf").alias("file_name"), F.when(F.col("page_id") % 7 == 0, "COTACAO").alias("manual"))).select("doc_id", "kind"))
query("f17_gate_quotations", "SELECT rejection, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'documento por classificar' WHEN o_orderstatus = 'O' THEN 'não é cotação' WHEN o_custkey < 100 THEN 'sem texto' END AS rejection FROM {orders}) GROUP BY 1")(
    lambda s: X.gate_quotations(s.orders.select(F.when(F.col("o_orderstatus") == "P", "UI").when(F.col("o_orderstatus") == "O", "OC").otherwise("COTACAO").alias("kind"), F.col("o_custkey").alias("chars"), F.lit("x").alias("layout"))).groupBy("rejection").agg(F.count("*").alias("n")))
query("w12_next_line_code", "SELECT event_id, nullif(CASE WHEN lead(event_type) OVER w = 'view' THEN CAST(1000 + lead(event_id) OVER w % 1000 AS VARCHAR) END, '') AS next_code FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")(
    lambda s: X.next_line_code(s.events.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "view", F.concat((1000 + F.col("event_id") % 1000).cast("string"), F.lit(" x"))).otherwise("abc").alias("text"), "event_id"))
    .select("event_id", "next_code"))
query("w13_carry_header", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS header FROM {events}")(
    lambda s: X.carry_header(s.events.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), F.col("event_id").alias("row_no"), F.col("event_id").cast("string").alias("text"), (F.col("event_type") == "signup").alias("is_header"), "event_id")).select("event_id", "header"))


def cells(s):
    """Every order as a cell table: a header row and one row per line."""
    head = s.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("row_no"), F.array(F.lit("Item"), F.lit("Código"), F.lit("Descrição"), F.lit("Unid"), F.lit("Qtde")).alias("c"))
    body = s.order_numbers.select(F.col("o").alias("doc_id"), F.col("n").cast("int").alias("row_no"), F.array(F.col("n").cast("string"), F.col("pk").cast("string"), F.concat(F.lit("TUBO "), F.col("pk").cast("string")), F.lit("PC"), F.concat(F.col("q").cast("string"), F.lit(",00"))).alias("c"))
    return head.unionByName(body).select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("table_no"), "row_no", F.posexplode("c").alias("col_no", "text"))


query("e8_extract_by_header", "SELECT o AS doc_id, n AS row_no, 'TUBO ' || CAST(pk AS VARCHAR) AS description, qty, 'PC' AS unit FROM {order_numbers}")(lambda s: X.extract_by_header(cells(s)).select("doc_id", "row_no", "description", "qty", "unit"))
_ML = "SELECT CAST(o AS STRING) AS doc_id, 1 AS page, CAST(n AS INTEGER) AS line_no, CAST(1 + n AS STRING) || ' TUBO PVC ' || CAST(pk AS STRING) || 'MM ' || price || ' UND ' || CAST(q AS STRING) || CASE WHEN k = 0 THEN ' R$ ' || total ELSE '' END AS text, pk, qty, k, total_value FROM {order_numbers}"
query("e15_parse_model_line", f"SELECT doc_id, line_no, 'TUBO PVC ' || CAST(pk AS VARCHAR) || 'MM' AS description, qty, 'UN' AS unit, CASE WHEN k = 0 THEN CAST(total_value AS DOUBLE) END AS document_total FROM ({_ML})")(
    lambda s: X.parse_model_line(s.sql(_ML)).select("doc_id", "line_no", "description", "qty", "unit", "document_total"))
_PD = "SELECT CAST(o AS STRING) AS doc_id, 1 AS page, CAST(n AS INTEGER) AS line_no, CAST(n AS STRING) || ' TUBO ' || CAST(pk AS STRING) || ' ' || price || ' ' || CAST(q AS STRING) || CASE WHEN q = 49 THEN ' ' ELSE ' R$ ' END || total AS text FROM {order_numbers} UNION ALL SELECT CAST(o_orderkey AS STRING), 1, 0, 'COD PRODUTO descrição VALOR unit qnd TOTAL' FROM {orders}"
query("e16_extract_priced", "SELECT CAST(o AS VARCHAR) AS doc_id, CAST(n AS VARCHAR) AS code, CAST(qty AS DECIMAL(18,6)) AS qty, CAST(total_value AS DECIMAL(18,2)) AS total FROM (SELECT *, bool_or(q = 49) OVER (PARTITION BY o) AS bad FROM {order_numbers}) WHERE NOT bad")(
    lambda s: X.extract_priced(s.sql(_PD))[0].select("doc_id", "code", "qty", "total"))
_QD = "SELECT CAST(o AS STRING) AS doc_id, 1 AS page, CAST(n AS INTEGER) AS line_no, CAST(1000 + pk AS STRING) || CASE WHEN k = 1 THEN '' ELSE ' ' END || 'TUBO PVC ' || CASE WHEN k = 0 THEN '1 ' ELSE '' END || CAST(q AS STRING) || ' ' || price || ' ' || total AS text, qty, pk, price FROM {order_numbers} UNION ALL SELECT CAST(o_orderkey AS STRING), 1, 0, CASE WHEN o_orderkey % 3 = 0 THEN 'Produto Emb. Qtde Unitário Total' ELSE 'Produto Qtde Unitário Total' END, 0.0, 0, '' FROM {orders}"
query("e17_extract_quote", f"SELECT doc_id, CAST(1000 + pk AS VARCHAR) AS code, 'TUBO PVC' AS description, qty, CAST(replace(price, ',', '.') AS DOUBLE) AS price FROM ({_QD}) WHERE line_no > 0 AND 1000 + pk <= 9999")(
    lambda s: X.extract_quote(s.sql(_QD)).select("doc_id", "code", "description", "qty", "price"))
query("e19_canonical_items", "SELECT l_orderkey, l_linestatus AS order_description, l_quantity AS order_quantity, CASE WHEN l_returnflag = 'N' THEN 'PC' ELSE l_returnflag END AS order_unit_name, '' AS order_code FROM {lineitem}")(
    lambda s: X.canonical_items(s.lineitem.select("l_orderkey", F.col("l_linestatus").alias("description"), F.col("l_quantity").alias("qty"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("unit"))).select("l_orderkey", "order_description", "order_quantity", "order_unit_name", "order_code"))
query("e22_known_layout", "SELECT doc_id, arg_min(format, ordinal) AS format FROM {documents} JOIN (SELECT item_id AS format, upper(text) AS ident, item_id AS ordinal FROM {benchmark}) b ON contains(upper(text), ident) GROUP BY doc_id")(
    lambda s: X.known_layout(s.documents, s.benchmark.select(F.col("item_id").alias("format"), F.col("text").alias("identifier"), F.col("item_id").alias("ordinal"))))

_E6 = f"SELECT CAST(o AS STRING) AS doc_id, 1 AS page, CAST(n * 2 AS INTEGER) AS line_no, CAST(10000 + n AS STRING) || ' ' || CASE WHEN q > 40 THEN '0' ELSE CAST(q AS STRING) || ',00' END || ' UN TUBO ' || CAST(pk AS STRING) || 'MM 12345 ' || price || ' 0,00 0,00 0,00 ' || total AS text, pk, q, n, k FROM {{order_numbers}} UNION ALL SELECT CAST(o AS STRING), 1, CAST(n * 2 + 1 AS INTEGER), CASE WHEN k = 0 THEN '{R.SUPPLIER} CÓD.' || CAST(pk AS STRING) ELSE 'obs' END, 0, 0, 0, 0 FROM {{order_numbers}}"
query("e6_extract_two_line", "SELECT CAST(o AS VARCHAR) AS doc_id, CAST(10000 + n AS VARCHAR) AS client_code, 'TUBO ' || CAST(pk AS VARCHAR) || 'MM' AS description, CASE WHEN k = 0 THEN CAST(pk AS VARCHAR) END AS product_code, CASE WHEN q > 40 THEN round(CAST(total_value AS DOUBLE) / CAST(replace(price, ',', '.') AS DOUBLE), 0) ELSE qty END AS qty FROM {order_numbers}")(
    lambda s: X.extract_two_line(s.sql(_E6)).select("doc_id", "client_code", "description", "product_code", F.round("qty", 0).alias("qty")))


def words(s):
    """Every order line as positioned words: an item row and two description rows."""
    n = s.order_numbers.withColumn("y", F.col("n") * 40.0)
    w = lambda x, dy, t: F.struct(F.lit(float(x)).alias("x0"), (F.col("y") + dy).alias("y0"), t.alias("text"))
    return n.select(F.col("o").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(
        w(10, 0, F.concat(F.lit("00"), F.col("n").cast("string"))), w(100, 0, F.col("pk").cast("string")), w(160, 0, F.concat(F.col("q").cast("string"), F.lit(",00"))), w(210, 0, F.lit("M")), w(430, 0, F.col("price")), w(540, 0, F.col("total")),
        w(230, -1, F.lit("TUBO")), w(260, 15, F.col("pk").cast("string")), w(240, 18, F.lit("=>x")), w(240, 30, F.lit("longe")))).alias("w")).select("doc_id", "page", "w.*")


query("e7_extract_by_position", "SELECT o AS doc_id, CAST(pk AS VARCHAR) AS client_code, 'TUBO ' || CAST(pk AS VARCHAR) AS description, qty, 'M' AS unit, CAST(total_value AS DOUBLE) AS total FROM {order_numbers}")(
    lambda s: X.extract_by_position(words(s)).select("doc_id", "client_code", "description", "qty", "unit", "total"))


def bare_cells(s):
    c = s.order_numbers.select(F.col("o").alias("doc_id"), F.col("n").cast("int").alias("row_no"), F.array((1000 + F.col("pk")).cast("string"), F.concat(F.lit("TUBO PVC "), F.col("pk").cast("string")), F.lit("UN"), F.concat(F.col("q").cast("string"), F.lit(",00")), F.col("price")).alias("c"))
    return c.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("table_no"), "row_no", F.posexplode("c").alias("col_no", "text"))


query("e9_extract_by_content", "SELECT o AS doc_id, n AS row_no, CAST(1000 + pk AS VARCHAR) AS client_code, 'TUBO PVC ' || CAST(pk AS VARCHAR) AS description, qty, 'UN' AS unit FROM {order_numbers} WHERE o IN (SELECT o FROM {order_numbers} GROUP BY o HAVING count(*) >= 3)")(
    lambda s: X.extract_by_content(bare_cells(s)).select("doc_id", "row_no", "client_code", "description", "qty", "unit"))


def quotation_cells(s):
    head = s.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("row_no"), F.array(F.lit("Código"), F.lit("Descrição"), F.lit("Quantidade"), F.lit("Unid.")).alias("c"))
    item = s.order_numbers.select(F.col("o").alias("doc_id"), (F.col("n") * 2).cast("int").alias("row_no"), F.array(F.col("pk").cast("string"), F.lit("TUBO"), F.concat(F.col("q").cast("string"), F.lit(",00")), F.lit("UND")).alias("c"))
    due = s.order_numbers.select(F.col("o").alias("doc_id"), (F.col("n") * 2 + 1).cast("int").alias("row_no"), F.array(F.lit("10/02/2026 - entrega"), F.lit(""), F.lit(""), F.lit("")).alias("c"))
    return head.unionByName(item).unionByName(due).select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("table_no"), "row_no", F.posexplode("c").alias("col_no", "text"))


query("e13_extract_quotation", "SELECT o AS doc_id, CAST(pk AS VARCHAR) AS client_code, qty, 'UN' AS unit, '10/02/2026' AS delivery FROM {order_numbers}")(
    lambda s: X.extract_quotation(quotation_cells(s)).select("doc_id", "client_code", "qty", "unit", "delivery"))
query("e14_quotation_metadata", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN CAST(100 + o_custkey AS VARCHAR) ELSE CAST(10000 + o_custkey AS VARCHAR) END AS number, '01/02/2026' AS date FROM {orders}")(
    lambda s: X.quotation_metadata(
        s.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_no"), F.lit(2).alias("row_no"), F.lit(1).alias("col_no"), (10000 + F.col("o_custkey")).cast("string").alias("text")),
        s.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("line_no"), F.concat(F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("Nº Cotação: "), (100 + F.col("o_custkey")).cast("string"))).otherwise("x"), F.lit(" em 01/02/2026")).alias("text"))))
