"""Domain inputs derived from the given tables.

The given tables hold no product text, so each fragment below re-reads a whole
table as the domain sees it (order lines, catalogue, price table, review queue
and so on).  Every fragment is one SELECT in the dialect Spark SQL and DuckDB
share; ``{name}`` stands for a given table or for another fragment.
"""

NOUN = ("CASE split_part(p_name, ' ', 2) WHEN 'anvil' THEN 'TUBO' WHEN 'bolt' THEN 'JOELHO' "
        "WHEN 'gear' THEN 'TE' WHEN 'gizmo' THEN 'LUVA' WHEN 'plate' THEN 'QUADRO DISTR' "
        "WHEN 'ring' THEN 'BUCHA' WHEN 'rod' THEN 'REGISTRO ESFERA' ELSE 'ADAPTADOR' END")
ADJ = ("CASE split_part(p_name, ' ', 1) WHEN 'blue' THEN 'SOLDAVEL' WHEN 'cold' THEN 'ROSCAVEL' "
       "WHEN 'hot' THEN 'ULTRATERM' WHEN 'large' THEN 'ESGOTO' WHEN 'new' THEN 'ESGOTO SR' "
       "WHEN 'old' THEN 'PPR' WHEN 'red' THEN 'SOLDAVEL CURTO' ELSE 'SOLDAVEL LONGO' END")
DIAM = ("CASE p_size % 10 WHEN 0 THEN 20 WHEN 1 THEN 25 WHEN 2 THEN 32 WHEN 3 THEN 40 WHEN 4 THEN 50 "
        "WHEN 5 THEN 60 WHEN 6 THEN 75 WHEN 7 THEN 85 WHEN 8 THEN 100 ELSE 150 END")
DESC = (f"{NOUN} || CASE WHEN split_part(p_name, ' ', 2) = 'bolt' THEN CASE WHEN p_size > 25 THEN ' 90' ELSE ' 45' END "
        f"WHEN split_part(p_name, ' ', 2) = 'plate' THEN ' ' || CAST(p_size AS STRING) || 'D/12N SEM BARRAMENTO' ELSE '' END "
        f"|| ' PVC ' || {ADJ} || CASE WHEN split_part(p_name, ' ', 2) = 'anvil' THEN ' - 6M - ' ELSE ' ' END "
        f"|| CAST({DIAM} AS STRING) || CASE WHEN p_type IN ('PROMO', 'SMALL') AND split_part(p_name, ' ', 2) IN ('gear', 'ring', 'widget') "
        f"THEN 'X20' ELSE '' END || 'MM MODELO ' || replace(p_brand, 'Brand#', 'K')")

FRAGMENTS = {
    # product catalogue: one row per part, in part order
    "catalogue": f"""
SELECT p_partkey AS row_ord, '0' || CAST(p_partkey AS STRING) AS product_code, {DESC} AS description,
       CASE WHEN split_part(p_name, ' ', 2) = 'anvil' THEN 'BR' ELSE 'PC' END AS sale_unit,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST({DIAM} AS DOUBLE) END AS diameter_mm,
       CAST(NULL AS DOUBLE) AS diameter_final_mm,
       CASE WHEN split_part(p_name, ' ', 2) <> 'anvil' THEN 0.134 WHEN p_size % 11 = 0 THEN NULL
            WHEN p_size % 2 = 0 THEN 6.0 ELSE 3.0 END AS bar_length_m,
       p_type AS family, {ADJ} AS line, p_retailprice AS list_price
FROM {{part}}""",
    # order lines: catalogue wording bent the way order documents bend it
    "items": f"""
SELECT CAST(l_orderkey AS STRING) AS doc_id, l_linenumber AS line_no, l_partkey AS part_ord, l_suppkey AS supp_ord,
       CASE WHEN l_linenumber % 3 = 0 THEN {DESC}
            WHEN l_linenumber % 3 = 1 THEN 'FVM - ' || replace(replace(replace(replace({DESC}, 'JOELHO', 'JOE'),
                 'SOLDAVEL', 'SOLD'), 'ESGOTO', 'ESG.'), 'ADAPTADOR', 'ADAP') || ' - NBR 5648'
            ELSE 'Mod. ' || replace(replace(replace(lower({DESC}), 'soldavel', 'soldável'), 'te pvc', 'tê pvc'), 'mm', ' mm') END AS description,
       CASE l_returnflag || l_linestatus WHEN 'RO' THEN 'M' WHEN 'AO' THEN 'UN' WHEN 'NF' THEN 'BR'
            WHEN 'RF' THEN 'CX' WHEN 'AF' THEN 'Pç' ELSE 'GALAO' END AS unit,
       l_quantity AS qty, CAST(CAST(l_extendedprice / l_quantity + 0.000001 AS DECIMAL(18,4)) AS DECIMAL(18,6)) AS unit_price,
       CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) AS total,
       CASE WHEN l_suppkey % 4 = 0 THEN ' 00' || CAST(l_partkey AS STRING) WHEN l_suppkey % 4 = 1 THEN '' ELSE NULL END AS own_code,
       CASE WHEN l_suppkey % 4 = 2 THEN 'C-' || CAST(l_partkey * 7 + l_suppkey % 3 AS STRING) ELSE NULL END AS client_code,
       CASE l_suppkey % 5 WHEN 0 THEN 'MRV' WHEN 1 THEN 'UAU' WHEN 2 THEN 'GENERICO' WHEN 3 THEN 'SIENGE' ELSE 'DESCONHECIDO' END AS layout,
       CAST(l_suppkey AS STRING) AS supplier_id
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    # client code map with repeated client codes: the last row of a code counts
    "code_map": """
SELECT 'C-' || CAST(p_partkey * 7 + p_size % 2 AS STRING) AS client_code, '0' || CAST(p_partkey AS STRING) AS product_code,
       'UN' AS unit, p_name AS description, 'R$ ' || replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING), '.', ',') AS price_text,
       p_partkey AS row_ord FROM {part}
UNION ALL
SELECT 'C-' || CAST(p_partkey * 7 AS STRING), '0' || CAST(p_partkey + 1 AS STRING), 'PC', p_brand, '#N/D', p_partkey + 1000000000
FROM {part} WHERE p_size > 40""",
    # price tables: six clients, two validities each
    "price_table": f"""
SELECT p_type AS client, '1 SEM - 2026' AS validity, CAST(p_partkey AS STRING) AS product_code,
       'C-' || CAST(p_partkey * 7 AS STRING) AS client_code, {DESC} AS description, 'UN' AS unit,
       CAST(CAST(p_retailprice * 0.90 + 0.0001 AS DECIMAL(18,2)) AS DECIMAL(18,6)) AS price, p_partkey AS row_ord FROM {{part}}
UNION ALL
SELECT p_type, '2 SEM - 2026', CAST(p_partkey AS STRING), 'C-' || CAST(p_partkey * 7 AS STRING), {DESC},
       CASE WHEN p_size % 3 = 0 THEN 'M' ELSE 'UN' END,
       CAST(CAST(p_retailprice * 0.95 + 0.0001 AS DECIMAL(18,2)) AS DECIMAL(18,6)), p_partkey + 1000000000 FROM {{part}} WHERE p_size > 5""",
    # review queue: events of a user are the lines of one document
    "review_queue": """
SELECT event_id AS id, 'DOC' || CAST(user_id AS STRING) || '.pdf' AS document, CAST(event_id % 9 AS STRING) AS item_no,
       'item ' || CAST(event_id % 37 AS STRING) || ' ' || event_type AS description, CAST(event_id % 50 AS STRING) AS suggested_code,
       CASE WHEN value > 100 THEN 0.4 WHEN value > 20 THEN 0.7 ELSE 0.9 END AS score,
       CASE WHEN value > 100 THEN 'SEM_MATCH' ELSE 'MATCH_DESCRICAO' END AS match_type,
       CASE event_type WHEN 'purchase' THEN 'resolvido' WHEN 'error' THEN 'descartado' ELSE 'pendente' END AS status,
       ts AS created_at, CASE WHEN event_type IN ('purchase', 'error') THEN ts + INTERVAL '6' HOUR END AS resolved_at,
       CASE WHEN event_type = 'purchase' THEN CAST(event_id % 50 + 1 AS STRING) END AS correct_code
FROM {events}""",
    # validated history: repeated wording with the product an operator chose
    "history": """
SELECT event_id AS id, CAST(user_id % 40 AS STRING) AS client_id, 'ITEM ' || CAST(event_id % 400 AS STRING) || ' NBR 5648' AS description,
       CAST(event_id % 800 % 3 AS STRING) AS product_code,
       CASE event_type WHEN 'purchase' THEN 'CORRECAO_MANUAL' WHEN 'view' THEN 'MANUAL' ELSE 'AUTOMATICO' END AS final_type, ts AS validated_at
FROM {events}""",
    # lines of text documents
    "doc_pages": "SELECT doc_id, 1 AS page, text FROM {documents}",
    # customers seen as companies of a register
    "companies": """
SELECT c_custkey AS id, c_name || CASE c_custkey % 4 WHEN 0 THEN ' LTDA' WHEN 1 THEN ' S.A.' WHEN 2 THEN ' spe' ELSE '' END AS name,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(10000000 + c_custkey AS STRING) || '000199' END AS tax_id,
       CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS city, '' AS email,
       CAST(c_custkey % 10 AS DOUBLE) / 10 AS confidence FROM {customer}""",
    # headers read from orders: names and tax numbers that should resolve to a company
    "headers": """
SELECT o_orderkey AS header_id, upper(c_name) || CASE o_orderkey % 3 WHEN 0 THEN '  Ltda.' WHEN 1 THEN ' EIRELI' ELSE '' END AS name,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(10000000 + o_custkey AS STRING) || '/0002-70' ELSE '' END AS tax_id,
       'obra ' || CAST(o_custkey % 7 AS STRING) AS site_name, CASE WHEN o_orderkey % 4 = 0 THEN 'S' || CAST(o_custkey % 7 AS STRING) ELSE '' END AS site_code,
       'buyer' || CAST(o_orderkey % 11 AS STRING) || '@mail.example' AS email, o_orderpriority AS city,
       CAST(o_orderkey AS STRING) AS doc_number, 'SYS' || CAST(o_orderkey % 3 AS STRING) AS doc_system,
       CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # priced order lines and the quote that came back for them
    "order_prices": """
SELECT CAST(l_orderkey AS STRING) AS doc_id, '0' || CAST(l_partkey AS STRING) AS product_code, 'ITEM ' || CAST(l_partkey AS STRING) AS description,
       l_quantity AS qty, CAST(CAST(l_extendedprice / l_quantity + 0.00001 AS DECIMAL(18,3)) AS DECIMAL(18,6)) AS price,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS total, ((CAST(l_linenumber AS BIGINT) * 1000000 + l_suppkey) * 1000000 + l_partkey) * 64 + CAST(l_quantity AS INTEGER) AS row_ord FROM {lineitem}""",
    "quote_prices": """
SELECT CAST(l_orderkey AS STRING) AS doc_id, CAST(l_partkey + CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS STRING) AS product_code,
       'QUOTE ' || CAST(l_partkey AS STRING) AS description, l_quantity AS qty,
       CAST(CAST(l_extendedprice / l_quantity * (0.97 + l_discount) + 0.00001 AS DECIMAL(18,3)) AS DECIMAL(18,6)) AS price,
       ((CAST(l_linenumber AS BIGINT) * 1000000 + l_suppkey) * 1000000 + l_partkey) * 64 + CAST(l_quantity AS INTEGER) AS row_ord FROM {lineitem}""",
    # compared rows of a stored process, and the return for it
    "process_rows": """
SELECT CAST(l_orderkey AS STRING) AS process_id, ((CAST(l_linenumber AS BIGINT) * 1000000 + l_suppkey) * 1000000 + l_partkey) * 64 + CAST(l_quantity AS INTEGER) AS row_ord,
       CASE WHEN l_returnflag = 'N' AND l_tax < 0.03 THEN '' ELSE '0' || CAST(l_partkey AS STRING) END AS product_code,
       'TUBO PVC SOLDAVEL ' || CAST(20 + l_partkey % 50 AS STRING) || 'MM LOTE ' || CAST(l_partkey AS STRING) AS description, '' AS table_description,
       l_quantity AS qty, CASE WHEN l_linestatus = 'O' THEN 'BR' ELSE 'UN' END AS unit,
       CAST(l_partkey % 97 + 3 AS DOUBLE) AS table_price, CAST(l_partkey % 97 + 3 AS DOUBLE) * l_quantity AS table_total,
       'C' || CAST(l_suppkey AS STRING) AS client_code, CASE WHEN l_discount > 0.05 THEN 'OK' WHEN l_discount > 0.02 THEN 'REVISAR' ELSE 'SEM' END AS status,
       CASE WHEN l_tax > 0.04 THEN CAST(l_partkey % 90 + 1 AS DOUBLE) END AS document_price FROM {lineitem}""",
    "return_rows": """
SELECT CAST(l_orderkey AS STRING) AS process_id, ((CAST(l_linenumber AS BIGINT) * 1000000 + l_suppkey) * 1000000 + l_partkey) * 64 + CAST(l_quantity AS INTEGER) AS row_ord,
       CASE WHEN l_discount < 0.02 THEN '' ELSE CAST(l_partkey AS STRING) END AS product_code,
       'TUBO SOLDAVEL PVC ' || CAST(20 + l_partkey % 50 AS STRING) || 'MM LOTE ' || CAST(l_partkey AS STRING) AS description,
       l_quantity + CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END AS qty, CAST(l_partkey % 89 + 2 AS DOUBLE) AS price FROM {lineitem}""",
    # the text of order documents in three layouts: header, one line per item, one line below it
    "order_lines": """
SELECT CAST(o AS STRING) AS doc_id, 1 AS page, CAST(n * 2 AS INTEGER) AS line_no, CASE k
         WHEN 0 THEN CAST(n AS STRING) || ' TUBO PVC SOLDAVEL ' || CAST(pk AS STRING) || 'MM UN ' || CAST(q AS STRING) || ',000000 ' || price || ' ' || total
         WHEN 1 THEN '000' || CAST(n AS STRING) || ' ' || CAST(1100000 + pk AS STRING) || ' 3917.40.90 ' || CAST(q AS STRING) || ' UN 0,00% ' || price || ' ' || total
         ELSE CAST(n AS STRING) || '. TUBO SOLDAVEL BRANCO ' || CAST(pk AS STRING) || ' UN ' || CAST(q AS STRING) END AS text
FROM {order_numbers}
UNION ALL
SELECT CAST(o AS STRING), 1, CAST(n * 2 + 1 AS INTEGER), CASE k WHEN 0 THEN CASE WHEN q > 40 THEN 'Total geral' ELSE '00' END
         WHEN 1 THEN 'DESCRIÇÃO DETALHADA DO PRODUTO TUBO ' || CAST(pk AS STRING) ELSE 'observacao livre do pedido' END FROM {order_numbers}
UNION ALL
SELECT CAST(o_orderkey AS STRING), 1, 1, CASE o_orderkey % 3 WHEN 0 THEN 'ITEM DESCRICAO' WHEN 1 THEN 'ITEM NCM QUANTIDADE' ELSE 'Lista' END FROM {orders}""",
    "order_numbers": """
SELECT l_orderkey AS o, l_orderkey % 3 AS k, l_partkey AS pk, CAST(l_quantity AS INTEGER) AS q, l_quantity AS qty,
       replace(CAST(CAST(l_extendedprice / l_quantity + 0.00003 AS DECIMAL(12,2)) AS STRING), '.', ',') AS price,
       replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), '.', ',') AS total, CAST(l_extendedprice AS DECIMAL(12,2)) AS total_value,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) AS n FROM {lineitem}""",
}
