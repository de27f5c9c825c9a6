"""Queries over whole documents: headers (E18), tables and catalogue pages (E21, E23, W14), waterfalls."""
from pyspark.sql import functions as F

from ..functions import header_rules as H
from ..functions import text as T
from ..functions.rules import SUPPLIER
from ..operators import catalogue as C
from ..operators import documents as D
from ..operators import extraction as X
from ..operators import headers as E
from ..operators import layouts as L
from ..operators import review as V
from .registry import query
from .sqlkit import q

# ---- headers ------------------------------------------------------------------------------------------------------
# every order as one document; some say less than others, so confidence differs

_TAX = "'10.' || lpad(CAST(CAST(floor(c_custkey / 1000) AS BIGINT) AS STRING), 3, '0') || '.' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '/0001-99'"
_MAIL = "CASE WHEN o_custkey % 2 = 0 THEN 'compras' || CAST(o_custkey AS STRING) || '@obra.example' ELSE 'sem correio' END"
_SITE = "CASE WHEN o_orderkey %% 7 <> 0 THEN '%s' ELSE 'nada' END"
_HAS_TAX = "CASE WHEN o_orderkey %% 3 <> 0 THEN %s ELSE 'sem cadastro' END"
_O, _N = "CAST(o_orderkey AS STRING)", "CAST(c_custkey AS STRING)"
FAMILY_LINES = {
    0: ["'UAU! Software ' || c_mktsegment", f"'ORDEM DE COMPRA: ' || {_O}", "'DATA:'", "'05/03/2026 e 06/03/2026'", f"'EMPRESA: CONSTRUTORA ' || {_N}", _HAS_TAX % ("'CNPJ: ' || " + _TAX), _MAIL,
        _SITE % "OBRA: 12 - Residencial Norte", "'ENTREGA: Rua das Palmas 10, Goiânia - GO'", "'TEL: (61) 3333-1234'"],
    1: ["'Item Nº Produto NCM Quantidade'", f"'Nº Pedido de Compra: ' || {_O}", "'LOCAL 05.03.2026 /00:00:00 FOLHA'", "'MRV PRIME INCORPORACOES'", _HAS_TAX % "'CNPJ: ' || CAST(10000000 + c_custkey AS STRING) || '000199'",
        "'TOTAL GERAL: 1.234,50'", _SITE % "BERMUDA EMP 01", "CASE WHEN o_custkey % 2 = 0 THEN '75 dias ,com Pgto' ELSE 'a combinar' END", "'LOCAL DE ENTREGA:'", "'Rua Um 20 USUARIO CRIACAO: X'",
        "'Contato: LUCAS / 61 99999 0000'"],
    2: ["'Processo Nº: 55 ' || c_mktsegment", f"'OC Nº: ' || {_O}", "'Emissão: 05/03/2026'", "'DADOS DO FORNECEDOR E-Mail : vendas@x.example'", "'Celular : (61) 99999 1234'", "'DADOS PARA FATURAMENTO'",
        f"'Razão Social : INC BRASAL ' || {_N}", "'Endereço : Rua 5 Bairro'", _HAS_TAX % ("'CNPJ : ' || " + _TAX + " || ' I.E. : ISENTO'"), "'Município : Goiânia - GO CEP : 74.000-123'",
        "CASE WHEN o_custkey % 2 = 0 THEN 'E-Mail : fat' || CAST(o_custkey AS STRING) || '@x.example' ELSE 'x' END", "'DADOS PARA COBRANÇA Razão Social : OUTRA'", _SITE % "Centro de Custo: 418 - Obra Sul"],
    3: ["'DADOS DA ORDEM DE COMPRA'", "'RESPONSAVEL PELA COMPRA'", f"'ORDEM DE COMPRA ' || {_O}", "'Data: 05/03/2026'", "'Nome: Outra Empresa'", "'DADOS DO FATURAMENTO'", f"'Nome: Incorporadora ' || {_N}",
        _HAS_TAX % "'CNPJ: ' || CAST(10000000 + c_custkey AS STRING) || '000199'", "'Endereço: Rua das Flores 10'", "'Brasilia, DF - 70000-123'", _SITE % "OBRA/CENTRO DE CUSTO: 7 - Torre Norte CNO 1",
        "CASE WHEN o_custkey % 2 = 0 THEN 'Email: comprador@y.example' ELSE 'x' END"],
    4: ["'Sienge ' || c_mktsegment"],
}
_ORDERS = "(SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment FROM {orders} JOIN {customer} ON o_custkey = c_custkey)"
_ARRAYS = "CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN array({', '.join(lines)})" for k, lines in FAMILY_LINES.items()) + " END"
HEADER_LINES = f"SELECT doc_id, 1 AS page, pos + 1 AS line_no, text FROM (SELECT CAST(o_orderkey AS STRING) AS doc_id, {_ARRAYS} AS a FROM {_ORDERS}) LATERAL VIEW posexplode(a) v AS pos, text"
_HEADER_LINES_SQL = f"SELECT doc_id, 1 AS page, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS text FROM (SELECT CAST(o_orderkey AS STRING) AS doc_id, {_ARRAYS.replace('array(', 'list_value(')} AS a FROM {_ORDERS})"
_CELL = [("'Pedido'", _O, "'Data do pedido'", "'05/03/2026'"), ("'Nome'", f"'CONSTRUTORA ' || {_N}", "''", "''"), ("'CNPJ'", _HAS_TAX % _TAX, "'Total do Pedido'", "'R$ 1234,50'"),
         ("'E-mail'", "CASE WHEN o_custkey % 2 = 0 THEN 'financeiro@z.example' ELSE '' END", "''", "''"), ("'Obra'", "CASE WHEN o_orderkey % 7 <> 0 THEN '12 - Torre' ELSE '' END", "''", "''"),
         ("'Nome'", f"'SPE ' || {_N}", "'Contato'", "CASE WHEN o_custkey % 3 = 0 THEN 'Ana' ELSE 'Rui' END")]
_FLAT = ", ".join(x for row in _CELL for x in row)
_WHERE = "doc_id, 1 AS page, 0 AS table_no, CAST(floor(pos / 4) AS INTEGER) AS row_no, CAST(pos % 4 AS INTEGER) AS col_no, text"
HEADER_CELLS = f"SELECT {_WHERE} FROM (SELECT CAST(o_orderkey AS STRING) AS doc_id, array({_FLAT}) AS a FROM {_ORDERS} WHERE o_orderkey % 5 = 4) LATERAL VIEW posexplode(a) v AS pos, text"
_HEADER_CELLS_SQL = f"SELECT {_WHERE} FROM (SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS text FROM (SELECT CAST(o_orderkey AS STRING) AS doc_id, list_value({_FLAT}) AS a FROM {_ORDERS} WHERE o_orderkey % 5 = 4))"


def _rx(x, pattern, group):
    pattern = pattern.replace("(?iu)", "(?i)").replace("(?mu)", "(?m)").replace("\\S", "[^\\s]")
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}), '')"


def _field(family, field):
    """The whole document's text searched rule by rule."""
    blocks = {name: f"regexp_extract(txt, {q('(?is)' + a + '(.*?)' + (b or '$'))}, 1)" for name, a, b in H.SECTIONS.get(family, [])}
    found = [_rx(blocks.get(section, "txt"), pattern, group) for f, pattern, group, section in H.LINE_RULES[family] if f == field]
    return f"coalesce({', '.join(found)}, '')" if found else "''"


def _sql(x, pattern, repl=""):
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def _squash(x):
    return f"trim({_sql(x, chr(92) + 's+', ' ')})"


def _site_name(x):
    return f"CASE WHEN regexp_matches({x}, '^\\d+\\s*[-–]\\s*.+$') THEN trim(regexp_extract({x}, '^\\d+\\s*[-–]\\s*(.+)$', 1)) ELSE {x} END"


_NAME = {"UAU": _squash(_field("UAU", "name")), "MRV": f"trim({_field('MRV', 'name')})", "BRASAL": _sql(_squash(_field("BRASAL", "name")), r"(?i)\s*Bairro\s*$"), "PAVINI": _squash(_field("PAVINI", "name"))}
_TAXES = {"UAU": _sql(_field("UAU", "tax_id"), r"\D"), "MRV": _field("MRV", "tax_id"), "BRASAL": _sql(_sql(_field("BRASAL", "tax_id"), r"(?i)\s*I\.?E\..*$"), r"\D"), "PAVINI": _field("PAVINI", "tax_id")}
_SITES = {"UAU": _site_name(_squash(_field("UAU", "site"))), "MRV": _squash(_field("MRV", "site")), "BRASAL": _squash(_field("BRASAL", "site")), "PAVINI": _site_name(_squash(_field("PAVINI", "site")))}
_DATES = {f: _field(f, "date") for f in H.LINE_RULES} | {"MRV": f"replace({_field('MRV', 'date')}, '.', '/')"}
_CONTACTS = {"UAU": f"CAST({_field('UAU', 'email')} <> '' AS INTEGER)", "MRV": f"1 + CAST({_field('MRV', 'person')} <> '' AS INTEGER)",
             "BRASAL": " + ".join(f"CAST({_field('BRASAL', f)} <> '' AS INTEGER)" for f in ("email", "buyer_email", "supplier_email")),
             "PAVINI": " + ".join(f"CAST({_field('PAVINI', f)} <> '' AS INTEGER)" for f in ("email", "office_email", "seller"))}


def _evidence(family):
    said = {"MRV": {"terms": "1"}}.get(family, {})
    return "round_even((" + " + ".join(said.get(f, f"CAST({_SITES[family] if f == 'site' else _field(family, f)} <> '' AS INTEGER)") for f in H.EVIDENCE[family]) + f") / {len(H.EVIDENCE[family])}.0::DOUBLE, 2)"


_BY_FAMILY = "\nUNION ALL\n".join(
    f"SELECT doc_id, '{f}' AS format, {_NAME[f]} AS name, {_TAXES[f]} AS tax_id, {_SITES[f]} AS site, {_field(f, 'number')} AS number, {_DATES[f]} AS date, {_CONTACTS[f]} AS contacts, {_evidence(f)} AS confidence FROM t WHERE k = {k}"
    for k, f in enumerate(("UAU", "MRV", "BRASAL", "PAVINI")))
E18_SQL = f"""
WITH l AS ({_HEADER_LINES_SQL}), t AS (SELECT doc_id, CAST(doc_id AS BIGINT) % 5 AS k, string_agg(text, chr(10) ORDER BY page, line_no) AS txt FROM l GROUP BY doc_id),
c AS ({_HEADER_CELLS_SQL}), p AS (SELECT doc_id, a.row_no, lower(trim(a.text)) AS label, trim(b.text) AS value FROM c a JOIN c b USING (doc_id, row_no) WHERE b.col_no = a.col_no + 1 AND a.col_no % 2 = 0 AND trim(a.text) <> '' AND trim(b.text) <> ''),
i AS (SELECT doc_id, label, arg_max(value, row_no) AS value FROM p GROUP BY ALL), w AS (SELECT doc_id, map_from_entries(list((label, value))) AS m FROM i GROUP BY doc_id)
SELECT *, confidence < 0.6 AS review FROM (
{_BY_FAMILY}
UNION ALL
SELECT doc_id, 'SIENGE', coalesce(m['nome'], ''), {_sql("coalesce(m['cnpj'], '')", chr(92) + 'D')}, {_site_name("coalesce(m['obra'], '')")}, coalesce(m['pedido'], ''), coalesce(m['data do pedido'], ''),
       CAST(m['e-mail'] IS NOT NULL AS INTEGER) + CAST(m['contato'] IS NOT NULL AND m['contato'] <> 'Rui' AS INTEGER),
       round_even((CAST(m['pedido'] IS NOT NULL AS INTEGER) + CAST(m['data do pedido'] IS NOT NULL AS INTEGER) + CAST(m['nome'] IS NOT NULL AS INTEGER) + CAST(m['cnpj'] IS NOT NULL AS INTEGER)
                   + CAST(m['e-mail'] IS NOT NULL AS INTEGER) + CAST(m['obra'] IS NOT NULL AS INTEGER)) / 8.0::DOUBLE, 2) FROM w)
"""


def header_documents(s):
    return E.extract_headers(s.sql(HEADER_LINES), s.sql(HEADER_CELLS), own_people=["Rui"])


def _flat(h):
    return h.select("doc_id", "format", "company.name", "company.tax_id", F.col("site.name").alias("site"), "document.number", "document.date", F.size("contacts").alias("contacts"), "confidence", "review")


query("e18_extract_headers", E18_SQL)(lambda s: _flat(header_documents(s)))
query("e18_register_headers", f"""SELECT h.doc_id, coalesce(r.id, n.id) AS company_id, CASE WHEN h.confidence < 0.60 THEN 'revisao' ELSE 'processado' END AS status FROM ({E18_SQL}) h
  LEFT JOIN (SELECT substr(tax_id, 1, 8) AS root, min(id) AS id FROM {{companies}} WHERE length(tax_id) >= 8 GROUP BY 1) r ON length(h.tax_id) >= 8 AND substr(h.tax_id, 1, 8) = r.root
  LEFT JOIN (SELECT upper(replace(replace(replace(name, ' LTDA', ''), ' S.A.', ''), ' spe', '')) AS key, min(id) AS id FROM {{companies}} GROUP BY 1) n ON upper(h.name) = n.key WHERE coalesce(r.id, n.id) IS NOT NULL""")(
    lambda s: (lambda known: V.register_documents(E.register_rows(header_documents(s)), known).join(known.select(F.col("id").alias("company_id")), "company_id", "left_semi")
               .select(F.col("header_id").alias("doc_id"), "company_id", "status"))(s.companies))

# ---- item tables --------------------------------------------------------------------------------------------------
# three items a page; the header stands in row 1 of the first page only, and every ninth quantity falls behind a page break

TABLE_CELLS = """
SELECT CAST(o AS STRING) AS doc_id, CAST((n - 1) / 3 AS INTEGER) + 1 AS page, 0 AS table_no, CAST(n * 3 AS INTEGER) AS row_no, c AS col_no,
       CASE c WHEN 0 THEN CAST(n AS STRING) WHEN 1 THEN CASE WHEN q % 9 = 1 THEN '' WHEN q % 9 = 2 THEN '' ELSE 'TUBO ' || CAST(pk AS STRING) END WHEN 2 THEN CASE WHEN q % 9 = 2 THEN 'LUVA ' || CAST(pk AS STRING) ELSE '' END
              WHEN 3 THEN 'UN' WHEN 4 THEN CAST(q AS STRING) || ',00' WHEN 5 THEN '' WHEN 6 THEN price ELSE total END AS text
FROM (SELECT o, n, q, pk, price, total, floor((n - 1) / 3) AS f FROM {order_numbers}) CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7)
""".replace("CAST((n - 1) / 3 AS INTEGER) + 1", "CAST(f AS INTEGER) + 1")
TABLE_CELLS += "".join(f"UNION ALL SELECT CAST(o_orderkey AS STRING), 1, 0, {r}, {c}, '{t}' FROM {{orders}}\n" for r, row in enumerate([["Pedido", "de", "compra", "", "", "", "", ""], ["Item", "Descrição", "", "Un.", "Qtde", "", "Preço Unit.", "Total"]]) for c, t in enumerate(row))
TABLE_CELLS += """UNION ALL SELECT CAST(o AS STRING), CAST(floor((n - 1) / 3) AS INTEGER) + 1, 0, CAST(n * 3 - 1 AS INTEGER), c, CASE c WHEN 0 THEN CAST(n AS STRING) ELSE 'JOELHO ' || CAST(pk AS STRING) END
FROM {order_numbers} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1) WHERE q % 9 = 1 AND q > 5
UNION ALL SELECT CAST(o AS STRING), CAST(floor((n - 1) / 3) AS INTEGER) + 1, 0, CAST(n * 3 + 1 AS INTEGER), 1, CASE WHEN q > 30 THEN '(NBR 5688)' ELSE '5 notas' END FROM {order_numbers} WHERE q % 9 = 1 AND q > 5
UNION ALL SELECT DISTINCT CAST(o AS STRING), CAST(floor((n - 1) / 3) AS INTEGER) + 1, 0, 9999, 1, 'Continua' FROM {order_numbers}
"""
query("e23_lines_from_cells", """
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS line_no, CAST(n AS VARCHAR) || ' ' || d || ' UN ' || CAST(q AS VARCHAR) || ',00 ' || price || ' ' || total AS text FROM (
  SELECT CAST(o AS VARCHAR) AS doc_id, CAST(floor((n - 1) / 3) AS INTEGER) + 1 AS page, n, q, price, total,
         CASE q % 9 WHEN 1 THEN CASE WHEN q > 30 THEN 'JOELHO ' || CAST(pk AS VARCHAR) || ' (NBR 5688)' WHEN q > 5 THEN 'JOELHO ' || CAST(pk AS VARCHAR) ELSE 'ITEM ' || CAST(n AS VARCHAR) || ' SEM DESCRICAO - REVISAR MANUALMENTE' END
                    WHEN 2 THEN 'LUVA ' || CAST(pk AS VARCHAR) ELSE 'TUBO ' || CAST(pk AS VARCHAR) END AS d FROM {order_numbers})""")(
    lambda s: D.lines_from_cells(s.sql(TABLE_CELLS)).select("doc_id", "page", "line_no", "text"))
query("e23_items_of_lines", """SELECT CAST(o AS VARCHAR) AS doc_id, CAST(n AS VARCHAR) AS client_code, qty, CAST(total_value AS DOUBLE) AS total, CASE WHEN q % 9 = 1 AND q <= 5 THEN 'duvidoso' ELSE 'ok' END AS kind FROM {order_numbers}""")(
    lambda s: D.lines_from_cells(s.sql(TABLE_CELLS)).select("doc_id", F.col("idx").alias("client_code"), T.br_number(F.col("qty"), "dot").alias("qty"), T.br_number(F.col("total"), "dot").alias("total"),
                                                            F.when(F.col("text").rlike(X.PAGE_BREAK), "duvidoso").otherwise("ok").alias("kind")))

# ---- catalogue pages: a table of two code lines per product, under a title of one or two lines ------------------------

_PAGE = "SELECT p_brand AS doc_id, CAST(floor(p_partkey / 10) AS INTEGER) AS page, CAST(p_partkey % 10 * 10 AS INTEGER) AS line0, p_partkey, p_size FROM {part}"
CATALOGUE_LINES = "\nUNION ALL\n".join(f"SELECT doc_id, page, line0 + {i} AS line_no, {t} AS text FROM ({_PAGE}) WHERE {w}" for i, (t, w) in enumerate([
    ("'Água Fria'", "p_partkey % 3 = 0"), ("'Tubo Soldável 6 m'", "p_size % 4 <> 0"), ("'VENDA SOB CONSULTA'", "p_size % 5 = 0"), ("'para tubo tubo PBS'", "p_size % 4 = 1"), ("'nome livro'", "p_size % 8 = 2"),
    ("'CÓD. BITOLA(MM) EMBAL.'", "p_size % 6 <> 0"), ("CAST(1000 + p_partkey % 9000 AS STRING) || ' ' || CAST(20 + p_size AS STRING) || ' x 20 10/100'", "p_size > 0"),
    ("CAST(1000 + p_partkey % 9000 AS STRING) || ' 3/4\" 5/50'", "p_size > 0")]))
_TITLE = "CASE WHEN p_size % 6 = 0 OR p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'TUBO SOLDAVEL 6 M PARA TUBO PBS' ELSE 'TUBO SOLDAVEL 6 M' END"
# the two-line title reads downwards as written; single words that repeat stand once
_CAT = f"SELECT *, {_TITLE} AS title, max(p_partkey % 3 = 0) OVER (PARTITION BY doc_id, page) AS cold FROM ({_PAGE}) WHERE p_size > 0"
query("w14_title_above", f"SELECT doc_id, page, line0 + 6 AS line_no, title FROM ({_CAT}) UNION ALL SELECT doc_id, page, line0 + 7, NULL FROM ({_CAT})")(
    lambda s: D.title_above(s.sql(CATALOGUE_LINES)).select("doc_id", "page", "line_no", "title"))
query("e21_extract_catalogue", f"""SELECT doc_id, page, CASE WHEN cold THEN 'AGUA FRIA' END AS section, title AS family, CAST(1000 + p_partkey % 9000 AS VARCHAR) AS product_code, CAST(20 + p_size AS VARCHAR) || ' x 20' AS gauge, '10/100' AS pack,
  title || ' - ' || CAST(20 + p_size AS VARCHAR) || ' x 20' AS description, 6.0 AS length_m, CAST(20 + p_size AS DOUBLE) AS gauge_mm FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, 1000 + p_partkey % 9000, title, p_size ORDER BY page, line0) AS again FROM ({_CAT}) WHERE title IS NOT NULL) WHERE again = 1""")(
    lambda s: D.extract_catalogue(s.sql(CATALOGUE_LINES), C.enrich_description).select("doc_id", "page", "section", "family", "product_code", "gauge", "pack", "description", "length_m", "gauge_mm"))

# ---- waterfalls ---------------------------------------------------------------------------------------------------
# the kind of an order's document: model table, model text, purchase lines, quotation table, nothing readable

_KIND = "o % 5"
MODEL_CELLS = f"""
SELECT CAST(o AS STRING) AS doc_id, 1 AS page, 0 AS table_no, CAST(n AS INTEGER) AS row_no, c AS col_no,
       CASE {_KIND} WHEN 0 THEN CASE c WHEN 0 THEN CAST(n AS STRING) WHEN 1 THEN 'TUBO PVC ' || CAST(pk AS STRING) WHEN 2 THEN 'PÇ' ELSE CAST(q AS STRING) || ',00' END
            ELSE CASE c WHEN 0 THEN CAST(10000 + pk AS STRING) WHEN 1 THEN 'LUVA ' || CAST(pk AS STRING) WHEN 2 THEN CAST(q AS STRING) || ',00' ELSE 'UND' END END AS text
FROM {{order_numbers}} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) WHERE {_KIND} IN (0, 3)
""" + "".join(f"UNION ALL SELECT CAST(o_orderkey AS STRING), 1, 0, 0, {c}, CASE o_orderkey % 5 WHEN 0 THEN '{a}' ELSE '{b}' END FROM {{orders}} WHERE o_orderkey % 5 IN (0, 3)\n"
             for c, (a, b) in enumerate([(f"COD {SUPPLIER}", "Código"), ("DESCRIÇÃO", "Descrição"), ("UNID", "Quantidade"), ("QTD", "Unid.")]))
MODEL_LINES = f"""
SELECT CAST(o AS STRING) AS doc_id, 1 AS page, CAST(n + 1 AS INTEGER) AS line_no,
       CASE {_KIND} WHEN 1 THEN CAST(n AS STRING) || ' CAP PVC - ' || price || ' UND ' || CAST(q AS STRING) || ' R$ ' || total WHEN 2 THEN CAST(n AS STRING) || ' JOELHO ' || CAST(pk AS STRING) || ' UN ' || CAST(q AS STRING) || ',00 ' || price || ' ' || total
            ELSE 'observação livre' END AS text FROM {{order_numbers}} WHERE {_KIND} IN (1, 2, 4)
UNION ALL SELECT CAST(o_orderkey AS STRING), 1, 1, CASE o_orderkey % 5 WHEN 1 THEN 'COD {SUPPLIER} DESCRICAO QUANTIDADE' WHEN 2 THEN 'ITEM DESCRICAO' ELSE 'carta' END FROM {{orders}} WHERE o_orderkey % 5 IN (1, 2, 4)
"""


def purchase_items(lines, cells):
    return X.structure_items(X.build_blocks(X.classify_lines(lines, X.vote_format(lines)))).filter("status <> 'falhou'").withColumn("line_no", F.col("block")).withColumn("price", F.col("unit_price"))


def unpriced(s):
    return D.extract_unpriced(s.sql(MODEL_LINES), s.sql(MODEL_CELLS), purchase_items, lambda lines, cells: X.extract_quotation(cells).withColumn("line_no", F.col("row_no")))


query("e20_extract_unpriced", f"""SELECT doc_id, family, client_code, description, sum(qty) AS qty, CASE family WHEN 'MODELO_TABELA' THEN true WHEN 'MODELO_TEXTO' THEN true WHEN 'COMPRA' THEN false ELSE true END AS code_trusted FROM (
  SELECT CAST(o AS VARCHAR) AS doc_id, CASE {_KIND} WHEN 0 THEN 'MODELO_TABELA' WHEN 1 THEN 'MODELO_TEXTO' WHEN 2 THEN 'COMPRA' ELSE 'COTACAO' END AS family, CASE {_KIND} WHEN 3 THEN CAST(10000 + pk AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS client_code,
         CASE {_KIND} WHEN 0 THEN 'TUBO PVC ' || CAST(pk AS VARCHAR) WHEN 1 THEN 'CAP PVC' WHEN 2 THEN 'JOELHO ' || CAST(pk AS VARCHAR) ELSE 'LUVA ' || CAST(pk AS VARCHAR) END AS description, qty FROM {{order_numbers}} WHERE {_KIND} < 4) GROUP BY ALL""")(
    lambda s: unpriced(s).groupBy("doc_id", "family", "client_code", "description", "code_trusted").agg(F.sum("qty").alias("qty")))
query("e20_document_summary", f"SELECT CAST(o AS VARCHAR) AS doc_id, CASE {_KIND} WHEN 0 THEN 'MODELO_TABELA' WHEN 1 THEN 'MODELO_TEXTO' WHEN 2 THEN 'COMPRA' ELSE 'COTACAO' END AS family, count(*) AS items, CASE WHEN {_KIND} IN (1, 2) THEN count(*) ELSE 0 END AS with_price, 0 AS without_code FROM {{order_numbers}} WHERE {_KIND} < 4 GROUP BY o")(
    lambda s: D.document_summary(unpriced(s)))

# documents for the generic reader: header tables, bare tables and text lines, by their signature; two learned templates
_SIGN = "CASE o_orderkey % 3 WHEN 0 THEN 'PEDIDO TABELA CABECALHO' WHEN 1 THEN 'MAPA LIVRE COLUNAS' ELSE 'CARTA TEXTO' END || ' LOJA ' || c_mktsegment"
GENERIC_CELLS = """
SELECT CAST(o AS STRING) AS doc_id, 1 AS page, 0 AS table_no, CAST(n AS INTEGER) AS row_no, c AS col_no,
       CASE c WHEN 0 THEN CAST(1000 + pk AS STRING) WHEN 1 THEN 'TUBO PVC ' || CAST(pk AS STRING) WHEN 2 THEN 'UN' ELSE CAST(q AS STRING) || ',00' END AS text
FROM {order_numbers} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) WHERE k < 2
""" + "".join(f"UNION ALL SELECT CAST(o_orderkey AS STRING), 1, 0, 0, {c}, '{t}' FROM {{orders}} WHERE o_orderkey % 3 = 0\n" for c, t in enumerate(["Código", "Descrição", "Unid", "Qtde"]))


def generic(s):
    docs = s.sql(f"SELECT CAST(o_orderkey AS STRING) AS doc_id, {_SIGN} AS signature FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey")
    known = s.sql("SELECT 'A' AS key, 'PEDIDO TABELA CABECALHO LOJA MACHINERY' AS signature, 'TABELA_CABECALHO' AS strategy, CAST(3 AS BIGINT) AS used, CAST(5 AS BIGINT) AS last_items FROM {region} WHERE r_regionkey = 0"
                  " UNION ALL SELECT 'B', 'CARTA TEXTO LOJA BUILDING', 'TABELA_CONTEUDO', CAST(1 AS BIGINT), CAST(2 AS BIGINT) FROM {region} WHERE r_regionkey = 0")
    cells, lines = s.sql(GENERIC_CELLS), s.order_lines.filter("cast(doc_id as long) % 3 = 2")
    of = lambda frame, left: frame.join(left, "doc_id", "left_semi")
    keep = lambda d: d.select("doc_id", "description", "qty")
    return D.extract_generic(docs, known, [("TABELA_CABECALHO", lambda left: keep(X.extract_by_header(of(cells, left)))), ("TABELA_CONTEUDO", lambda left: keep(X.extract_by_content(of(cells, left)))),
                                           ("TEXTO", lambda left: keep(X.extract_by_text(of(lines, left))))])


_HIT = "o_orderkey % 3 = 0"  # four of the five words of template A, so every document of that kind
_GEN = """SELECT CAST(o AS VARCHAR) AS doc_id, CASE k WHEN 0 THEN 'TABELA_CABECALHO' WHEN 1 THEN 'TABELA_CONTEUDO' ELSE 'TEXTO' END AS strategy, k = 0 AS template, count(*) AS items FROM (SELECT o, k, CASE WHEN k = 2 THEN 0 ELSE n END AS u, pk, q FROM {order_numbers}
  GROUP BY o, k, u, pk, q) GROUP BY o, k HAVING k <> 1 OR count(*) >= 3"""
query("e11_extract_generic", _GEN)(lambda s: generic(s)[0].groupBy("doc_id", "strategy", "template").agg(F.count(F.lit(1)).alias("items")))
query("e11_learned_templates", f"""
WITH g AS ({_GEN}), d AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, {_SIGN} AS signature FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey)
SELECT 'A' AS key, 'TABELA_CABECALHO' AS strategy, 3 + count(*) AS used FROM g WHERE template UNION ALL SELECT 'B', 'TABELA_CONTEUDO', 1
UNION ALL SELECT substr(signature, 1, 80), strategy, count(*) FROM g JOIN d USING (doc_id) WHERE NOT template GROUP BY ALL""")(lambda s: generic(s)[1].select("key", "strategy", "used"))

SHEET_CELLS = """
SELECT CAST(o AS STRING) AS doc_id, 1 AS page, 0 AS table_no, CAST(n + o % 25 AS INTEGER) AS row_no, c AS col_no,
       CASE c WHEN 0 THEN CAST(pk AS STRING) || '.0' WHEN 1 THEN CASE WHEN q % 10 = 0 THEN 'nan' ELSE 'TUBO ' || CAST(pk AS STRING) END WHEN 2 THEN CAST(q AS STRING) ELSE 'und.' END AS text
FROM {order_numbers} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)
""" + "".join(f"UNION ALL SELECT CAST(o_orderkey AS STRING), 1, 0, CAST(o_orderkey % 25 AS INTEGER), {c}, '{t}' FROM {{orders}}\n" for c, t in enumerate(["Código", "Descrição", "Quantidade", "Unid."]))
query("s9_items_from_cells", "SELECT CAST(o AS VARCHAR) AS doc_id, CAST(pk AS VARCHAR) AS client_code, 'TUBO ' || CAST(pk AS VARCHAR) AS description, qty, 'UN' AS unit FROM {order_numbers} WHERE o % 25 < 20 AND q % 10 <> 0")(
    lambda s: D.items_from_sheet(s.sql(SHEET_CELLS)).select("doc_id", "client_code", "description", "qty", "unit"))

# ---- layouts ------------------------------------------------------------------------------------------------------

LAYOUT_MARKS = {0: "'Sistema Sienge'", 1: f"'Pedido de compra alternativo {SUPPLIER} spe'", 2: "'Processo 1 Ordem de compra Brasal', 'dados do fornecedor'", 3: "'DADOS DA ORDEM DE COMPRA', 'responsável pela compra'",
                4: "'Pedido de compra processo 9', 'PO 827'", 5: "'UAU! Software'", 6: "'Item Nº 1', 'NCM 39'", 7: "'Sienge: cotação de preços'", 8: "'carta'"}
_MARKS = "CASE o_orderkey % 9 " + " ".join(f"WHEN {k} THEN array({t})" for k, t in LAYOUT_MARKS.items()) + " END"
query("e2_detect_layout", "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE o_orderkey % 9 WHEN 0 THEN 'SIENGE' WHEN 1 THEN 'TERRAL' WHEN 2 THEN 'BRASAL' WHEN 3 THEN 'PAVINI' WHEN 4 THEN 'PAULO_OCTAVIO' WHEN 5 THEN 'UAU' WHEN 6 THEN 'MRV' END AS layout FROM {orders}")(
    lambda s: L.detect_layout(s.sql(f"SELECT CAST(o_orderkey AS STRING) AS doc_id, 1 AS page, pos + 1 AS line_no, text FROM (SELECT o_orderkey, {_MARKS} AS a FROM {{orders}}) LATERAL VIEW posexplode(a) v AS pos, text")))


def _table(s, rows, where, head=(), source="order_numbers"):
    """Cells of one table per order: ``rows`` are expressions over its lines, ``head`` texts of rows before them."""
    body = f"SELECT CAST(o AS STRING) AS doc_id, 1 AS page, 0 AS table_no, CAST(n * 2 + {len(head)} AS INTEGER) AS row_no, pos AS col_no, text FROM {{{source}}} LATERAL VIEW posexplode(array({', '.join(rows)})) v AS pos, text WHERE {where}"
    for i, cells in enumerate(head):
        texts = ", ".join(q(c) for c in cells)
        body += f" UNION ALL SELECT CAST(o_orderkey AS STRING), 1, 0, {i}, pos, text FROM (SELECT o_orderkey, o_orderkey AS o, o_orderkey % 3 AS k FROM {{orders}}) LATERAL VIEW posexplode(array({texts})) v AS pos, text WHERE {where}"
    return s.sql(body)


_FIX = ["'1.' || CAST(100 + pk % 900 AS STRING)", "CAST(q AS STRING) || ',00'", "CASE WHEN q = 7 THEN 'KIT' ELSE 'Un' END", f"'TUBO ' || CAST(pk AS STRING) || 'MM NBR 5.688 {SUPPLIER}/{SUPPLIER}'", "price", "'0'", "'0'", "'0'", "total"]
_FIXED = f"CAST(o AS VARCHAR) AS doc_id, '1' || CAST(100 + pk % 900 AS VARCHAR) AS client_code, 'TUBO ' || CAST(pk AS VARCHAR) || 'MM NBR' AS description"
query("e12_extract_fixed", f"SELECT {_FIXED}, qty, 'UN' AS unit, CAST(total_value AS DOUBLE) AS total FROM {{order_numbers}} WHERE q <> 7")(
    lambda s: L.extract_fixed(_table(s, _FIX, "true")).select("doc_id", "client_code", "description", "qty", "unit", "total"))
query("e24_lines_from_fixed", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS line_no, text FROM (SELECT CAST(o AS VARCHAR) AS doc_id, n, '1' || CAST(100 + pk % 900 AS VARCHAR) || ' Un ' || CAST(q AS VARCHAR) || ',00 TUBO ' || CAST(pk AS VARCHAR) || 'MM NBR ' || price || ' ' || total AS text FROM {{order_numbers}} WHERE q <> 7)")(
    lambda s: L.lines_from_fixed(_table(s, _FIX, "true")).select("doc_id", "line_no", "text"))
query("e12_extract_numbered", "SELECT CAST(o AS VARCHAR) AS doc_id, 'TUBO ' || CAST(pk AS VARCHAR) AS description, qty, CASE WHEN k = 0 THEN 'M' ELSE 'UND' END AS unit, CAST(total_value AS DOUBLE) AS total FROM {order_numbers}")(
    lambda s: L.extract_numbered(_table(s, ["CAST(n AS STRING)", "'TUBO ' || CAST(pk AS STRING)", "CAST(q AS STRING) || ',00' || CASE k WHEN 0 THEN '\nm' WHEN 1 THEN '\nkit' ELSE '' END", "price", "''", "''", "total"], "true", [["N.", "Item", "Qtd."]]))
    .select("doc_id", "description", "qty", "unit", "total"))


def tabular(s):
    items = _table(s, ["CAST(pk AS STRING) || ' - TUBO' ", "CASE WHEN q = 9 THEN '' ELSE CAST(q AS STRING) || ',00' END", "'un'", "price", "CASE WHEN k = 1 THEN '' ELSE total END", "'10/03/2026'"], "true", [["Insumo", "Quantidade", "Unid.", "Preço Unit.", "Total", "Data"]])
    head = s.sql("SELECT CAST(o_orderkey AS STRING) AS doc_id, 1 AS page, -1 AS table_no, CAST(floor(pos / 4) AS INTEGER) AS row_no, CAST(pos % 4 AS INTEGER) AS col_no, text FROM {orders} LATERAL VIEW posexplode(array('Pedido', CAST(o_orderkey AS STRING), 'Data', '01/03/2026', "
                 "'Dados do Faturamento', '', '', '', 'Nome', 'SPE ' || CAST(o_custkey AS STRING), '', '')) v AS pos, text")
    return L.extract_tabular(items.unionByName(head))


query("e8_extract_tabular", "SELECT CAST(o AS VARCHAR) AS doc_id, CAST(pk AS VARCHAR) AS client_code, 'TUBO' AS description, qty, CASE WHEN k = 1 THEN round(qty * CAST(replace(price, ',', '.') AS DOUBLE), 2) ELSE CAST(total_value AS DOUBLE) END AS total, '10/03/2026' AS delivery FROM {order_numbers} WHERE q <> 9")(
    lambda s: tabular(s)[0].select("doc_id", "client_code", "description", "qty", "total", "delivery"))
query("e8_tabular_header", "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(o_orderkey AS VARCHAR) AS number, '01/03/2026' AS date, 'SPE ' || CAST(o_custkey AS VARCHAR) AS client FROM {orders}")(lambda s: tabular(s)[1])


def quotations(s):
    qty = "CASE WHEN q = 9 THEN '' ELSE CAST(q AS STRING) || ',00' END"
    blocks = _table(s, ["CAST(pk AS STRING)", "'TUBO'", qty, "'UND'"], "k = 0", [["Código", "Descrição", "Quantidade", "Unid."]])
    listed = _table(s, ["CASE WHEN n = 2 THEN '' ELSE CAST(n AS STRING) END", "'LUVA ' || CAST(pk AS STRING)", "'PÇ.'", qty], "k = 1", [["Cooperativa do Sul CNPJ 1", "", "", ""], ["Nº", "Descrição", "Unid", "Quant."]])
    taken = _table(s, ["CAST(n AS STRING)", "CAST(pk AS STRING)", "'CAP Deverão ser novos'", "'UND'", qty], "k = 2", [["Item", "Insumo", "Descrição", "Unid", "Quant"]])
    again = taken.filter("row_no = 3").withColumn("page", F.lit(2)).unionByName(taken.filter("row_no = 0").withColumn("page", F.lit(2)))
    return L.extract_quotations(blocks.unionByName(listed).unionByName(taken).unionByName(again), X.extract_quotation)


query("e13_quotation_layouts", "SELECT CAST(o AS VARCHAR) AS doc_id, CASE k WHEN 1 THEN CASE WHEN n = 2 THEN '' ELSE CAST(n AS VARCHAR) END ELSE CAST(pk AS VARCHAR) END AS client_code, CASE k WHEN 0 THEN 'TUBO' WHEN 1 THEN 'LUVA ' || CAST(pk AS VARCHAR) ELSE 'CAP' END AS description, qty, CASE k WHEN 1 THEN 'PC' ELSE 'UN' END AS unit FROM {order_numbers} WHERE q <> 9")(
    lambda s: quotations(s)[0].select("doc_id", "client_code", "description", "qty", "unit"))
query("e13_quotation_report", "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'SIENGE_BLOCOS' WHEN 1 THEN 'LISTA_SIMPLES' ELSE 'UAU_COLETA' END AS layout, count(n) FILTER (q <> 9) AS items, count(n) FILTER (q = 9 AND k > 0) + count(n) FILTER (k = 2 AND q = 9 AND n = 1) AS without_qty FROM {orders} LEFT JOIN {order_numbers} ON o = o_orderkey GROUP BY o_orderkey")(
    lambda s: quotations(s)[1])
query("e14_quotation_client", "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'CONSTRUTORA ' || CAST(o_custkey AS VARCHAR) ELSE 'Engenharia Boa' END AS client FROM {orders} WHERE o_orderkey % 3 < 2")(
    lambda s: L.quotation_client(s.sql("SELECT CAST(o_orderkey AS STRING) AS doc_id, 1 AS page, 0 AS table_no, 2 AS row_no, 1 AS col_no, CASE o_orderkey % 3 WHEN 0 THEN 'CONSTRUTORA ' || CAST(o_custkey AS STRING) || ' CNPJ 1' ELSE 'spe' END AS text FROM {orders}"),
                                 s.sql("SELECT CAST(o_orderkey AS STRING) AS doc_id, 1 AS page, 3 AS line_no, CASE o_orderkey % 3 WHEN 1 THEN 'Engenharia Boa - Rua 3' ELSE 'x' END AS text FROM {orders}")))
