"""Headers, tables, catalogue pages and waterfalls over literal documents."""
from pyspark.sql import functions as F

from lineweave.functions.rules import SUPPLIER
from lineweave.operators import documents as D
from lineweave.operators import headers as E
from lineweave.operators import layouts as L

LINES = "doc_id string, page int, line_no int, text string"
CELLS = "doc_id string, page int, table_no int, row_no int, col_no int, text string"


def lines_of(spark, docs):
    return spark.createDataFrame([(d, 1, i + 1, t) for d, text in docs.items() for i, t in enumerate(text.strip().split("\n"))], LINES)


def cells_of(spark, docs):
    """``docs``: id -> pages -> tables -> rows -> cells."""
    rows = [(d, p + 1, t, r, c, x) for d, pages in docs.items() for p, tables in enumerate(pages) for t, table in enumerate(tables) for r, row in enumerate(table) for c, x in enumerate(row)]
    return spark.createDataFrame(rows, CELLS)


HEADERS = {
    "uau": """UAU! Software
O.C. : 4471 de 2026
DATA:
07/02/2026 e 08/02/2026
EMPRESA: Construtora Vale Verde
CNPJ: 55.461.477/0001-66
FONE: (61) 3333-1234
obra@vale.example
ENDEREÇO: Rua das Palmas 10 - GO
OBRA: 12 - Residencial Norte""",
    "mrv": """Item Nº Produto NCM Quantidade
Nº Pedido de Compra: 4509378566
LOCAL 05.03.2026 /00:00:00 FOLHA
MRV XCV INCORPORACOES
CNPJ: 40183025000273
TOTAL GERAL: 1.234,50
BERMUDA EMP 01
LOCAL DE ENTREGA:
Rua Um 20 USUARIO CRIACAO: X
Contato: LUCAS / 61 99999 0000""",
    "brasal": """Processo Nº: 55
OC Nº: 812
Emissão: 05/03/2026
DADOS DO FORNECEDOR
E-Mail : vendas@x.example
Celular : (61) 99999 1234
DADOS PARA FATURAMENTO
Razão Social : INC 41 BRASAL
Endereço : Rua 5 Bairro
CNPJ : 12.345.678/0001-99 I.E. : ISENTO
Município : Goiânia - GO CEP : 74.000-123
E-Mail : fat@x.example
DADOS PARA COBRANÇA Razão Social : OUTRA
Centro de Custo: 418 - Obra Sul
Carlos Muller da Silva
Total Pedido
9.876,50""",
    "pavini": """DADOS DA ORDEM DE COMPRA RESPONSAVEL PELA COMPRA
ORDEM DE COMPRA 77
Data: 05/03/2026
Cond. pgto.: 28 / 56 Forma pgto.: Boleto
DADOS DO FATURAMENTO
Nome: SPE Torre Norte
CNPJ: 12345678000199
ENDEREÇO ENTREGA:
Endereço: Quadra 10 Lote 3,
Setor Sul
Recebedor: João
OBRA/CENTRO DE CUSTO: 7 - Torre Norte CNO 1
Brasilia, DF - 70000-123
Email: compras@y.example""",
    "none": "uma carta\nsem nada",
}


def test_headers_of_every_family(spark):
    got = {r["doc_id"]: r for r in E.extract_headers(lines_of(spark, HEADERS)).collect()}
    u = got["uau"]
    assert (u.company.name, u.company.tax_id, u.company.phone, u.company.email) == ("Construtora Vale Verde", "55461477000166", "6133331234", "obra@vale.example")
    assert (u.site.code, u.site.name, u.document.number, u.document.date, u.confidence, u.review) == ("12", "Residencial Norte", "4471", "07/02/2026", 1.0, False)
    m = got["mrv"]
    assert (m.document.number, m.document.date, m.document.total, m.document.terms) == ("4509378566", "05/03/2026", 1234.5, "30 dias")
    assert (m.company.name, m.site.name, m.site.delivery_address, m.confidence) == ("MRV XCV INCORPORACOES", "BERMUDA EMP 01", "Rua Um 20", 0.88)
    assert [(c.name, c.phone) for c in m.contacts] == [("", ""), ("LUCAS", "61999990000")]
    b = got["brasal"]
    assert (b.company.name, b.company.tax_id, b.company.address, b.company.city, b.company.state, b.company.postcode) == ("INC 41 BRASAL", "12345678000199", "Rua 5", "Goiânia - Go", "GO", "74000123")
    assert (b.document.total, b.site.name) == (9876.5, "418 - Obra Sul")
    assert [(c.role, c.email, c.name) for c in b.contacts] == [("cobranca", "fat@x.example", ""), ("representante", "vendas@x.example", "")]
    p = got["pavini"]
    assert (p.company.name, p.company.address, p.company.city, p.site.code, p.document.terms) == ("SPE Torre Norte", "Quadra 10 Lote 3, Setor Sul", "Brasilia", "7", "28 / 56")
    n = got["none"]
    assert (n.format, n.confidence, n.review, n.contacts) == ("DESCONHECIDO", 0.0, True, [])


def test_headers_from_cells(spark):
    cells = cells_of(spark, {"s": [[[["Pedido", "901", "Data do pedido", "01/02/2026"], ["Nome", "Antiga"], ["CNPJ", "11.222.333/0001-44"], ["Obra", "5 - Torre"], ["E-mail", "FINANCEIRO@z.example"]], [["Nome", "SPE Nova"], ["Contato", "Ana"]]]]})
    r = E.extract_headers(lines_of(spark, {"s": "Sienge"}), cells, own_people=["ana"]).first()
    assert (r.company.name, r.company.tax_id, r.site.code, r.document.number, r.document.kind) == ("SPE Nova", "11222333000144", "5", "901", "OC")
    assert [(c.role, c.email) for c in r.contacts] == [("financeiro", "financeiro@z.example")] and r.confidence == 0.75


def test_header_rules_search_each_line_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = E.extract_headers(lines_of(spark, HEADERS))._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("EMPREENDIMENTO") == 1 and plan.count("GALPAO") == 1


def test_header_rules_need_what_they_match(spark):
    texts = [t for text in HEADERS.values() for t in text.splitlines()] + ["COT: 5", "a@b.com", "Goiânia - GO CEP 70.000-123", "Contato: ANA / 61", "Brasilia, DF - 70000-123", "Nome: SPE Um Dois"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    rules = [(pattern, group) for mine in E.H.LINE_RULES.values() for _, pattern, group, _ in mine]
    r = d.select(*[F.coalesce(E._found(F.col("t"), p, g), F.lit("")).alias(f"a{i}") for i, (p, g) in enumerate(rules)], *[F.regexp_extract("t", p, g).alias(f"b{i}") for i, (p, g) in enumerate(rules)]).collect()
    for i, rule in enumerate(rules):
        assert [x[f"a{i}"] for x in r] == [x[f"b{i}"] for x in r], rule


def test_family_by_the_first_page_only(spark):
    rows = [("d", 2, 1, "Sienge"), ("d", 1, 1, "OC Nº: 3"), ("d", 1, 2, "Processo Nº: 5"), ("d", None, 1, "Sienge"), ("n", None, 1, "Sienge")]
    got = E.detect_family(spark.createDataFrame(rows, "doc_id string, page int, line_no int, text string")).collect()
    assert {r.doc_id: r.family for r in got} == {"d": "BRASAL", "n": None}


def test_register_takes_headers(spark):
    rows = E.register_rows(E.extract_headers(lines_of(spark, HEADERS))).collect()
    assert {r.header_id: r.email for r in rows}["brasal"] == "fat@x.example" and len(rows) == len(HEADERS)


def test_tables_to_lines_over_page_breaks(spark):
    head = ["Item", "Descrição", "Un.", "Qtde", "", "", "Preço Unit.", "Total"]
    row = lambda i, d, u, n, p, t: [i, d, u, n, "", "", p, t]
    doc = {"d": [[[row("Pedido 1", "", "", "", "", ""), head, row("1", "TUBO 20", "UN", "5,00", "10", "50"), row("2", "LUVA LONGA", "", "", "", "")]],
                 [[row("Item\n2", "Descrição", "PC", "Qtde\n14,000", "8", "9"), row("", "(NBR- 5688)", "", "", "", ""), row("3", "", "UN", "2", "1", "2"), row("3", "", "UN", "4", "1", "4")]],
                 [[row("5", "JOELHO", "UN", "1", "2", "2")]]]}
    got = [(r.page, r.line_no, r.text) for r in D.lines_from_cells(cells_of(spark, doc)).orderBy("line_no").collect()]
    assert got == [(1, 1, "1 TUBO 20 UN 5,00 10 50"), (2, 2, "2 LUVA LONGA (NBR- 5688) PC 14,000 8 9"), (2, 3, "3 ITEM 3 SEM DESCRICAO - REVISAR MANUALMENTE UN 2 1 2"),
                   (2, 4, "3 ITEM 3 SEM DESCRICAO - REVISAR MANUALMENTE UN 4 1 4")]


def test_catalogue_page(spark):
    text = """ÁGUA FRIA
Rótulo da marca
BUCHA DE REDUÇÃO
12
TUBO TUBO LONGA
CÓD. BITOLA(MM) EMBAL.
0367 32 x 20 15/1.125
0368 40 x 20 15/900
Joelho 45° soldável 6 m
CÓD. BITOLA(POL.) EMBAL.
385 3/4" 10/600
0367 32 x 20 15/1.125"""
    rows = D.extract_catalogue(lines_of(spark, {"c": text})).orderBy("line_no").collect()
    assert [(r.product_code, r.family, r.section, r.gauge_mm, r.gauge_inch, r.length_m) for r in rows] == [
        ("0367", "BUCHA DE REDUCAO TUBO LONGA", "AGUA FRIA", 32.0, None, None), ("0385", "JOELHO 45° SOLDAVEL 6 M", "AGUA FRIA", None, "3/4", 6.0)]


def test_model_lines(spark):
    rows = ["7 TUBO PVC 25MM UN 12", "8 LUVA - 4,50 UND 3 R$ 13,50", "9 CAP 1.200 PÇ", "x CAP 3", "10 CAP sem numero", "11 5"]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select(D.model_line(F.col("t")).alias("i"))
    got = [r.i and (r.i.code, r.i.description, r.i.qty, r.i.unit, r.i.price, r.i.total) for r in df.collect()]
    assert got == [("7", "TUBO PVC 25MM", 12.0, "UN", None, None), ("8", "LUVA", 3.0, "UN", 4.5, 13.5), ("9", "CAP", 1200.0, "PC", None, None), None, None, None]


def test_model_text_refuses_whole_documents(spark):
    good, bad = f"COD {SUPPLIER} DESCRICAO QUANTIDADE\n1 TUBO 5\n2 LUVA 3 UN", f"COD {SUPPLIER} DESCRICAO QUANTIDADE\n1 TUBO 5\nnota final"
    late = f"carta\nCOD {SUPPLIER} DESCRICAO QUANTIDADE\n1 TUBO 5"
    items, refused = D.model_text(lines_of(spark, {"g": good, "b": bad, "l": late, "n": "carta"}))
    assert sorted((r.doc_id, r.client_code, r.qty) for r in items.collect()) == [("g", "1", 5.0), ("g", "2", 3.0)]
    assert {r.doc_id: r.reason for r in refused.collect()} == {"b": "página 1, linha 3: item fora do layout", "l": "conteúdo anterior ao cabeçalho"}


def test_pages_that_repeat_the_last_item(spark):
    rows = [("d", 1, 1, "5", "TUBO", 2.0), ("d", 2, 1, "5", "TUBO", 3.0), ("d", 2, 2, "5", "LUVA", 1.0), ("d", 2, 3, "", "LUVA", 1.0), ("d", 2, 4, "", "LUVA", 1.0)]
    got = D.consolidate_pages(spark.createDataFrame(rows, "doc_id string, page int, line_no long, client_code string, description string, qty double")).collect()
    assert sorted((r.client_code, r.description, r.qty) for r in got) == [("", "LUVA", 1.0), ("", "LUVA", 1.0), ("5", "LUVA", 1.0), ("5", "TUBO", 5.0)]


def test_waterfall_stops_at_the_first_family(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    item = lambda d, n: spark.createDataFrame([(x, 1, 1, "1", n, 1.0) for x in d], "doc_id string, page int, line_no int, client_code string, description string, qty double")
    asked = []

    def family(name, reads):
        def read(left):
            asked.append((name, sorted(r.doc_id for r in left.collect())))
            return item(reads, name).join(left, "doc_id", "left_semi")
        return name, read
    got = D.waterfall(docs, [family("one", ["a"]), family("two", ["a", "b"]), family("three", ["b"])]).collect()
    assert sorted((r.doc_id, r.family, r.code_trusted) for r in got) == [("a", "one", False), ("b", "two", False)]
    assert asked == [("one", ["a", "b", "c"]), ("two", ["b", "c"]), ("three", ["c"])]


def test_learned_templates(spark):
    docs = spark.createDataFrame([("a", "PEDIDO TABELA NOVA"), ("b", "CARTA LIVRE"), ("c", "CARTA LIVRE")], "doc_id string, signature string")
    known = spark.createDataFrame([("k", "PEDIDO TABELA", "two", 4, 9), ("z", "OUTRA COISA", "one", 1, 1)], "key string, signature string, strategy string, used long, last_items long")
    rows = {"one": {"a": 5, "b": 2}, "two": {"a": 1, "b": 2, "c": 4}}
    read = lambda n: (n, lambda left: spark.createDataFrame([(d, i) for d, k in rows[n].items() for i in range(k)], "doc_id string, item int").join(left, "doc_id", "left_semi"))
    items, templates = D.extract_generic(docs, known, [read("one"), read("two")])
    assert sorted((r.doc_id, r.strategy, r["count"]) for r in items.groupBy("doc_id", "strategy").count().collect()) == [("a", "two", 1), ("b", "one", 2), ("c", "two", 4)]
    assert {r.key: (r.strategy, r.used, r.last_items) for r in templates.collect()} == {"k": ("two", 5, 1), "z": ("one", 1, 1), "CARTA LIVRE": ("two", 2, 4)}


def test_sheet_header_below_the_first_rows(spark):
    rows = [["Loja", "", "", ""]] * 9 + [["Código", "Descrição", "Qtde", "Un"], ["12.0", "TUBO", "3", "PÇ"], ["nan", "LUVA", "2,5", ""], ["5", "", "1", ""], ["6", "CAP", "x", ""]]
    got = D.items_from_sheet(cells_of(spark, {"s": [[rows]]})).collect()
    assert sorted((r.client_code, r.description, r.qty, r.unit) for r in got) == [("", "LUVA", 2.5, None), ("12", "TUBO", 3.0, "PC")]


def test_collection_counts_repeated_items_once(spark):
    head, rows = ["Item", "Insumo", "Descrição", "Unid", "Quant"], [["1", "77", "CAP Deverão ser novos", "und", "3,00"], ["2", "78", "TUBO", "M", ""], ["x", "79", "LUVA", "un", "1"]]
    items, report = L.extract_quotations(cells_of(spark, {"u": [[[head, *rows]], [[head, rows[0]]]], "none": [[[["a", "b"], ["c", "d"]]]]}), lambda c: c.limit(0).select("doc_id", "page", "table_no", "row_no", F.lit("").alias("client_code"), F.lit("").alias("description"), F.lit(0.0).alias("qty"), F.lit("").alias("unit"), F.lit("").alias("delivery")))
    assert [(r.client_code, r.description, r.qty, r.unit) for r in items.collect()] == [("77", "CAP", 3.0, "UN")]
    assert [(r.doc_id, r.layout, r["items"], r.without_qty) for r in report.collect()] == [("u", "UAU_COLETA", 1, 1)]
