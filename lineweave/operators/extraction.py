"""Order items from text lines and table cells (E, W11-W13, A19, F11, F17, U10-U15, S9).

Input is text already: ``doc_lines(doc_id, page, line_no, text)`` and
``doc_cells(doc_id, page, table_no, row_no, col_no, text)``.
"""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import SUPPLIER
from .common import contained, first_per_key

# Line patterns of the three purchase layouts.
UNITS = r"(?:RL|UN|UND|M|MT|BR|BAR|PC|PCS|CX|KG|LT?)"
GRID_START = r"(?i)^(\d{3,6})\s+(\d+)\s+(\d{4}\.\d{2}\.\d{2})\s+(\d[\d.,]*)\s+([A-Z]{1,5})\s+(?:(\d[\d.,]*)\s+)??([\d.,]+%?)\s+(\d[\d.,]*)\s+(\d[\d.,]*)$"
GRID_ANY = r"(?i)^\d{1,6}\s+\d+\s+\d{4}\.\d{2}\.\d{2}\s+\d[\d.,]*\s+[A-Z]{1,5}\s+(?:[\d.,]+\s+)?[\d.,%]+\s+[\d.,]+\s+[\d.,]+$"
DASH_START = (r"(?i)^(\d{2,6})\s+-\s+(.+?)\s+(\d[\d.,]*)\s+([a-z]{1,5}\d?)\s+([\d.,]+)\s+[\d.,]+\s+[\d.,]+\s+[\d.,]+\s+[\d.,]+\s+([\d.,]+)\s+\d{2}/\d{2}/\d{4}$")
DASH_ANY = r"(?i)^\d{2,6}\s+-\s+\S.+?\s+\d[\d.,]*\s+[a-z]{1,5}\d?\s+[\d.,]+\s+[\d.,]+.*\d{2}/\d{2}/\d{4}$"
LINE_START = rf"(?i)^(\d{{1,4}})\s+(.+?)\s+({UNITS})\s+([\d.,]+)\s+([\d.,]+)\s+([\d.,]+)$"
BROKEN_START = rf"(?i)^(\d{{1,4}})\s+(.+?)\s+({UNITS})\s+([\d.,]+)$"
PAGE_BREAK = r"(?i)^(\d{1,4})\s+ITEM\s+\d+\s+SEM\s+DESCRICAO[^\d]*([\d.,]+)\s+"
GRID_ADMIN = ["DATA ENTREGA:", "Nº PEDIDO DE COMPRA:", "NO PEDIDO DE COMPRA:", "NOTA FISCAL:", "LOCAL DE ENTREGA:", "CONDIÇÃO DE PAGAMENTO", "USUARIO CRIACAO:", "USUÁRIO CRIAÇÃO:",
              "DADOS DA CONTRATADA", "ENDERECO PARA COBRANÇA:", "ENDEREÇO PARA COBRANÇA:", "FILIAL:", "CNPJ:", "CEP:"]
GRID_HEAD = ["DADOS DA CONTRATANTE", "LOCAL DATA FOLHA", "DADOS PARA FATURAMENTO", "DADOS DE APROVAÇÃO", "ITEM Nº PRODUTO NCM QUANTIDADE", "FRETE IPI PRC.UNITARIO VALOR TOTAL"]
DASH_ADMIN = ["DADOS DO FATURAMENTO", "DADOS DO FORNECEDOR", "DADOS DA OBRA", "NOME", "ENDEREÇO", "ENDERECO", "CNPJ", "IE ", "VENDEDOR", "HOME PAGE", "E-MAIL", "OBRA", "LOCAL ENTREGA",
              "PONTO REFER", "Nº PEDIDO", "COTAÇÕES", "SOLICITAÇÕES"]
LINE_ADMIN = ["RIO VERDE", "ORDEM DE COMPRA", "CNO:", "GEROU O.C.", "FATURAR PARA", "FORNECEDOR:", "CNPJ", "INSC.", "CONDIÇÕES", "CONDICOES", "RUA ", "CEP", "E-MAIL", "OBSERVA", "DEPT.", "DIRETORIA"]
LINE_FOOT = r"(?i)total\s+ipi|total\s+icms|total\s+itens|total\s+geral|total\s+l[ií]quido|aprova|uau!\s+software"
# the layouts the votes choose between
GRID, DASH, LINE, UNKNOWN = "MRV", "L2M", "UAU", "DESCONHECIDO"
QUOTE_STRONG = ["cotacao de precos", "coleta de precos", "mapa de cotacao", "mapa de cotacoes", "solicitacao de cotacao", "pedido de cotacao", "validade da cotacao",
                "informacoes da cotacao", "proposta de precos"]
QUOTE_TERMS = QUOTE_STRONG + ["cotacao n", "cotacao no", "cotacao numero", "cotacao.:"]
ORDER_STRONG = ["ordem de compra", "pedido de compra", "dados da ordem de compra"]
ORDER_TERMS = ORDER_STRONG + ["dados do pedido", "numero do pedido", "oc n", "oc no"]
HEADER_WORDS = [
    "item", "codigo", "cod", "descricao", "descr", "produto", "material", "insumo", "un", "unid", "um", "qtde",
    "qtd", "quantidade", "quant", "preco", "preço", "valor", "unit",
]
TEXT_UNITS = r"UNID|UND|UN|PÇS|PÇ|PCS|PC|PCE|MTS|MT|M²|M³|M2|M3|KG|CX|RL|BR|LT|GL|FD|JG|PAR"


def _starts(c, words):
    return c.rlike("^(?:" + "|".join(w.replace(".", r"\.").replace("(", r"\(") for w in words) + ")")


def first_groups(c, patterns):
    """Kind and groups of the first pattern that fits the whole of ``c``, behind marks; null where none does.

    ``patterns``: kind -> (pattern, groups).  One replacement by the pattern's groups stands for one extract per group.
    """
    fits = lambda kind, p, n: F.regexp_replace(c, rf"(?:{p})(?s:.*)", "\u0001" + "\u0001".join([kind, *[f"${i}" for i in range(1, n + 1)]]))
    return reduce(lambda chain, x: chain.when(c.rlike(x[1][0]), fits(x[0], *x[1])), patterns.items(), F)


def split_pages(pages):
    """Page text to numbered non-blank lines."""
    return pages.select("doc_id", "page", F.posexplode(F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")).alias("pos", "text")) \
        .select("doc_id", "page", (F.col("pos") + 1).alias("line_no"), "text")


def vote_format(lines):
    """Layout votes over the first 60 lines of a document."""
    t, up = F.col("text"), F.upper("text")
    pts = lambda c, n: F.when(c, n).otherwise(0)
    grid = pts(t.rlike(GRID_ANY), 2) + pts(up.contains("NCM") & up.contains("ITEM") & up.contains("QUANTIDADE"), 1)
    dash = pts(t.rlike(DASH_ANY), 2) + pts(t.rlike(r"(?i)insumo\s+quantidade\s+unid"), 1) + pts(up.contains("PEDIDO DE COMPRA") & up.contains("INSUMO"), 1)
    line = pts(t.rlike(LINE_START) | t.rlike(BROKEN_START), 2) + pts(t.rlike(r"(?i)item\s+descri"), 1) \
        + pts(up.contains("UAU!") | (up.contains("ORDEM DE COMPRA") & up.contains("ITEM")), 1)
    g = lines.filter("line_no <= 60").groupBy("doc_id").agg(F.sum(grid).alias("v_grid"), F.sum(dash).alias("v_dash"), F.sum(line).alias("v_line"))
    return g.withColumn("layout", F.when((F.col("v_line") > F.col("v_dash")) & (F.col("v_line") > F.col("v_grid")), LINE)
                        .when(F.col("v_dash") > F.col("v_grid"), DASH).when(F.col("v_grid") > 0, GRID).otherwise(UNKNOWN))


def classify_lines(lines, layouts):
    """Class of each line under the layout its document voted for."""
    d = lines.join(layouts.select("doc_id", "layout"), "doc_id")
    t, up = F.trim("text"), F.upper(F.trim("text"))
    grid = (F.when(t == "", "RUIDO").when(t.rlike(r"^[_\-]{10,}$"), "SEPARADOR").when(up.isin("OBSERVAÇÕES", "OBSERVACOES"), "LINHA_OBSERVACAO")
            .when(up.startswith("PLANEJAMENTO DA ENTREGA") | t.rlike(r"^\d{2}/\d{2}/\d{4}\s+\d[\d.,]*$"), "LINHA_ENTREGA")
            .when(up.rlike("^DESCRI[ÇC][ÃA]O DETALHADA DO PRODUTO"), "DESCRICAO_ITEM").when(t.rlike(GRID_ANY), "INICIO_ITEM")
            .when(up.contains(" FOLHA") | _starts(up, GRID_HEAD), "CABECALHO_PAGINA").when(_starts(up, GRID_ADMIN), "BLOCO_ADMINISTRATIVO").otherwise("DESCONHECIDA"))
    dash = (F.when(F.trim(F.regexp_replace(t, r"\(cid:\d+\)", "")) == "", "RUIDO").when(t.rlike(r"(?i)insumo\s+quantidade\s+unid") | (up == "PEDIDO DE COMPRA"), "CABECALHO_PAGINA")
            .when(_starts(up, DASH_ADMIN), "BLOCO_ADMINISTRATIVO").when(t.rlike(DASH_ANY), "INICIO_ITEM").otherwise("DESCRICAO_ITEM"))
    line = (F.when(t == "", "RUIDO").when(t.rlike(LINE_FOOT), "BLOCO_ADMINISTRATIVO").when(t.rlike(r"(?i)item\s+descri"), "CABECALHO_PAGINA")
            .when(_starts(up, LINE_ADMIN) | up.rlike("UAU! SOFTWARE|P[ÁA]GINA"), "BLOCO_ADMINISTRATIVO").when(t.rlike(LINE_START) | t.rlike(BROKEN_START), "INICIO_ITEM")
            .when(t.rlike(r"^\d{1,4}$"), "DESCRICAO_ITEM").when(t.rlike(PAGE_BREAK), "INICIO_ITEM").otherwise("RUIDO"))
    return d.withColumn("line_class", F.when(F.col("layout") == LINE, line).when(F.col("layout") == DASH, dash).otherwise(grid))


def sessionise(lines):
    """A block opens at an item start and closes after a separator or before an administrative line."""
    w = W.partitionBy("doc_id").orderBy("page", "line_no")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    c = F.col("line_class")
    event = F.when(c == "INICIO_ITEM", "open").when(c.isin("CABECALHO_PAGINA", "BLOCO_ADMINISTRATIVO"), "close").when(c == "SEPARADOR", "end")
    d = lines.withColumn("_e", event).withColumn("block", F.sum(F.when(c == "INICIO_ITEM", 1).otherwise(0)).over(upto)) \
        .withColumn("_prev", F.last("_e", ignorenulls=True).over(before)).withColumn("_now", F.last("_e", ignorenulls=True).over(upto))
    keep = (F.col("_now") == "open") & ~c.isin("RUIDO")
    last = (c == "SEPARADOR") & (F.col("_prev") == "open")
    stop = (F.col("_e") == "close") & (F.col("_prev") == "open")
    return d.filter(keep | last | stop).withColumn("closes", F.when(stop, F.lower(c))).drop("_e", "_prev", "_now")


def build_blocks(lines):
    """One row per block; what closes it is noted."""
    s = sessionise(lines)
    body = F.struct("page", "line_no", "text", "line_class")
    return s.groupBy("doc_id", "block").agg(
        F.min(F.struct("page", "line_no")).alias("_f"), F.array_sort(F.collect_list(F.when(F.col("closes").isNull(), body))).alias("lines"), F.max("closes").alias("closed_by"),
        F.max((F.col("line_class") == "SEPARADOR") & F.col("closes").isNull()).alias("separator")).select("doc_id", "block", F.col("_f.page").alias("page"), "lines", "closed_by", "separator")


def structure_items(blocks):
    """E5: item fields of a block, first pattern that fits; a broken quantity is put together again."""
    start = F.get(F.filter("lines", lambda x: x["line_class"] == "INICIO_ITEM"), F.lit(0))["text"]
    b = blocks.withColumn("start", F.trim(start))
    s = F.col("start")
    # the pattern that fits hands all its groups over at once; each is read from the split text afterwards
    starts = {"grid": (GRID_START, 9), "dash": (DASH_START, 6), "line": (LINE_START, 6), "broken": (BROKEN_START, 4), "page": (PAGE_BREAK, 2)}
    b = b.withColumn("_g", F.split(first_groups(s, starts), "\u0001")).withColumn("kind", F.coalesce(F.get("_g", F.lit(1)), F.lit("none")))
    k = F.col("kind")
    g = lambda n: F.get("_g", F.lit(n + 1))
    num = lambda c: T.br_number(c, "dot")

    def by_kind(**groups):
        return reduce(lambda chain, x: chain.when(k == x[0], g(x[1])), groups.items(), F)
    cont = F.get(F.filter(F.transform("lines", lambda x: F.trim(x["text"])), lambda x: x.rlike(r"^\d{1,6}(?:[\s,.]|$)") & (x != s)), F.lit(0))
    b = b.withColumn("_cont", F.split(cont, r"\s+"))
    broken = k == "broken"
    b = b.withColumn("rebuilt", F.when(broken, num(F.concat(g(4), F.get("_cont", F.lit(0))))))
    again = broken & (F.col("rebuilt") > 0)
    b = b.withColumn("unit_price", num(F.when(again, F.get("_cont", F.lit(1))).otherwise(by_kind(grid=8, dash=5, line=5)))) \
        .withColumn("total", num(F.when(again, F.get("_cont", F.lit(2))).otherwise(by_kind(grid=9, dash=6, line=6)))) \
        .withColumn("_q", num(by_kind(grid=4, dash=3, line=4, broken=4, page=2)))
    worked_out = (k == "line") & (F.coalesce("_q", F.lit(0.0)) == 0) & (F.col("unit_price") != 0) & (F.col("total") != 0)
    qty = F.when(worked_out, F.round(F.col("total") / F.col("unit_price"), 4)).when(broken, F.coalesce(F.when(F.col("rebuilt") > 0, F.col("rebuilt")), "_q", F.lit(0.0))).otherwise(F.col("_q"))
    seen_note = F.exists("lines", lambda x: x["line_class"] == "LINHA_OBSERVACAO")
    note_at = F.array_min(F.transform(F.filter("lines", lambda x: x["line_class"] == "LINHA_OBSERVACAO"), lambda x: x["line_no"]))
    part = F.filter("lines", lambda x: (x["line_class"] == "DESCRICAO_ITEM") | ((x["line_class"] == "DESCONHECIDA") & (~seen_note | (x["line_no"] < note_at))))
    body = F.trim(F.array_join(F.filter(F.transform(part, lambda x: F.regexp_replace(F.trim(x["text"]), r"(?iu)^DESCRI(?:ÇÃO|CAO) DETALHADA DO PRODUTO\s*", "")), lambda x: x != ""), " "))
    desc = F.when(k.isin("grid", "dash"), body).otherwise(F.coalesce(by_kind(line=2, broken=2), F.lit("")))
    b = b.withColumn("qty", qty).withColumn("_cut", T.cut_boilerplate(F.trim(desc)))
    code = by_kind(grid=2, dash=1, line=1, broken=1, page=1)
    unit = F.upper(F.when(k == "page", "UN").otherwise(by_kind(grid=5, dash=4, line=3, broken=3)))
    interrupted = F.coalesce(F.col("closed_by") == "bloco_administrativo", F.lit(False))
    status = F.when(k == "none", "falhou").when(k == "page", "duvidoso").when(interrupted | (F.col("_cut.text") == ""), "ok_com_ressalvas").otherwise("ok")
    return b.select("doc_id", "block", "page", "kind", code.alias("client_code"), F.col("_cut.text").alias("description"), "qty", unit.alias("unit"), "unit_price", "total",
                    status.alias("status"), F.when(k.isin("none", "page"), 0.0).otherwise(0.85).alias("score"), interrupted.alias("interrupted"))


def classify_document(lines, docs, head=20, minimum=100):
    """Order, quotation or undecided, from the first lines, the body, the file name and a manual choice.

    Terms are flags per line, so no document text is put together; only the few
    terms that may straddle a line break would be missed, and those lines are
    joined with their successor first.
    """
    w = W.partitionBy("doc_id").orderBy("line_no")
    norm = lambda c: F.lower(T.squash(T.strip_accents(F.col(c), compat=True)))
    d = lines.withColumn("_n", norm("text")).filter("_n <> ''").withColumn("_r", F.row_number().over(w)).withColumn("_two", F.concat_ws(" ", "_n", F.when(F.col("_r") != head, F.lead("_n").over(w)))) \
        .withColumn("_body", F.concat_ws(" ", "_n", F.lead("_n").over(w)))
    has = lambda c, terms: F.max(F.col(c).rlike("|".join(t.replace(".", r"\.") for t in terms)))
    top = F.when(F.col("_r") <= head, F.col("_two"))
    g = d.withColumn("_top", top).groupBy("doc_id").agg(
        F.sum(F.length("text")).alias("chars"), has("_top", QUOTE_STRONG).alias("qs"), has("_top", ORDER_STRONG).alias("os"), has("_top", QUOTE_TERMS).alias("qt"),
        has("_body", QUOTE_TERMS).alias("qb"), has("_top", ORDER_TERMS).alias("ot"))
    j = docs.join(g, "doc_id", "left")
    for c in ("qs", "os", "qt", "qb", "ot"):
        j = j.withColumn(c, F.coalesce(c, F.lit(False)))
    name = F.lower(T.squash(F.regexp_replace(T.strip_accents(F.regexp_replace("file_name", r"\.[^.]*$", ""), compat=True), r"[_\-.]+", " ")))
    j = j.withColumn("hint", F.when(name.rlike(r"\bcot\b|\bcotacao\b|\bcoleta\b|\bmapa\b|\blista\b|\borcamento\b"), "COTACAO").when(name.rlike(r"\bo\.?\s?c\b|\bordem\b|\bpedido\b|\bped\b|\bocm\b|\bpc\b"), "OC"))
    qs, os_, qt, qb, ot = (F.col(c) for c in ("qs", "os", "qt", "qb", "ot"))
    kind = (F.when(F.coalesce(F.col("chars"), F.lit(0)) < minimum, F.coalesce("hint", F.lit("UI"))).when(os_ & qt & ~qs, "OC").when(qs, "COTACAO").when(os_, "OC")
            .when(qb & ~ot, "COTACAO").when(ot & ~qb, "OC").otherwise(F.coalesce("hint", F.lit("UI"))))
    manual = F.when(F.col("manual").isin("OC", "COTACAO"), F.col("manual"))
    return j.withColumn("kind", F.coalesce(manual, kind)).drop("qs", "os", "qt", "qb", "ot")


def gate_quotations(docs):
    """why a document is not taken as a quotation job."""
    return docs.withColumn("rejection", F.when(F.col("kind") == "UI", "documento por classificar").when(F.col("kind") != "COTACAO", "não é cotação")
                           .when(F.coalesce(F.col("chars"), F.lit(0)) < 100, "sem texto").when(F.col("layout").isNull(), "layout não reconhecido"))


def valid_item(desc, qty):
    """F11."""
    d = T.text(desc)
    letters = F.length(F.regexp_replace(d, r"[^\p{L}]", ""))
    return (F.length(d) >= 5) & (letters >= 3) & ~F.upper(d).rlike("TOTAL|SUBTOTAL|DESCONTO|FRETE|VALOR|OBS:|PAGINA") & F.coalesce(qty > 0, F.lit(False))


def extract_by_text(lines):
    """Three free-text patterns, valid items only, one per wording and quantity."""
    t = F.trim("text")
    p1 = rf"(?i)^\s*(\d{{1,3}})\s+(\S{{2,15}})\s+(.+?\d.+?)\s+({TEXT_UNITS})[\s.]*+(\d[\d.,]*)"
    p2 = rf"(?i)^\s*(\d{{1,4}})[.\-)]\s+(.+?)\s+({TEXT_UNITS})[\s.]*+(\d[\d.,]*)"
    p3 = rf"(?i)^\s*(.+?[a-zA-ZÀ-ÿ]{{8,}}?)\s+(\d[\d.,]*)\s+({TEXT_UNITS})\b"
    d = lines.filter(F.length(t) >= 12).withColumn("_p", F.when(t.rlike(p1), 1).when(t.rlike(p2), 2).when(t.rlike(p3) & ~F.regexp_extract(t, p3, 1).rlike(r"(?i)^\s*(total|sub\s*total)"), 3)).filter("_p is not null")
    g = lambda *x: F.when(F.col("_p") == 1, F.regexp_extract(t, p1, x[0])).when(F.col("_p") == 2, F.regexp_extract(t, p2, x[1])).otherwise(F.regexp_extract(t, p3, x[2]))
    d = d.select("doc_id", "page", "line_no", T.squash(g(3, 2, 1)).alias("description"), F.upper(g(4, 3, 3)).alias("unit"), T.br_number(g(5, 4, 2), "digits").alias("qty"))
    return dedup_lines(d.filter(valid_item(F.col("description"), F.col("qty"))))


def dedup_lines(df):
    """U13."""
    return first_per_key(df.withColumn("_k", F.upper(F.substring("description", 1, 40))), ["doc_id", "_k", "qty"], ["page", "line_no"]).drop("_k")


def best_strategy(strategies, enough=3):
    """Per document the first strategy with enough items, else the one with most; ``strategies`` in order."""
    u = None
    for n, (name, df) in enumerate(strategies):
        d = df.withColumn("strategy", F.lit(name)).withColumn("_o", F.lit(n))
        u = d if u is None else u.unionByName(d, allowMissingColumns=True)
    c = u.groupBy("doc_id", "strategy", "_o").agg(F.count("*").alias("_n"))
    pick = c.groupBy("doc_id").agg(F.min_by("strategy", F.struct(F.when(F.col("_n") >= enough, 0).otherwise(1).alias("a"), F.when(F.col("_n") >= enough, F.lit(0)).otherwise(-F.col("_n")).alias("b"), "_o")).alias("strategy"))
    return u.join(pick, ["doc_id", "strategy"], "left_semi").drop("_o")


def quality_gate(first, second):
    """The line parser of a document unless none of its items is usable, then the generic one."""
    ok = first.filter(F.col("status") != "falhou").select("doc_id").distinct()
    return first.join(ok, "doc_id", "left_semi").unionByName(second.join(ok, "doc_id", "left_anti"), allowMissingColumns=True)


def match_template(docs, templates, floor=0.7):
    """Learned layout whose words a document's signature contains best."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= 4))
    t = templates.withColumn("_w", words(F.col("signature"))).filter("size(_w) > 0")
    d = docs.select("doc_id", F.explode(words(F.col("signature"))).alias("w"))
    k = t.select("template", F.size("_w").alias("n"), F.explode("_w").alias("w"))
    s = d.join(k, "w").groupBy("doc_id", "template", "n").agg(F.count("*").alias("m")).withColumn("share", F.col("m") / F.col("n"))
    return s.filter(F.col("share") >= floor).groupBy("doc_id").agg(F.max(F.struct("share", "template")).alias("_b")).select("doc_id", "_b.template", "_b.share")


def next_line_code(lines):
    """The product code printed on the line after an item."""
    w = W.partitionBy("doc_id").orderBy("page", "line_no")
    return lines.withColumn("next_text", F.lead("text").over(w)).withColumn("next_code", F.nullif(F.regexp_extract("next_text", r"^\s*(\d{3,6})\b", 1), F.lit("")))


def carry_header(cells_rows):
    """The last header seen above each row, across pages."""
    w = W.partitionBy("doc_id").orderBy("page", "row_no").rowsBetween(W.unboundedPreceding, 0)
    return cells_rows.withColumn("header", F.last(F.when(F.col("is_header"), F.col("text")), ignorenulls=True).over(w))


def extract_by_header(cells):
    """Items of tables whose header names at least three known columns in the first five rows."""
    low = F.lower(F.trim(T.text(F.col("text"))))
    c = cells.withColumn("_t", low)
    words = F.col("_t").rlike("|".join(HEADER_WORDS))
    head = c.filter("row_no < 5").groupBy("doc_id", "page", "table_no", "row_no").agg(F.count_if(words).alias("n")).filter("n >= 3") \
        .groupBy("doc_id", "page", "table_no").agg(F.min("row_no").alias("head"))
    role = (F.when(F.col("_t").rlike("descr|produto|material|insumo"), "description").when(F.col("_t").rlike("qtde|qtd|quant"), "qty").when(F.col("_t").rlike("un|um"), "unit")
            .when(F.col("_t").contains("cod"), "client_code").when(F.col("_t").contains("item"), "item_no").when(F.col("_t").rlike("preco|preço|valor"), "unit_price"))
    k = ["doc_id", "page", "table_no"]
    h = c.join(head, k)
    roles = h.filter("row_no = head").select(*k, "col_no", role.alias("role")).filter("role is not null")
    body = h.filter("row_no > head").join(roles, [*k, "col_no"])
    of = lambda r: F.max_by(F.trim(T.text(F.col("text"))), F.when(F.col("role") == r, F.col("col_no")))
    rows = body.groupBy(*k, "row_no").agg(*[of(r).alias(r) for r in ("description", "qty", "unit", "client_code", "item_no", "unit_price")])
    rows = rows.withColumn("qty", T.br_number(F.col("qty"), "digits")).withColumn("unit_price", T.br_number(F.col("unit_price"), "digits")).withColumn("description", T.squash(F.col("description")))
    return rows.filter(valid_item(F.col("description"), F.col("qty"))).withColumn("unit", F.when(F.regexp_replace("unit", r"[,.]", "").rlike(r"^\d*$"), "PC").otherwise(F.coalesce("unit", F.lit("PC"))))


def parse_model_line(lines):
    """Read from the right: total, unit, quantity, price; the rest is the description."""
    num = r"(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d{1,4})?"
    unit = r"(?:UNID|UND|UN|PÇS|PÇ|PCS|PC|PCE|MTS|MT|M²|M³|M2|M3|M|KG|CX|RL|BR|LT|GL|FD|JG|PAR)\.?"
    p = rf"(?iu)^(\d{{1,4}})\s+(.+?)(?:\s+({num.replace('?:,', '?:[,.]')}[,.]\d+|\d+[,.]\d+))?(?:\s+({unit}))?\s+({num})(?:\s+({unit}))?(?:\s+R\$\s+({num}))?$"
    t = F.trim("text")
    g = lambda n: F.nullif(F.regexp_extract(t, p, n), F.lit(""))
    d = lines.filter(t.rlike(p))
    return d.select("doc_id", "page", "line_no", g(1).cast("int").cast("string").alias("client_code"), F.btrim(g(2), F.lit(" -–.")).alias("description"), T.br_number(g(5), "both").alias("qty"),
                    T.norm_unit(F.coalesce(g(6), g(4))).alias("unit"), T.br_number(g(3), "both").alias("document_price"), T.br_number(g(7), "both").alias("document_total"))


def extract_priced(lines):
    """Strict priced document; any bad line, repeated code, zero quantity or early text rejects it whole."""
    num = r"(?:\d{1,3}(?:\.\d{3})+|\d+)"
    p = rf"^(\d{{1,4}})\s+(.+?)\s+({num},\d{{2,3}})\s+({num}(?:,\d{{1,3}})?)\s+R\$\s+({num},\d{{2}})$"
    head = r"(?iu)^COD\s+\S+\s+descri[çc][ãa]o\s+VALOR\s+unit\s+(?:qnd|quantidade)\s+TOTAL$"
    t = F.trim("text")
    d = lines.filter(t != "").withColumn("_h", t.rlike(head)).withColumn("_g", F.split(first_groups(t, {"item": (p, 5)}), "\u0001"))
    g = lambda n: F.get("_g", F.lit(n + 1))
    dec = lambda n, s: F.replace(F.replace(g(n), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(f"decimal(18,{s})")
    d = d.select("doc_id", "page", "line_no", "_h", F.col("_g").isNotNull().alias("_i"), g(1).cast("int").cast("string").alias("code"), dec(4, 6).alias("qty"), dec(3, 6).alias("price"), dec(5, 2).alias("total"),
                 g(2).alias("description"))
    pos = F.struct("page", "line_no")
    per_code = d.filter("_i").groupBy("doc_id", "code").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("repeats"))
    doc = d.groupBy("doc_id").agg(F.min(pos).alias("first"), F.min(F.when(F.col("_h"), pos)).alias("head"), F.max(~F.col("_h") & ~F.col("_i")).alias("bad"),
                                  F.max(F.coalesce(F.col("_i") & (F.col("qty") <= 0), F.lit(False))).alias("zero"), F.count_if("_i").alias("items")).join(per_code, "doc_id", "left")
    reason = F.when(F.col("head").isNull(), "layout não suportado").when(F.col("first") < F.col("head"), "conteúdo anterior ao cabeçalho").when(F.col("bad"), "item fora do layout") \
        .when(F.col("repeats") > 1, "código repetido").when(F.col("zero"), "quantidade inválida").when(F.col("items") == 0, "nenhum item")
    doc = doc.withColumn("reason", reason)
    good = d.filter("_i").join(doc.filter("reason is null").select("doc_id"), "doc_id", "left_semi")
    return good.select("doc_id", "page", "line_no", "code", "description", "qty", "price", "total"), doc.filter("reason is not null").select("doc_id", "reason")


def extract_quote(lines):
    """Quote lines under the column layout the last header fixed (3, 4 or 8 columns); price above zero."""
    num = r"(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?"
    val = r"(?:\d{1,3}(?:\.\d{3})+|\d+),\d{2,3}"
    cols = {8: [num, num, val, val, val, val, val, val], 4: [num, num, val, val], 3: [num, val, val]}
    pats = {k: r"^(\d{4})(?!\d)\s*(.+?)\s+" + r"\s+".join(f"({c})" for c in v) + "$" for k, v in cols.items()}
    head = r"(?iu)^Produto\s+(Emb\.?\s+)?Qtde\s+Unit[aá]rio\s+Total(\s+IPI\s+ICMS\s+Ret\.?\s+Unit\.Imp\.?\s+Tot\.c/Imp\.?)?$"
    t = F.trim("text")
    d = lines.withColumn("_own", F.when(t.rlike(head), F.when(F.regexp_extract(t, head, 2) != "", 8).when(F.regexp_extract(t, head, 1) != "", 4).otherwise(3)))
    w = W.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("layout", F.last("_own", ignorenulls=True).over(w)).filter("_own is null").filter(t.rlike(r"^\d{4}(?!\d)"))
    fit = lambda k: (F.col("layout").isNull() | (F.col("layout") == k)) & t.rlike(pats[k])
    d = d.withColumn("_k", F.when(fit(8), 8).when(fit(4), 4).when(fit(3), 3))
    g = lambda n8, n4, n3: F.when(F.col("_k") == 8, F.regexp_extract(t, pats[8], n8)).when(F.col("_k") == 4, F.regexp_extract(t, pats[4], n4)).otherwise(F.regexp_extract(t, pats[3], n3))
    return d.filter("_k is not null").select("doc_id", "page", "line_no", T.norm_code(F.substring(t, 1, 4), "int").alias("code"), g(2, 2, 2).alias("description"),
                                             T.br_number(g(4, 4, 3), "lone").alias("qty"), T.br_number(g(5, 5, 4), "lone").alias("price")).filter("price > 0")


def canonical_items(df):
    """One set of names whatever the extractor called them."""
    have = lambda *c: F.coalesce(*[F.col(x) for x in c if x in df.columns], F.lit(None))
    return df.select("*", have("description_rebuilt", "description", "description_original").alias("order_description"), have("qty", "order_qty").alias("order_quantity"),
                     F.coalesce(have("unit_norm", "unit"), F.lit("PC")).alias("order_unit_name"), F.coalesce(have("internal_code", "client_code"), F.lit("")).alias("order_code"))


def known_layout(docs, formats):
    """Saved identifiers of four or more characters found in the text; the first format on the list wins."""
    f = formats.filter("length(identifier) >= 4").select(F.upper("identifier").alias("needle"), "format", "ordinal")
    first = f.groupBy("needle").agg(F.min_by("format", "ordinal").alias("format"), F.min("ordinal").alias("ordinal"))
    return contained(docs, "doc_id", F.upper("text"), f, F.col("needle")).join(first, "needle").groupBy("doc_id").agg(F.min_by("format", "ordinal").alias("format"))


def extract_two_line(lines):
    """Item on one line, product code named on the next one."""
    p = r"(?i)^(\d{4,6})\s+([\d.,]+)\s+(UN|M|MT|BR|PC|CX|KG|RL|UND)\s+(.+?)\s+(\d{4,6})\s+([\d.,]+)\s+[\d.,]+\s+[\d.,]+\s+[\d.,]+\s+([\d.,]+)$"
    t = F.trim("text")
    g = lambda n: F.regexp_extract(t, p, n)
    d = next_line_code(lines).filter(t.rlike(p))
    qty, price, total = (T.br_number(g(n), "dot") for n in (2, 6, 7))
    d = d.select("doc_id", "page", "line_no", g(1).alias("client_code"), g(4).alias("description"), F.upper(g(3)).alias("unit"), qty.alias("qty"), price.alias("unit_price"), total.alias("total"),
                 F.nullif(F.regexp_extract("next_text", rf"(?iu){SUPPLIER}\s+C[ÓO]D\.?\s*(\d+)", 1), F.lit("")).alias("product_code"))
    again = F.round(F.col("total") / F.col("unit_price"), 4)
    return d.withColumn("qty", F.when((F.coalesce("qty", F.lit(0.0)) == 0) & (F.col("unit_price") != 0) & (again > 0), again).otherwise(F.col("qty")))


# Horizontal ranges of the positioned layout.
X_RANGES = {"item_no": (0, 60), "client_code": (90, 140), "qty": (150, 200), "unit": (205, 225), "unit_price": (425, 470), "total": (535, 580)}


def extract_by_position(words):
    """Columns by horizontal range; the description lies within y-2..y+20 of the item."""
    w = words.withColumn("y", F.round("y0", 1))
    role = F.coalesce(*[F.when((F.col("x0") >= a) & (F.col("x0") < b), F.lit(k)) for k, (a, b) in X_RANGES.items()])
    of = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("x0", "text")))), lambda x: x["text"]), " ").alias(r)
    rows = w.withColumn("role", role).filter("role is not null").groupBy("doc_id", "page", "y").agg(*[of(r) for r in X_RANGES])
    items = rows.filter(F.col("item_no").rlike(r"^\d{3,6}$")).withColumn("qty", T.br_number(F.replace("qty", F.lit("R$"), F.lit("")), "comma")).filter("qty > 0")
    band = 22.0
    near = items.select("doc_id", "page", "y", F.explode(F.array_distinct(F.array(F.floor((F.col("y") - 2) / band), F.floor((F.col("y") + 20) / band)))).alias("b"))
    text = w.filter((F.col("x0") >= 228) & (F.col("x0") < 420) & ~F.col("text").startswith("=>")).select("doc_id", "page", F.col("y").alias("y2"), "x0", "text", F.floor(F.col("y") / band).alias("b"))
    desc = near.join(text, ["doc_id", "page", "b"]).filter("y2 >= y - 2 and y2 <= y + 20").groupBy("doc_id", "page", "y").agg(
        T.squash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y2", "x0", "text"))), lambda x: x["text"]), " ")).alias("description"))
    return items.join(desc, ["doc_id", "page", "y"]).select(
        "doc_id", "page", "y", "client_code", "description", "qty", F.coalesce(F.nullif("unit", F.lit("")), F.lit("UN")).alias("unit"),
        T.br_number(F.replace("unit_price", F.lit("R$"), F.lit("")), "comma").alias("unit_price"), T.br_number(F.replace("total", F.lit("R$"), F.lit("")), "comma").alias("total"))


CELL_UNITS = [
    "UN", "UND", "UNID", "PC", "PCS", "PÇ", "PÇS", "PCE", "M", "MT", "MTS", "MTR", "METRO", "M2", "M²", "M3", "M³",
    "KG", "TON", "CX", "CAIXA", "RL", "ROLO", "BR", "BRAÇO", "LT", "L", "GL", "GALAO", "FD", "FDO", "FARD", "JG",
    "JGO", "JD", "JARRA", "PAR", "PR", "BCT", "SAC", "SC", "TUBO", "BAR",
]


def extract_by_content(cells, unit_share=0.4, number_share=0.6):
    """Tables without a header; what a column holds decides its role."""
    k = ["doc_id", "page", "table_no"]
    c = cells.withColumn("v", T.squash(T.text(F.col("text")))).filter("v <> ''")
    unit = F.upper(F.regexp_replace("v", r"[.\s:]", "")).isin(CELL_UNITS)
    number = F.col("v").rlike(r"^\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?$|^\d+(?:\.\d+)?$")
    letters = F.length(F.regexp_replace("v", r"[^\p{L}]", ""))
    long_ = (F.length("v") >= 8) & (letters >= 5)
    s = c.groupBy(*k, "col_no").agg(F.avg(unit.cast("int")).alias("u"), F.avg(number.cast("int")).alias("n"), F.avg(F.when(long_, F.length("v"))).alias("d"),
                                    F.avg(((F.length("v") > 1) & (F.length("v") <= 12) & ~unit).cast("int")).alias("s"))
    size = c.groupBy(*k).agg(F.countDistinct("row_no").alias("rows"), (F.max("col_no") + 1).alias("cols")).filter("rows >= 3 and cols >= 3").select(*k)
    t = s.join(size, k, "left_semi").groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("col_no", "u", "n", "d", "s"))).alias("cs"))
    first = lambda a: F.get(a, F.lit(0))["col_no"]
    best = lambda f: F.array_min(F.transform(F.filter("cs", lambda x: x[f].isNotNull()), lambda x: F.struct((-x[f]).alias("k"), x["col_no"].alias("col_no"))))
    t = t.withColumn("_u", best("u")).filter(-F.col("_u.k") >= unit_share).withColumn("cu", F.col("_u.col_no"))
    t = t.withColumn("nums", F.filter("cs", lambda x: x["n"] >= number_share)).withColumn("cq", F.coalesce(first(F.filter("nums", lambda x: F.abs(x["col_no"] - F.col("cu")) == 1)), first(F.col("nums")))).filter("cq is not null")
    t = t.withColumn("_d", F.array_min(F.transform(F.filter("cs", lambda x: x["d"].isNotNull() & (x["col_no"] != F.col("cu")) & (x["col_no"] != F.col("cq"))), lambda x: F.struct((-x["d"]).alias("k"), x["col_no"].alias("col_no"))))).filter("_d is not null").withColumn("cd", F.col("_d.col_no"))
    t = t.withColumn("cc", first(F.filter("cs", lambda x: (x["col_no"] < F.col("cd")) & (x["col_no"] != F.col("cu")) & (x["col_no"] != F.col("cq")) & (x["s"] >= 0.6))))
    t = t.withColumn("cp", first(F.filter("nums", lambda x: (x["col_no"] > F.col("cu")) & (x["col_no"] != F.col("cq")) & (x["col_no"] != F.col("cd")) & ~x["col_no"].eqNullSafe(F.col("cc")))))
    j = c.join(t.select(*k, "cu", "cq", "cd", "cc", "cp"), k)
    header = F.lower(F.rtrim("v", F.lit("."))).isin(HEADER_WORDS)
    of = lambda col, name: F.max(F.when(F.col("col_no") == F.col(col), F.col("v"))).alias(name)
    r = j.groupBy(*k, "row_no").agg(F.count_if(header).alias("_h"), of("cd", "description"), of("cq", "q"), of("cu", "unit"), of("cc", "client_code"), of("cp", "p")).filter("_h < 2")
    r = r.withColumn("qty", T.br_number(F.col("q"), "digits")).withColumn("unit_price", T.br_number(F.col("p"), "digits"))
    good = F.upper(F.regexp_replace("unit", r"[.\s:]", "")).isin(CELL_UNITS)
    return r.filter(valid_item(F.col("description"), F.col("qty"))).select(*k, "row_no", "client_code", "description", "qty", F.when(good, F.col("unit")).otherwise("PC").alias("unit"), "unit_price")


def extract_quotation(cells):
    """Blocks under a repeated header; the delivery date stands within three rows below an item."""
    k = ["doc_id", "page", "table_no"]
    rows = cells.groupBy(*k, "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", F.trim(T.text(F.col("text"))).alias("t")))), lambda x: x["t"]).alias("c"))
    low = F.transform("c", F.lower)
    pos = lambda f: F.array_min(F.transform(F.filter(F.transform(low, lambda x, i: F.struct(i.alias("i"), f(x).alias("ok"))), lambda x: x["ok"]), lambda x: x["i"]))
    q, u = pos(lambda x: x.contains("quantidade")), pos(lambda x: x.startswith("unid") | (x == "un."))
    head = (F.size("c") >= 3) & F.get(low, F.lit(0)).isin("código", "codigo") & F.get(low, F.lit(1)).contains("descri") & q.isNotNull() & u.isNotNull()
    w = W.partitionBy(*k).orderBy("row_no")
    r = rows.withColumn("_h", F.when(head, F.struct(q.alias("q"), u.alias("u")))).withColumn("h", F.last("_h", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    date = F.when(F.get("c", F.lit(0)).rlike(r"^\d{2}/\d{2}/\d{4}"), F.regexp_extract(F.get("c", F.lit(0)), r"^(.*?)(?: - .*)?$", 1))
    r = r.withColumn("delivery", F.first(date, ignorenulls=True).over(w.rowsBetween(1, 3)))
    d = r.filter(F.col("_h").isNull() & F.col("h").isNotNull() & F.get("c", F.lit(0)).rlike(r"^\d{1,5}$"))
    return d.withColumn("qty", T.br_number(F.get("c", F.col("h.q")), "dot")).filter("qty > 0").select(
        *k, "row_no", F.get("c", F.lit(0)).alias("client_code"), F.get("c", F.lit(1)).alias("description"), "qty", T.norm_unit(F.get("c", F.col("h.u"))).alias("unit"), "delivery")


def quotation_metadata(cells, lines):
    """Number and date of a quotation; the number may be a loose cell near the top."""
    order = F.struct("page", "table_no", "row_no", "col_no")
    loose = cells.filter((F.col("row_no") < 15) & F.trim(T.text(F.col("text"))).rlike(r"^\d{4,6}$")).groupBy("doc_id").agg(F.min_by(F.trim("text"), order).alias("_cell"))
    at = F.struct("page", "line_no")
    num = F.nullif(F.regexp_extract("text", r"(?iu)N[ºo°]?\s*Cota[çc][ãa]o\s*:?\s*(\d{2,6})", 1), F.lit(""))
    day = F.nullif(F.regexp_extract("text", r"(\d{2}/\d{2}/\d{4})", 1), F.lit(""))
    first = lines.filter("page = 1").withColumn("_n", num).withColumn("_d", day).groupBy("doc_id").agg(
        F.min_by("_n", F.when(F.col("_n").isNotNull(), at)).alias("_n"), F.min_by("_d", F.when(F.col("_d").isNotNull(), at)).alias("date"))
    return first.join(loose, "doc_id", "full_outer").select("doc_id", F.coalesce("_n", "_cell", F.lit("")).alias("number"), F.coalesce("date", F.lit("")).alias("date"))
