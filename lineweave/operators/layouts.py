"""Item tables of named layouts (E8 tabular, E12, E13, E14, E24) and the layout of a document.

Cells are long rows (doc_id, page, table_no, row_no, col_no, text).  Column roles come from header rows by position and are
carried down with windows over rows; a document never travels as one value.
"""
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import SUPPLIER
from .documents import TABLE, table_rows

# Markers, units and header words of the layouts.
ORDER_UNITS = ["M", "MT", "UN", "UND", "RL", "BR", "KG", "CX", "PC", "L", "LT"]
POSITIONED_MARKERS = ["PEDIDO DE COMPRA", "ALTERNATIVO", SUPPLIER, "SPE"]
TWO_LINE_NAMES = ["PAULO OCTAVIO", "PAULOOCTAVIO", "PO EMPREENDIMENTOS", "PO 827"]
CLIENT_WORDS = r"(?i)\b(?:cooperativa|construtora|incorporadora|engenharia|spe)\b"
CLIENT_TAIL = r"(?iu)\s*(?:N[ºo°]\s*Cota|CNPJ|Data Cota|Avenida|Av\.|Rua |Rodovia|CEP).*$"
DESCRIPTION_TAIL = r"(?iu)\s*(?:Dever[ãa]o ser|a NF o certificado|juntamente com a NF|dos fabricantes/fornecedores|Programa Setorial).*$"
REPEATED_HEADER = r"(?iu)insumo|quantidade|preço"
HEADER_DEPTH = 40
BLOCKS, COLLECTION, SIMPLE_LIST = "SIENGE_BLOCOS", "UAU_COLETA", "LISTA_SIMPLES"


def detect_layout(lines):
    """(doc_id, layout) from flags per line; the first layout of the ladder that fits.  Null: none.

    A quotation by its title is none of the tabular orders.  The layouts by votes over lines (UAU, MRV) follow from A19.
    """
    page = F.min("page").over(W.partitionBy("doc_id"))
    up, low = T.plain_upper(F.col("text")), F.lower("text")
    d = lines.withColumn("_first", F.col("page") == page).withColumn("_two", F.col("page") < page + 2)
    at = lambda where, test: F.max(F.col(where) & test)
    has = lambda where, *words: [at(where, up.contains(w)) for w in words]
    every = lambda flags: reduce(lambda a, b: a & b, flags)
    some = lambda flags: reduce(lambda a, b: a | b, flags)
    quote = at("_first", low.contains("cotação de preços") | low.contains("cotacao de precos"))
    ladder = [("SIENGE", at("_first", low.contains("sienge") | low.contains("starian")) & ~quote),
              ("TERRAL", every(has("_two", *POSITIONED_MARKERS))),
              ("BRASAL", every(has("_first", f"{SUPPLIER}/{SUPPLIER}", "CODIGO", "QUANTIDADE", "UNIDADE")) | every(has("_first", "PROCESSO", "ORDEM DE COMPRA", "BRASAL", "DADOS DO FORNECEDOR"))),
              ("PAVINI", every(has("_first", "DADOS DA ORDEM DE COMPRA", "RESPONSAVEL PELA COMPRA")) | every(has("_first", "PAVINI", "OBRA/CENTRO DE CUSTO"))),
              ("PAULO_OCTAVIO", every(has("_first", "PEDIDO DE COMPRA", "PROCESSO")) & some(has("_first", *TWO_LINE_NAMES))),
              ("UAU", at("_first", low.contains("uau! software") | low.contains("gerou o.c."))),
              ("MRV", at("_first", low.contains("ncm")) & at("_first", low.contains("item nº") | low.contains("item no")))]
    return d.groupBy("doc_id").agg(*[flag.alias(name) for name, flag in ladder]).select("doc_id", F.coalesce(*[F.when(F.col(name), name) for name, _ in ladder]).alias("layout"))


def _cell(i):
    return F.coalesce(F.try_element_at("c", F.lit(i) if isinstance(i, int) else i), F.lit(""))


def _number(c):
    return F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def _where(test):
    """Lowest column whose lower-case text passes."""
    hits = F.filter(F.map_entries("low"), lambda e: test(e["value"]))
    return F.array_min(F.transform(hits, lambda e: e["key"]))


def _rows(cells):
    r = table_rows(cells).withColumn("c", F.transform_values("c", lambda k, v: T.squash(v)))
    return r.withColumns({"low": F.transform_values("c", lambda k, v: F.lower(v)), "width": F.array_max(F.map_keys("c")) + 1})


def extract_fixed(cells):
    """Order tables with fixed columns: code, quantity, unit, description; prices by the row's width of 9 or 12.

    A row is an item if its code is digits (dots aside), its unit known and its description not a heading.
    """
    r = table_rows(cells)
    r = r.withColumns({"c": F.transform_values("c", lambda k, v: F.trim(F.regexp_replace(v, r"[\n\r]+", " "))), "width": F.array_max(F.map_keys("c")) + 1})
    code = F.regexp_replace(_cell(0), r"[.\s]", "")
    d = r.filter((F.col("width") >= 4) & code.rlike(r"^\d+$") & F.upper(_cell(2)).isin(ORDER_UNITS) & ~F.upper(_cell(3)).isin(f"{SUPPLIER}/{SUPPLIER}", "DESCRIÇÃO DO PRODUTO", ""))
    wide = F.col("width") >= 12
    text = T.squash(F.regexp_replace(F.regexp_replace(_cell(3), f"(?i){SUPPLIER}/{SUPPLIER}", ""), r"\b\d{1,2}\.\d{3}\b", ""))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "table_no", "row_no"))
    return d.select("doc_id", "page", nth.alias("line_no"), code.alias("client_code"), text.alias("description"), _number(_cell(1)).alias("qty"), F.upper(_cell(2)).alias("unit"),
                    F.when(wide, _number(_cell(6))).otherwise(_number(_cell(4))).alias("price"), F.when(wide, _number(_cell(11))).otherwise(_number(_cell(8))).alias("total"))


def lines_from_fixed(cells):
    """The same rows as text lines: code, unit, quantity, description, price, total as written."""
    r = table_rows(cells)
    r = r.withColumns({"c": F.transform_values("c", lambda k, v: F.trim(F.regexp_replace(v, r"[\n\r]+", ""))), "width": F.array_max(F.map_keys("c")) + 1})
    code = F.regexp_replace(_cell(0), r"[.\s]", "")
    d = r.filter((F.col("width") >= 4) & code.rlike(r"^\d+$") & F.upper(_cell(2)).isin(ORDER_UNITS) & ~F.upper(_cell(3)).isin(f"{SUPPLIER}/{SUPPLIER}", "DESCRIÇÃO DO PRODUTO", ""))
    wide = F.col("width") >= 12
    text = T.squash(F.regexp_replace(F.regexp_replace(_cell(3), f"(?i){SUPPLIER}/{SUPPLIER}", ""), r"\b\d{1,2}\.\d{3}\b", ""))
    parts = [code, _cell(2), _cell(1), text, F.when(wide, _cell(6)).otherwise(_cell(4)), F.when(wide, _cell(11)).otherwise(_cell(8))]
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "table_no", "row_no"))
    return d.select("doc_id", "page", nth.alias("line_no"), F.trim(F.concat_ws(" ", *parts)).alias("text"))


def extract_numbered(cells):
    """Numbered tables (first row names ITEM or N.); quantity and unit share a cell, one above the other."""
    r = table_rows(cells).withColumn("flat", F.transform_values("c", lambda k, v: F.trim(F.regexp_replace(v, r"[\n\r]+", " "))))
    table = W.partitionBy(*TABLE)
    r = r.withColumn("_first", F.min("row_no").over(table))
    names = F.transform(F.map_values("flat"), F.upper)
    r = r.withColumn("_items", F.max((F.col("row_no") == F.col("_first")) & (F.array_contains(names, "ITEM") | F.array_contains(names, "N."))).over(table))
    at = lambda i: F.coalesce(F.try_element_at("flat", F.lit(i)), F.lit(""))
    amount = F.transform(F.split(F.trim(F.coalesce(F.try_element_at("c", F.lit(2)), F.lit(""))), "\n"), F.trim)
    unit = F.upper(F.coalesce(F.get(amount, F.lit(1)), F.lit("UND")))
    d = r.filter(F.col("_items") & (F.col("row_no") > F.col("_first")) & at(0).rlike(r"^\d+$") & ~F.upper(at(1)).isin("N.", "ITEM", ""))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "table_no", "row_no"))
    return d.select("doc_id", "page", "table_no", "row_no", T.squash(at(1)).alias("description"), _number(F.get(amount, F.lit(0))).alias("qty"), F.when(unit.isin(ORDER_UNITS), unit).otherwise("UND").alias("unit"),
                    _number(at(3)).alias("price"), _number(at(6)).alias("total")).filter("qty is not null").withColumn("line_no", nth).drop("table_no", "row_no")


def extract_tabular(cells):
    """E8 tabular: (items, headers).  Items of the first table of each page that names insumo and quantity.

    The first such table of a document fixes the columns; later pages add their rows without the repeated header.  The price
    after discounts is preferred to the unit price, a missing total is quantity times price.  Headers: order number and date
    from the row that starts with its label, client from the first name below the invoicing title.
    """
    r = _rows(cells).withColumn("low", F.transform_values("low", lambda k, v: F.trim(v)))
    doc, table = W.partitionBy("doc_id").orderBy("page", "table_no", "row_no"), W.partitionBy(*TABLE)
    qty_name = lambda x: x.contains("quantidade") | x.contains("qtd")
    r = r.withColumn("_top", F.col("row_no") == F.min("row_no").over(table))
    r = r.withColumn("_h", F.col("_top") & _where(lambda x: x.contains("insumo")).isNotNull() & _where(qty_name).isNotNull())
    r = r.withColumn("_mine", F.max("_h").over(table)).withColumn("_table", F.min(F.when(F.col("_mine"), F.col("table_no"))).over(W.partitionBy("doc_id", "page")))
    nz = lambda c: F.when(c > 0, c)  # noqa: E731  column 0 counts as not found, except for the first
    price_final = _where(lambda x: x.contains("preço final") | x.contains("preco final") | (x.contains("final") & x.contains("preç")))
    price_unit = _where(lambda x: (x.contains("preço unit") | x.contains("preco unit")) & ~x.contains("final"))
    roles = F.struct(F.coalesce(_where(lambda x: x.contains("insumo")), F.lit(0)).alias("desc"), F.coalesce(nz(_where(qty_name)), F.lit(1)).alias("qty"),
                     F.coalesce(nz(_where(lambda x: x.contains("unid") | (x == "un."))), F.lit(2)).alias("unit"), F.coalesce(nz(price_final), nz(price_unit), F.lit(3)).alias("price"),
                     nz(_where(lambda x: x.contains("total") & ~x.contains("sub") & ~x.contains("insumo"))).alias("total"), nz(_where(lambda x: x.contains("data") | x.contains("previs") | x.contains("entrega"))).alias("date"))
    place = F.struct("page", "table_no", "row_no")
    i = r.filter(F.col("_mine") & (F.col("table_no") == F.col("_table"))).withColumn("roles", F.first(F.when(F.col("_h"), roles), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("page", "table_no", "row_no")))
    i = i.withColumn("_start", F.min(place).over(W.partitionBy("doc_id")))
    line = F.array_join(F.map_values("c"), " ")
    later = F.col("page") > F.col("_start.page")
    i = i.filter(~F.col("_top") & ~(later & line.rlike(REPEATED_HEADER)))
    cell = lambda role: F.coalesce(F.try_element_at("c", F.col(f"roles.{role}")), F.lit(""))
    wording = r"^(\d+)\s*-\s*(.+)$"
    i = i.select("doc_id", "page", "table_no", "row_no", F.regexp_extract(cell("desc"), wording, 1).alias("client_code"), F.when(cell("desc").rlike(wording), F.regexp_extract(cell("desc"), wording, 2)).otherwise(cell("desc")).alias("description"),
                 F.coalesce(_number(cell("qty")), F.lit(0.0)).alias("qty"), F.coalesce(F.nullif(F.upper(cell("unit")), F.lit("")), F.lit("UN")).alias("unit"), F.coalesce(_number(cell("price")), F.lit(0.0)).alias("price"),
                 F.coalesce(_number(cell("total")), F.lit(0.0)).alias("total"), cell("date").alias("delivery")).filter("qty <> 0 and description <> ''")
    i = i.withColumn("total", F.when((F.col("total") == 0) & (F.col("price") > 0), F.round(F.col("qty") * F.col("price"), 2)).otherwise(F.col("total"))).withColumn("line_no", F.row_number().over(doc)).drop("table_no", "row_no")

    first = F.lower(F.trim(_cell(0)))
    label = first.isin("pedido", "cotação", "cotacao")
    invoicing = F.max((first.contains("faturamento")).cast("int")).over(doc.rowsBetween(W.unboundedPreceding, -1)) == 1
    m = r.withColumn("_named", F.coalesce(invoicing, F.lit(False)) & first.contains("nome") & ~first.contains("faturamento") & (F.col("width") >= 2))
    h = m.groupBy("doc_id").agg(F.min_by(_cell(1), F.when(label & (F.col("width") >= 2), place)).alias("number"), F.min_by(_cell(3), F.when(label & (F.col("width") >= 4), place)).alias("date"),
                                F.min_by(_cell(1), F.when(F.col("_named"), place)).alias("client"))
    return i, h.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("number", "date", "client")])


def quotation_layouts(cells):
    """(doc_id, layout) of quotations: by the first header row, in page order, among the first rows of a table."""
    r = _rows(cells).filter(F.col("width") >= 2)
    r = r.withColumn("_nth", F.row_number().over(W.partitionBy(*TABLE).orderBy("row_no"))).filter(F.col("_nth") <= HEADER_DEPTH)
    low = F.map_values("low")
    first, second = F.coalesce(F.try_element_at("low", F.lit(0)), F.lit("")), F.coalesce(F.try_element_at("low", F.lit(1)), F.lit(""))
    quant = F.exists(low, lambda x: x.contains("quant"))
    kind = (F.when(first.isin("código", "codigo") & second.contains("descri"), BLOCKS).when(F.array_contains(low, "insumo") & quant, COLLECTION)
            .when(F.exists(low, lambda x: x.contains("descri")) & quant & F.exists(low, lambda x: x.startswith("unid") | (x == "un.")), SIMPLE_LIST))
    return r.withColumn("layout", kind).filter("layout is not null").groupBy("doc_id").agg(F.min_by("layout", F.struct("page", "table_no", "row_no")).alias("layout"))


def _quantity(c):
    """Narrow cells break a number over two lines; text that is no number is 0."""
    return F.coalesce(_number(F.regexp_replace(c, r"\s+", "")), F.lit(0.0))


def _unit(c):
    return F.coalesce(T.norm_unit(c), F.lit("UN"))


def _carried(r, roles, header):
    w = W.partitionBy(*TABLE).orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    # a header row that lacks a column stops the table: its struct is there, its ``ok`` is false
    d = r.withColumn("_h", header).withColumn("r", F.last(F.when(F.col("_h"), roles), ignorenulls=True).over(w))
    return d.filter(~F.col("_h") & F.col("r.ok"))


def extract_simple_list(cells):
    """E13 simple list: number, description, unit, quantity; rows without a quantity come with ``qty`` 0."""
    low = F.map_values("low")
    unit_at = lambda x: x.startswith("unid") | (x == "un.")
    header = F.exists(low, lambda x: x.contains("descri")) & F.exists(low, lambda x: x.contains("quant")) & F.exists(low, unit_at)
    roles = F.struct(_where(lambda x: x.isin("nº", "n°", "no", "n")).alias("num"), _where(lambda x: x.contains("descri")).alias("desc"), _where(unit_at).alias("unit"), _where(lambda x: x.contains("quant")).alias("qty"), F.lit(True).alias("ok"))
    d = _carried(_rows(cells), roles, header)
    cell = lambda role: F.coalesce(F.try_element_at("c", F.col(f"r.{role}")), F.lit(""))
    d = d.filter((F.col("width") > F.greatest("r.num", "r.desc", "r.unit", "r.qty")) & (cell("desc") != ""))
    return d.select("doc_id", "page", "table_no", "row_no", cell("num").alias("client_code"), cell("desc").alias("description"), F.greatest(_quantity(cell("qty")), F.lit(0.0)).alias("qty"), _unit(cell("unit")).alias("unit"), F.lit("").alias("delivery"))


def extract_collection(cells):
    """E13 price collection: item, insumo, description, unit, quantity; a repeated item number, or insumo with quantity, counts once.

    Rows without a quantity come with ``qty`` 0 and are not compared with others.
    """
    header = F.exists(F.map_values("low"), lambda x: x.contains("insumo")) & F.exists(F.map_values("low"), lambda x: x.contains("quant"))
    found = {"item": _where(lambda x: x.startswith("item")), "code": _where(lambda x: x.contains("insumo")), "desc": _where(lambda x: x.contains("descri")), "unit": _where(lambda x: x.startswith("unid")), "qty": _where(lambda x: x.contains("quant"))}
    ok = reduce(lambda a, b: a & b, [found[k].isNotNull() for k in ("code", "desc", "unit", "qty")])
    d = _carried(_rows(cells), F.struct(*[v.alias(k) for k, v in found.items()], ok.alias("ok")), header)
    cell = lambda role: F.coalesce(F.try_element_at("c", F.col(f"r.{role}")), F.lit(""))
    text = F.btrim(F.regexp_replace(cell("desc"), DESCRIPTION_TAIL, ""), F.lit(" ,;-."))
    d = d.filter(F.col("width") > F.greatest("r.qty", "r.unit", "r.desc")).select(*TABLE, "row_no", cell("item").alias("num"), cell("code").alias("client_code"), text.alias("description"),
                                                                                 F.greatest(_quantity(cell("qty")), F.lit(0.0)).alias("qty"), _unit(cell("unit")).alias("unit"), F.lit("").alias("delivery"))
    d = d.filter((F.col("description") != "") & (F.col("client_code") != "") & ((F.col("num") == "") | F.col("num").rlike(r"^\d{1,4}$")))
    key = F.when(F.col("qty") == 0, F.concat_ws("|", "page", "table_no", "row_no")).when(F.col("num") != "", F.col("num")).otherwise(F.concat_ws("|", "client_code", F.col("qty").cast("string")))
    d = d.withColumn("_k", key).withColumn("_empty", F.col("qty") == 0)
    first = F.row_number().over(W.partitionBy("doc_id", "_k", "_empty").orderBy("page", "table_no", "row_no"))
    return d.withColumn("_n", first).filter("_n = 1").drop("_k", "_empty", "_n", "num")


def extract_quotations(cells, blocks):
    """(items, report).  Each quotation by its layout; ``blocks`` reads the layout of repeated headers.

    The report has one row per document with a layout: items and rows that were left out for want of a quantity.
    """
    kinds = quotation_layouts(cells)
    of = lambda layout: cells.join(kinds.filter(F.col("layout") == layout).select("doc_id"), "doc_id", "left_semi")
    columns = ["doc_id", "page", "table_no", "row_no", "client_code", "description", "qty", "unit", "delivery"]
    parts = [blocks(of(BLOCKS)).select(*columns), extract_simple_list(of(SIMPLE_LIST)).select(*columns), extract_collection(of(COLLECTION)).select(*columns)]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    report = kinds.join(rows.groupBy("doc_id").agg(F.count_if(F.col("qty") > 0).alias("items"), F.count_if(F.col("qty") == 0).alias("without_qty")), "doc_id", "left").fillna(0, ["items", "without_qty"])
    return rows.filter("qty > 0"), report


def quotation_client(cells, lines):
    """E14, client: the first loose cell of over eight characters that names a kind of company, else such a line of page one."""
    cut = lambda c: F.substring(F.btrim(F.regexp_replace(c, CLIENT_TAIL, ""), F.lit(" -|")), 1, 80)
    names = lambda c: c.rlike(CLIENT_WORDS) & (F.length(c) > 8)
    v = T.squash(T.text(F.col("text")))
    nth = F.dense_rank().over(W.partitionBy(*TABLE).orderBy("row_no"))
    a = cells.withColumn("v", v).withColumn("_n", nth).filter((F.col("_n") <= 15) & names(F.col("v"))).groupBy("doc_id").agg(F.min_by("v", F.struct("page", "table_no", "row_no", "col_no")).alias("cell"))
    first = F.min("page").over(W.partitionBy("doc_id"))
    b = lines.withColumn("_p", first).filter((F.col("page") == F.col("_p")) & F.col("text").rlike(CLIENT_WORDS) & (F.length(F.trim("text")) > 8)).groupBy("doc_id").agg(F.min_by("text", F.struct("page", "line_no")).alias("line"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce(F.nullif(cut(F.col("cell")), F.lit("")), cut(F.col("line")), F.lit("")).alias("client"))
