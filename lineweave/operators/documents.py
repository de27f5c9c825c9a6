"""Items from whole documents: tables with carried columns (E23), catalogue pages (E21, W14), model documents and the
waterfall over all extractors (E20, E11, U15).

Inputs are text: ``lines`` (doc_id, page, line_no, text) and ``cells`` (doc_id, page, table_no, row_no, col_no, text).
"""
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import table_rules as R
from ..functions import text as T
from ..session import cut_lineage
from .common import first_per_key

TABLE = ["doc_id", "page", "table_no"]


def _any(tests):
    return reduce(lambda a, b: a | b, tests)


def table_rows(cells):
    """One row per table row with ``c``: a map from column number to cell text.  A row is as wide as its table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return cells.groupBy(*TABLE, "row_no").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col_no").cast("int").alias("col_no"), text.alias("text")))).alias("c"))


def _at(cells, i):
    return F.try_element_at(cells, i)


def lines_from_cells(cells):
    """Item tables as numbered text lines (doc_id, page, line_no, text, idx, description, unit, qty, price, total).

    A header may stand in any row of a table of two rows or more; its columns hold for the rows below it and for later
    tables without a header, over pages, until the next header.  A row with an item number and a description but no
    quantity waits: the next row with its number, a quantity and no description takes the waiting text and what the row
    below it adds.  Without one the text says that the item must be looked at.
    """
    r = table_rows(cells).withColumn("clean", F.transform_values("c", lambda k, v: F.trim(F.regexp_replace(v, r"[\n\r]+", ""))))
    low = F.transform_values("clean", lambda k, v: F.lower(v))
    values = F.map_values(low)
    is_header = F.array_contains(values, "item") & F.arrays_overlap(values, F.lit(R.ITEM_TABLE_HINTS))

    def column(role, default):
        hits = F.filter(F.map_entries(low), lambda e: e["value"].isin(R.ITEM_COLUMNS[role]))
        return F.coalesce(F.array_max(F.transform(hits, lambda e: e["key"])), F.lit(default)).alias(role)
    found = F.struct(*[column(role, {"idx": 0, "desc": 1}.get(role, -1)) for role in R.ITEM_COLUMNS])
    table = W.partitionBy(*TABLE)
    doc = W.partitionBy("doc_id").orderBy("page", "table_no", "row_no")
    r = r.withColumns({"_h": is_header, "_rows": F.count(F.lit(1)).over(table)}).filter("_rows > 1")
    r = r.withColumn("_head", F.min(F.when(F.col("_h"), F.col("row_no"))).over(table))
    r = r.withColumn("role", F.last(F.when(F.col("row_no") == F.col("_head"), found), ignorenulls=True).over(doc.rowsBetween(W.unboundedPreceding, 0)))
    r = r.withColumn("_below", F.lead("clean").over(table.orderBy("row_no")))
    d = r.filter((F.col("_head").isNull() | (F.col("row_no") > F.col("_head"))) & F.col("role").isNotNull())

    raw = lambda role: F.coalesce(_at(F.col("c"), F.col(f"role.{role}")), F.lit(""))
    cell = lambda role: F.coalesce(_at(F.col("clean"), F.col(f"role.{role}")), F.lit(""))
    last_number = F.try_element_at(F.regexp_extract_all(raw("idx"), F.lit(r"\d+"), F.lit(0)), F.lit(-1))
    idx = F.when(raw("idx").contains("\n") & raw("idx").rlike(r"(?i)\bItem\b"), F.coalesce(last_number, cell("idx"))).otherwise(cell("idx"))
    own = F.when(F.lower(cell("desc")).isin(R.REPEATED_HEADER_CELL), "").otherwise(cell("desc"))
    aside = F.array(*[F.when((F.col("role.desc") + j != F.col("role.unit")) & (F.col("role.desc") + j != F.col("role.qty")), F.nullif(_at(F.col("clean"), F.col("role.desc") + j), F.lit(""))) for j in range(1, 5)])
    has_desc_cell = F.map_contains_key("clean", F.col("role.desc"))
    desc = F.when(own != "", own).when(has_desc_cell, F.coalesce(F.get(F.array_compact(aside), F.lit(0)), F.lit(""))).otherwise("")
    qty_below = F.get(F.regexp_extract_all(F.try_element_at(F.split(raw("qty"), "\n"), F.lit(-1)), F.lit(r"[\d.,]+"), F.lit(0)), F.lit(0))
    qty = F.when(raw("qty").contains("\n"), F.coalesce(qty_below, cell("qty"))).otherwise(cell("qty"))
    more = F.coalesce(_at(F.col("_below"), F.col("role.desc")), F.lit(""))
    d = d.select(*TABLE, "row_no", idx.alias("idx"), desc.alias("desc"), cell("unit").alias("unit"), qty.alias("qty"), cell("price").alias("price"), cell("total").alias("total"),
                 F.when((more != "") & ~more.rlike(r"^\d"), more).otherwise("").alias("more")).filter(F.col("idx").rlike("[0-9]"))

    place = F.struct("page", "table_no", "row_no")
    waits = F.when((F.col("qty") == "") & (F.col("desc") != ""), F.struct(place.alias("place"), "idx", "desc"))
    d = d.withColumn("_wait", F.last(waits, ignorenulls=True).over(doc.rowsBetween(W.unboundedPreceding, -1)))
    takes = (F.col("qty") != "") & (F.col("desc") == "") & (F.col("_wait.idx") == F.col("idx"))
    d = d.withColumn("_takes", F.coalesce(takes, F.lit(False)))
    before = F.sum(F.col("_takes").cast("int")).over(W.partitionBy("doc_id", "_wait.place").orderBy("page", "table_no", "row_no").rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("_first", F.col("_takes") & (F.coalesce(before, F.lit(0)) == 0)).filter("qty <> ''")
    missing = F.concat(F.lit("ITEM "), F.col("idx"), F.lit(" SEM DESCRICAO - REVISAR MANUALMENTE"))
    text = F.when(F.col("desc") != "", F.col("desc")).when(F.col("_first"), F.trim(F.concat_ws(" ", "_wait.desc", "more"))).otherwise(missing)
    d = d.withColumn("description", text).withColumn("line_no", F.row_number().over(doc))
    return d.select("doc_id", "page", "line_no", F.trim(F.concat_ws(" ", "idx", "description", "unit", "qty", "price", "total")).alias("text"), "idx", "description", "unit", "qty", "price", "total")


# ---- catalogue pages ----------------------------------------------------------------------------------------------

def lines_from_words(words):
    """Lines of a page from positioned words (doc_id, page, x0, y0, text): words of one rounded height, left to right."""
    at = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"])
    g = words.withColumn("y", F.round("y0", 1)).groupBy("doc_id", "page", "y").agg(F.trim(F.array_join(at, " ")).alias("text")).filter("text <> ''")
    return g.withColumn("line_no", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("y"))).select("doc_id", "page", "line_no", "text")


def _catalogue_text(c):
    return T.squash(F.translate(F.upper(T.strip_accents(T.text(c))), "”“′", "\"\"'"))


def title_above(lines):
    """Code lines with the title of their table, (doc_id, page, line_no, text, title).

    Between a code line and the one before it on the page, the title is the run of title lines above the table's header
    nearest to it; noise inside the run is skipped, any other line ends it.  Where there is none, ``title`` is null.
    """
    t = F.col("_t")
    raw = F.trim(T.text(F.col("text")))
    code = raw.rlike(r"^\d{3,4}\s+")
    noise = (t == "") | t.isin(R.CATALOGUE_NOISE) | t.rlike(r"^\d+\s*$|^\d+\s+\d+\s*$|^\*") | _any([t.contains(p) for p in R.CATALOGUE_NOISE_PARTS])
    header = t.contains("COD") & t.contains("BITOLA") & t.contains("EMBAL")
    title = ~t.rlike(r"^\d{3,4}\s+") & (F.length(t) >= 3) & _any([t.contains(w) for w in R.CATALOGUE_TITLE_WORDS])
    d = lines.select("doc_id", "page", "line_no", "text", _catalogue_text(F.col("text")).alias("_t"))
    d = d.withColumn("kind", F.when(code, "code").when(header, "header").when(noise, "noise").when(title, "title").otherwise("other"))
    page = W.partitionBy("doc_id", "page").orderBy("line_no")
    d = d.withColumn("segment", F.coalesce(F.sum((F.col("kind") == "code").cast("int")).over(page.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    seg = W.partitionBy("doc_id", "page", "segment")
    upto = lambda kind, limit: F.max(F.when((F.col("kind") == kind) & limit, F.col("line_no"))).over(seg)
    d = d.withColumn("_head", upto("header", F.lit(True)))
    d = d.withColumn("_low", upto("title", F.col("line_no") < F.col("_head")))
    d = d.withColumn("_stop", upto("other", F.col("line_no") < F.col("_low")))
    part = (F.col("kind") == "title") & (F.col("line_no") <= F.col("_low")) & (F.col("line_no") > F.coalesce("_stop", F.lit(-1)))
    g = d.filter(part | (F.col("kind") == "code")).groupBy("doc_id", "page", "segment").agg(
        F.max(F.when(F.col("kind") == "code", F.struct("line_no", "text"))).alias("code"), F.array_sort(F.collect_list(F.when(part, F.struct("line_no", "_t")))).alias("parts"))
    words = F.split(T.squash(F.array_join(F.transform("parts", lambda x: x["_t"]), " ")), " ")
    once = T.let(words, lambda w: F.when(F.size(w) > 2, F.filter(w, lambda x, i: (i == 0) | (x != F.get(w, i - 1)))).otherwise(w))
    return g.filter("code is not null").select("doc_id", "page", "code.line_no", "code.text", F.nullif(F.array_join(once, " "), F.lit("")).alias("title"))


def extract_catalogue(lines, enrich=None):
    """Catalogue rows of text pages: section, family, code, gauge, pack, description, measures; one per code, family and gauge.

    The first of equal rows stays.  A code line without a title above its table's header is left out, as is one that
    doesn't read as code, gauge and pack.  ``enrich`` is a column function over the description (K2).
    """
    page_text = lines.select("doc_id", "page", _catalogue_text(F.col("text")).alias("t"))
    named = page_text.groupBy("doc_id", "page").agg(*[F.max(F.col("t").contains(s)).alias(f"s{i}") for i, s in enumerate(R.CATALOGUE_SECTIONS)])
    section = named.select("doc_id", "page", F.coalesce(*[F.when(F.col(f"s{i}"), s) for i, s in enumerate(R.CATALOGUE_SECTIONS)]).alias("section"))
    d = title_above(lines).filter("title is not null").withColumn("_t", T.squash(F.col("text"))).filter(F.col("_t").rlike(R.CATALOGUE_ROW))
    g = lambda n: F.regexp_extract("_t", R.CATALOGUE_ROW, n)
    d = d.select("doc_id", "page", "line_no", F.col("title").alias("family"), F.lpad(g(1), 4, "0").alias("product_code"), F.trim(g(2)).alias("gauge"), g(3).alias("pack"))
    d = first_per_key(d, ["doc_id", "product_code", "family", "gauge"], ["page", "line_no"]).join(section, ["doc_id", "page"])
    mm = F.replace(_catalogue_text(F.col("gauge")), F.lit(","), F.lit("."))
    number = r"(\d+(?:\.\d+)?)"
    first = lambda c, *patterns: F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])
    d = d.withColumn("description", F.concat_ws(" - ", "family", "gauge"))
    d = d.withColumns({"length_m": first(F.replace("family", F.lit(","), F.lit(".")), rf"\b{number}\s*M\b").cast("double"),
                       "gauge_mm": first(mm, rf"\bDN\s*{number}\b", rf"^{number}\s*X\s*\d", rf"^{number}\s*X\s*[\d./\"]+", rf"^{number}$").cast("double"),
                       "gauge_inch": first(_catalogue_text(F.col("gauge")), r'(\d+(?:\.\d+)?(?:/\d+)?)"', r"\b(\d+(?:\.\d+)?/\d+)\b")})
    return d.withColumn("features", enrich(F.col("description"))) if enrich else d


# ---- model documents and the waterfall ----------------------------------------------------------------------------

def _number(c):
    """Brazilian or plain decimal text; anything else is null."""
    v = F.trim(F.replace(F.trim(T.text(c)), F.lit("R$"), F.lit("")))
    br = F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(v.rlike(R.NUMBER), br.try_cast("double")).otherwise(F.replace(v, F.lit(","), F.lit(".")).try_cast("double"))


def _unit(c):
    return T.norm_unit(c)


def _header_like(values):
    joined = F.lower(F.array_join(values, " "))
    return sum((joined.contains(m).cast("int") for m in R.MODEL_HEADER_MARKS), F.lit(0)) >= 2


def consolidate_pages(items):
    """A page mark repeats the last item: equal code and wording of a document are one item, quantities added.

    Codes of a document that come back with another wording start a new item; items without a code stay as they are.
    """
    doc = W.partitionBy("doc_id", "client_code").orderBy("page", "line_no")
    d = items.withColumn("_new", F.coalesce((F.lag("description").over(doc) != F.col("description")).cast("int"), F.lit(0)))
    d = d.withColumn("_run", F.when(F.col("client_code") == "", F.concat_ws("-", "page", "line_no")).otherwise(F.sum("_new").over(doc).cast("string")))
    rest = [c for c in items.columns if c not in ("doc_id", "client_code", "qty")]
    g = d.groupBy("doc_id", "client_code", "_run").agg(F.min_by(F.struct(*rest), F.struct("page", "line_no")).alias("_r"), F.round(F.sum("qty"), 3).alias("qty"))
    return g.select("doc_id", "client_code", "qty", *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*items.columns)


ITEM = ["doc_id", "page", "line_no", "client_code", "description", "qty", "unit", "price", "total"]


def _items(df, **columns):
    have = {c: columns.get(c, F.col(c) if c in df.columns else F.lit(None)) for c in ITEM}
    kinds = {"page": "int", "line_no": "long", "qty": "double", "price": "double", "total": "double"}
    return df.select(*[have[c].cast(kinds.get(c, "string")).alias(c) for c in ITEM])


def model_tables(cells):
    """First family of E20: tables of the model layout by their header (first three rows) or by what their columns hold."""
    c = cells.withColumn("v", T.squash(T.text(F.col("text"))))
    rows = c.groupBy(*TABLE, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "v"))).alias("_c")).withColumn("vs", F.transform("_c", lambda x: x["v"]))
    rows = rows.filter(F.exists("vs", lambda v: v != "")).withColumn("nth", F.row_number().over(W.partitionBy(*TABLE).orderBy("row_no")))
    first = lambda p: F.array_min(F.transform(F.filter("_c", lambda x: x["v"].rlike(p)), lambda x: x["col_no"]))
    head = F.when(first(R.MODEL_TITLE).isNotNull() & first(R.MODEL_DESCRIPTION).isNotNull() & first(R.MODEL_QUANTITY).isNotNull(),
                  F.struct(first(R.MODEL_DESCRIPTION).alias("desc"), first(R.MODEL_QUANTITY).alias("qty"), first(R.MODEL_TITLE).alias("code"), first(R.MODEL_UNIT).alias("unit")))
    by_header = rows.filter("nth <= 3").withColumn("cols", head).filter("cols is not null").groupBy(*TABLE).agg(F.min_by("cols", "nth").alias("cols"))
    body = rows.withColumn("_head", _header_like(F.col("vs"))).filter("not _head").drop("_head")
    both = body.join(_columns_by_content(body), TABLE, "left").join(by_header.withColumnRenamed("cols", "named"), TABLE, "left").withColumn("cols", F.coalesce("named", "cols")).filter("cols is not null")
    at = lambda role: F.get(F.transform(F.filter("_c", lambda x: x["col_no"] == F.col(f"cols.{role}")), lambda x: x["v"]), F.lit(0))
    code = F.coalesce(at("code"), F.lit(""))
    d = both.select(*TABLE, "row_no", at("desc").alias("description"), _number(at("qty")).alias("qty"), code.alias("code"), at("unit").alias("unit"))
    d = d.filter(F.col("description").isNotNull() & ((F.col("code") == "") | F.col("code").rlike(r"^\d{1,4}$")) & (F.col("qty") > 0) & ((F.col("description") != "") | (F.col("code") != "")))
    number = F.when(F.col("code") == "", "").otherwise(F.col("code").cast("int").cast("string"))
    line = F.col("table_no").cast("long") * 1000000 + F.col("row_no")
    return consolidate_pages(_items(d, client_code=number, line_no=line, unit=_unit(F.col("unit"))))


def _columns_by_content(body):
    """Columns of tables of four to six columns from what they hold: units at 0.6, a number column next to it at 0.9, codes at 0.8."""
    full = body.filter(F.size(F.filter("vs", lambda v: v != "")) >= 2)
    size = full.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n"), (F.max(F.array_max(F.transform("_c", lambda x: x["col_no"]))) + 1).alias("cols")).filter("n >= 2 and cols between 4 and 6").select(*TABLE)
    v = F.col("v")
    letters = F.length(F.regexp_replace(v, r"[^\p{L}]", ""))
    long_ = (F.length(v) >= 6) & (letters >= 4)
    share = lambda test: F.avg(test.cast("int"))
    s = full.select(*TABLE, F.explode("_c").alias("x")).select(*TABLE, F.col("x.col_no").alias("col_no"), F.col("x.v").alias("v")).filter("v <> ''").join(size, TABLE, "left_semi")
    s = s.groupBy(*TABLE, "col_no").agg(share(F.coalesce(_unit(v).isin(R.MODEL_UNITS), F.lit(False))).alias("u"), share(_number(v).isNotNull()).alias("n"), F.avg(F.when(long_, F.length(v))).alias("d"),
                                        share(v.rlike(r"^\d{1,4}$")).alias("k"))
    t = s.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("col_no", "u", "n", "d", "k"))).alias("cs"))
    best = lambda f, test: F.array_min(F.transform(F.filter("cs", lambda x: x[f].isNotNull() & test(x)), lambda x: F.struct((-x[f]).alias("k"), x["col_no"].alias("col_no"))))["col_no"]
    first = lambda test: F.array_min(F.transform(F.filter("cs", test), lambda x: x["col_no"]))
    t = t.withColumn("unit", best("u", lambda x: x["u"] >= 0.6)).filter("unit is not null")
    numeric = lambda x: (x["n"] >= 0.9) & (x["col_no"] != F.col("unit"))
    t = t.withColumn("qty", F.coalesce(first(lambda x: numeric(x) & (x["col_no"] == F.col("unit") + 1)), first(lambda x: numeric(x) & (x["col_no"] == F.col("unit") - 1)))).filter("qty is not null")
    other = lambda x: (x["col_no"] != F.col("unit")) & (x["col_no"] != F.col("qty"))
    t = t.withColumn("desc", best("d", other)).filter("desc is not null")
    t = t.withColumn("code", first(lambda x: other(x) & (x["col_no"] < F.col("desc")) & (x["k"] >= 0.8))).filter("code is not null")
    return t.select(*TABLE, F.struct("desc", "qty", "code", "unit").alias("cols"))


def model_line(c):
    """A line of the model layout, read from the right: struct of code, description, qty, unit, price and total; null if it isn't one."""
    w = F.split(T.squash(T.text(c)), " ")

    def drop(a, n):
        return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))

    def last(a, i=1):
        return F.try_element_at(a, F.lit(-i))

    def read(tokens):
        body = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
        s = F.struct(F.get(tokens, F.lit(0)).alias("code"), body.alias("b"))

        def money(x):
            ok = F.coalesce((F.size(x["b"]) >= 2) & (F.upper(last(x["b"], 2)) == "R$") & _number(last(x["b"])).isNotNull(), F.lit(False))
            return F.struct(x["code"].alias("code"), F.when(ok, drop(x["b"], 2)).otherwise(x["b"]).alias("b"), F.when(ok, _number(last(x["b"]))).alias("total"))

        def unit(x):
            ok = F.coalesce(_unit(last(x["b"])).isin(R.MODEL_UNITS), F.lit(False))
            return F.struct(x["code"].alias("code"), F.when(ok, drop(x["b"], 1)).otherwise(x["b"]).alias("b"), x["total"].alias("total"), F.when(ok, _unit(last(x["b"]))).alias("unit"))

        def qty(x):
            return F.struct(x["code"].alias("code"), drop(x["b"], 1).alias("b"), x["total"].alias("total"), x["unit"].alias("unit"), _number(last(x["b"])).alias("qty"))

        def unit_before(x):
            ok = F.coalesce(x["unit"].isNull() & _unit(last(x["b"])).isin(R.MODEL_UNITS), F.lit(False))
            return F.struct(x["code"].alias("code"), F.when(ok, drop(x["b"], 1)).otherwise(x["b"]).alias("b"), x["total"].alias("total"), F.when(ok, _unit(last(x["b"]))).otherwise(x["unit"]).alias("unit"), x["qty"].alias("qty"))

        def price(x):
            ok = F.coalesce(last(x["b"]).rlike("[,.]") & _number(last(x["b"])).isNotNull(), F.lit(False))
            text = F.btrim(F.array_join(F.when(ok, drop(x["b"], 1)).otherwise(x["b"]), " "), F.lit(" -–."))
            return F.struct(x["code"].cast("int").cast("string").alias("code"), text.alias("description"), x["qty"].alias("qty"), x["unit"].alias("unit"), F.when(ok, _number(last(x["b"]))).alias("price"), x["total"].alias("total"))
        steps = reduce(lambda v, f: T.let(v, f), [money, unit, qty, unit_before, price], s)
        return F.when((F.size(tokens) >= 3) & F.get(tokens, F.lit(0)).rlike(r"^\d{1,4}$"), steps)
    return T.let(T.let(w, read), lambda r: F.when(r["qty"].isNotNull() & (r["description"] != ""), r))


def model_text(lines):
    """Second family of E20: (items, refused).  One line out of the layout refuses its whole document, so that no item is lost unseen.

    The header must be the first text line of page one, and every page must have text.
    """
    d = lines.select("doc_id", "page", "line_no", F.trim(T.text(F.col("text"))).alias("t"))
    d = d.withColumn("head", F.col("t").rlike(R.MODEL_TITLE) & F.col("t").rlike(R.MODEL_DESCRIPTION) & F.col("t").rlike(R.MODEL_QUANTITY)).withColumn("item", F.when((F.col("t") != "") & ~F.col("head"), model_line(F.col("t"))))
    at = F.struct("page", "line_no")
    written = F.col("t") != ""
    doc = d.groupBy("doc_id").agg(F.min(F.when(F.col("head") & (F.col("page") == 1), at)).alias("head_at"), F.min(F.when(written, at)).alias("text_at"),
                                  F.min(F.when(written & ~F.col("head") & F.col("item").isNull(), at)).alias("bad_at"))
    reason = (F.when(F.col("head_at").isNull(), F.lit("layout")).when(F.col("text_at") < F.col("head_at"), "conteúdo anterior ao cabeçalho")
              .when(F.col("bad_at").isNotNull(), F.concat(F.lit("página "), F.col("bad_at.page"), F.lit(", linha "), F.col("bad_at.line_no"), F.lit(": item fora do layout"))))
    doc = doc.select("doc_id", reason.alias("reason"))
    good = d.filter("item is not null").join(doc.filter("reason is null").select("doc_id"), "doc_id", "left_semi")
    items = _items(good.select("doc_id", "page", "line_no", "item.*"), client_code=F.col("code"))
    return items, doc.filter("reason is not null and reason <> 'layout'")


def items_from_sheet(cells, depth=R.SHEET_HEADER_ROWS):
    """The first of a sheet's first rows that names description and quantity is the header; the rows below are items."""
    c = cells.withColumn("v", F.trim(T.text(F.col("text")))).withColumn("v", F.when(F.lower("v") == "nan", "").otherwise(F.col("v")))
    rows = c.groupBy(*TABLE, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "v"))).alias("_c"))
    first = lambda p, avoid=None: F.array_min(F.transform(F.filter("_c", lambda x: x["v"].rlike(p) & (~x["v"].rlike(avoid) if avoid else F.lit(True))), lambda x: x["col_no"]))
    cols = F.struct(first(R.MODEL_DESCRIPTION).alias("desc"), first(R.MODEL_QUANTITY).alias("qty"), first(R.MODEL_CODE_COLUMN, R.MODEL_QUANTITY).alias("code"), first(R.MODEL_UNIT).alias("unit"))
    heads = rows.filter(F.col("row_no") < depth).withColumn("cols", cols).filter("cols.desc is not null and cols.qty is not null").select(*TABLE, F.col("row_no").alias("head"), "cols")
    # every header candidate with the rows below it; the first that has items counts
    d = rows.join(heads, TABLE).filter("row_no > head")
    at = lambda role: F.coalesce(F.get(F.transform(F.filter("_c", lambda x: x["col_no"] == F.col(f"cols.{role}")), lambda x: x["v"]), F.lit(0)), F.lit(""))
    d = d.select(*TABLE, "head", "row_no", at("desc").alias("description"), _number(at("qty")).alias("qty"), F.regexp_replace(at("code"), r"^(\d+)\.0$", "$1").alias("client_code"), _unit(F.nullif(at("unit"), F.lit(""))).alias("unit"))
    d = d.filter((F.col("description") != "") & (F.col("qty") != 0))
    used = d.groupBy(*TABLE).agg(F.min("head").alias("head"))
    return _items(d.join(used, [*TABLE, "head"], "left_semi"), line_no=F.col("row_no"))


def trust_codes(items, family):
    """F14 applied: whether a document's codes are codes, not line numbers.  Model documents and sheets say so per row."""
    if family in ("MODELO_TABELA", "MODELO_TEXTO", "PLANILHA"):
        return items.withColumn("code_trusted", F.coalesce(F.col("client_code") != "", F.lit(False)))
    doc = W.partitionBy("doc_id")
    nth = F.row_number().over(doc.orderBy("page", "line_no"))
    d = items.withColumn("_n", nth).withColumn("_c", F.trim(T.text(F.col("client_code"))))
    filled = F.min(F.col("_c") != "").over(doc)
    short = F.min(F.col("_c").rlike(r"^\d{1,4}$")).over(doc)
    counted = F.min(F.col("_c") == F.col("_n").cast("string")).over(doc)
    return d.withColumn("code_trusted", filled & ~(short & counted)).drop("_n", "_c")


def waterfall(docs, families):
    """Items of each document from the first family that gives any, with ``family`` and ``code_trusted``.

    ``families`` is a list of (name, function of the documents still left -> items).  A document leaves with the first
    family that reads it, so later and costlier readers see only the rest; each family's items are written once.
    """
    left = docs.select("doc_id").distinct()
    out = None
    for name, read in families:
        items = cut_lineage(trust_codes(read(left), name).withColumn("family", F.lit(name)))
        left = left.join(items.select("doc_id").distinct(), "doc_id", "left_anti")
        out = items if out is None else out.unionByName(items, allowMissingColumns=True)
    return out


def extract_unpriced(lines, cells, orders, quotations):
    """E20 over the usual families, in their order: model table, model text, purchase layouts, quotations.

    ``orders`` and ``quotations`` are functions (lines, cells) -> items of the documents given to them.
    """
    def of(frame, left):
        return frame.join(left, "doc_id", "left_semi")
    everything = lines.select("doc_id").unionByName(cells.select("doc_id"))
    usable = lambda d: d.filter((F.coalesce("description", F.lit("")) != "") & (F.col("qty") > 0))
    return waterfall(everything, [("MODELO_TABELA", lambda left: model_tables(of(cells, left))), ("MODELO_TEXTO", lambda left: model_text(of(lines, left))[0]),
                                  ("COMPRA", lambda left: usable(_items(orders(of(lines, left), of(cells, left))))), ("COTACAO", lambda left: usable(_items(quotations(of(lines, left), of(cells, left)))))])


def document_summary(items):
    """What a document gave: family, items, with a price, without a code."""
    return items.groupBy("doc_id", "family").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.coalesce(F.col("price") != 0, F.lit(False))).alias("with_price"),
                                                  F.count_if(F.coalesce("client_code", F.lit("")) == "").alias("without_code"))


# ---- generic extraction with learned templates --------------------------------------------------------------------

def best_template(signatures, templates, floor=0.7):
    """The learned template whose words a signature holds best; equal shares go to the first template by key.

    A template's words are indexed by the one that fewest templates hold among them that occur in the documents; only
    documents with enough of its words are counted in full, by the join on all words.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= 4))
    t = templates.withColumn("_w", words(F.col("signature"))).filter("size(_w) > 0").select("key", F.size("_w").alias("n"), F.explode("_w").alias("w"))
    d = signatures.select("doc_id", F.explode(words(F.col("signature"))).alias("w"))
    s = d.join(t, "w").groupBy("doc_id", "key", "n").agg(F.count(F.lit(1)).alias("m")).withColumn("share", F.col("m") / F.col("n")).filter(F.col("share") >= floor)
    return s.groupBy("doc_id").agg(F.min_by(F.struct("key", "share"), F.struct((-F.col("share")).alias("s"), "key")).alias("b")).select("doc_id", "b.key", "b.share")


def extract_generic(docs, templates, strategies, enough=3):
    """(items, templates).  The learned template's strategy first, if it gives items; else the live strategies.

    ``docs`` (doc_id, signature), ``templates`` (key, signature, strategy, used, last_items), ``strategies`` a list of
    (name, function of the documents to read -> items) in order: a document stops at the first strategy with ``enough``
    items, else keeps the one with most.  Templates come back with their use counted, and with a new one for each
    signature that a live strategy read; of several documents with one new signature, each counts as a use.
    """
    hit = cut_lineage(best_template(docs, templates).join(templates.select("key", "strategy"), "key"))
    tried = None
    for name, read in strategies:
        mine = hit.filter(F.col("strategy") == name).select("doc_id")
        items = read(mine).withColumn("strategy", F.lit(name))
        tried = items if tried is None else tried.unionByName(items, allowMissingColumns=True)
    learned = cut_lineage(tried.withColumn("template", F.lit(True)))
    left = docs.select("doc_id").join(learned.select("doc_id").distinct(), "doc_id", "left_anti")
    kept = []
    for name, read in strategies:  # those with enough items already don't come to the next strategy
        items = cut_lineage(read(left).withColumn("strategy", F.lit(name)).withColumn("template", F.lit(False)))
        done = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough).select("doc_id")
        kept.append(items)
        left = left.join(done, "doc_id", "left_anti")
    live = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)
    order = F.array_position(F.lit([n for n, _ in strategies]), F.col("strategy"))
    count = live.groupBy("doc_id", "strategy").agg(F.count(F.lit(1)).alias("n")).withColumn("o", order)
    pick = count.groupBy("doc_id").agg(F.max_by("strategy", F.struct("n", (-F.col("o")).alias("o"))).alias("strategy"))
    items = learned.unionByName(live.join(pick, ["doc_id", "strategy"], "left_semi"), allowMissingColumns=True)

    per_doc = items.groupBy("doc_id", "strategy", "template").agg(F.count(F.lit(1)).alias("items"))
    again = per_doc.filter("template").join(hit.select("doc_id", "key"), "doc_id").groupBy("key").agg(F.count(F.lit(1)).alias("uses"), F.max_by("items", F.col("doc_id").cast("string")).alias("seen"))
    new = per_doc.filter("not template").join(docs.filter("signature <> ''"), "doc_id").withColumn("key", F.substring("signature", 1, 80)).groupBy("key").agg(
        F.count(F.lit(1)).alias("new_uses"), F.max_by(F.struct("signature", "strategy", "items"), F.col("doc_id").cast("string")).alias("l"))
    t = templates.join(again, "key", "left").join(new, "key", "full_outer")
    used = F.coalesce("used", F.lit(0)) + F.coalesce("uses", F.lit(0)) + F.coalesce("new_uses", F.lit(0))
    out = t.select("key", F.coalesce("l.signature", "signature").alias("signature"), F.coalesce("l.strategy", "strategy").alias("strategy"), used.cast("long").alias("used"),
                   F.coalesce(F.col("l.items"), F.col("seen"), F.col("last_items")).cast("long").alias("last_items"))
    return items, out
