"""Header fields of documents from their lines and cells (E18, E2): company, site, document, contacts and a confidence.

Every line is looked at once, with the one below it, under the rules of its document's family; what a rule finds is a row
of evidence (document, field, order of the rule, place, value).  The first evidence of a field wins, so a document's fields
are one small aggregate and no document text is put together.  A block between two markers is a range of lines, found by
windows over the markers.  Cells give evidence by their label: the value stands to its right, the last label wins.
"""
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import header_rules as H
from ..functions import text as T
from ..session import cut_lineage

FIELDS = sorted({f for rules in H.LINE_RULES.values() for f, *_ in rules} | {f for f, _ in H.CELL_LABELS} | {"delivery_span"})


def detect_family(lines):
    """(doc_id, family): by the markers on a document's first page; null where none fits.  One flag per marker and page."""
    low = F.lower("text")
    marks = sorted({m for _, needed in H.FAMILY_MARKERS for m in needed})
    flags = [f"m{i}" for i in range(len(marks))]
    pages = lines.groupBy("doc_id", "page").agg(*[F.max(low.contains(m)).alias(f) for f, m in zip(flags, marks)])
    # lines without a page are on no first page, but their document is one
    seen = pages.groupBy("doc_id").agg(F.min_by(F.struct(*flags), "page").alias("_first")).select("doc_id", "_first.*")
    fits = [(family, reduce(lambda a, b: a & b, [F.col(f"m{marks.index(m)}") for m in needed])) for family, needed in H.FAMILY_MARKERS]
    return seen.select("doc_id", F.coalesce(*[F.when(ok, family) for family, ok in fits]).alias("family"))


def _with_sections(lines):
    """Lines with ``sections``: the blocks each line stands in.  A marker inside a line starts a line of its own."""
    marks = [m for blocks in H.SECTIONS.values() for _, a, b in blocks for m in (a, b) if m]
    cut = F.regexp_replace("text", rf"(?iu)(?<=\S)\s*(?=(?:{'|'.join(sorted(set(marks)))}))", "\n")
    has_blocks = F.col("family").isin(list(H.SECTIONS))
    parts = F.when(has_blocks, F.split(cut, "\n")).otherwise(F.array("text"))
    d = lines.select("doc_id", "family", "page", "line_no", F.posexplode(parts).alias("part", "text"))
    at = F.struct("page", "line_no", "part")
    order = W.partitionBy("doc_id").orderBy("at")
    doc = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # the whole document, in the one order that all windows share
    d = d.withColumn("at", at)
    inside = []
    for family, blocks in H.SECTIONS.items():
        for name, start, end in blocks:
            key = f"{family}_{name}"
            mine = F.col("family") == family
            d = d.withColumn(f"_a_{key}", F.min(F.when(mine & F.col("text").rlike(f"(?iu){start}"), F.col("at"))).over(doc))
            if end:
                d = d.withColumn(f"_z_{key}", F.min(F.when(mine & F.col("text").rlike(f"(?iu){end}") & (F.col("at") > F.col(f"_a_{key}")), F.col("at"))).over(doc))
                inside.append(F.when((F.col("at") >= F.col(f"_a_{key}")) & (F.col("at") < F.col(f"_z_{key}")), F.lit(name)))
            else:
                inside.append(F.when(F.col("at") >= F.col(f"_a_{key}"), F.lit(name)))
    d = d.select("doc_id", "family", "page", "at", "text", F.array_compact(F.array(*inside)).alias("sections"), F.min("page").over(doc).alias("_p"))
    return d.withColumns({"two": F.concat_ws("\n", "text", F.lead("text").over(order)), "sections_below": F.lead("sections").over(order)})


def _found(seen, pattern, group):
    """``regexp_extract``, where the text holds the characters without which the pattern can't match."""
    needed = reduce(lambda a, b: a & b, [seen.contains(x) for x in H.NEEDED.get(pattern, [])], F.lit(True))
    return F.when(needed, F.regexp_extract(seen, pattern, group))


def line_evidence(lines, families):
    """(doc_id, field, prefer, at, value) from text lines, and the lines of delivery blocks (doc_id, at, value) beside them.

    A document of no known family is read by the general rules.
    """
    d = lines.select("doc_id", "page", "line_no", "text").join(families, "doc_id").withColumn("family", F.coalesce("family", F.lit("UAU")))
    d = cut_lineage(_with_sections(d.filter(F.col("family").isin(list(H.LINE_RULES)))))

    def values(family):
        out = []
        for _, pattern, group, section in H.LINE_RULES[family]:
            seen = F.col("two")
            if section:  # the block ends with its last line
                seen = F.when(F.array_contains("sections", section), F.when(F.array_contains("sections_below", section), F.col("two")).otherwise(F.col("text")))
            out.append(_found(seen, pattern, group))
        return F.array(*out)
    parts = []
    for family, rules in H.LINE_RULES.items():  # a family is one scan of its own lines with its own few patterns
        mine = d.filter((F.col("family") == family) & ((F.col("page") < F.col("_p") + H.MRV_PAGES) if family == "MRV" else F.lit(True)))
        names = [f for f, *_ in rules]
        e = mine.select("doc_id", "at", F.posexplode(values(family)).alias("prefer", "value")).filter("value <> ''")
        parts.append(e.select("doc_id", F.get(F.lit(names), F.col("prefer")).alias("field"), "prefer", "at", "value"))
    spans = d.filter((F.col("family") == "PAVINI") & F.array_contains("sections", "delivery") & (F.col("text") != "")).select("doc_id", "at", F.col("text").alias("value"))
    return reduce(lambda a, b: a.unionByName(b), parts), spans


def cell_evidence(cells, families):
    """The same from table cells of label and value: first with second column, third with fourth; the last of a label wins."""
    k = ["doc_id", "page", "table_no", "row_no"]
    c = cells.join(families.filter("family = 'SIENGE'").select("doc_id"), "doc_id", "left_semi").withColumn("_v", T.squash(T.text(F.col("text"))))
    pair = c.filter("col_no < 4").withColumn("_side", F.floor(F.col("col_no") / 2)).groupBy(*k, "_side").agg(
        F.max(F.when(F.col("col_no") % 2 == 0, F.lower("_v"))).alias("label"), F.max(F.when(F.col("col_no") % 2 == 1, F.col("_v"))).alias("value"))
    pair = pair.filter("label <> '' and value <> ''")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("prefer"), F.lit(label).alias("label")) for f, labels in H.CELL_LABELS for i, label in enumerate(labels)])
    known = sorted({x for _, labels in H.CELL_LABELS for x in labels})
    at = F.struct((-F.col("page")).alias("page"), (-(F.col("table_no") * 1000000 + F.col("row_no"))).alias("line_no"), (-F.col("_side")).cast("int").alias("part"))
    mine = F.filter(fields, lambda x: x["label"] == F.col("label"))
    return pair.filter(F.col("label").isin(known)).select("doc_id", at.alias("at"), "value", F.explode(mine).alias("e")).select("doc_id", "e.field", "e.prefer", "at", "value")


def gather(evidence, spans):
    """(doc_id, one column per field): the first evidence of each field.  Fields are few, so a document's rows are too."""
    order = F.struct("prefer", "at")
    first = evidence.groupBy("doc_id", "field").agg(F.min_by("value", order).alias("value"))
    spans = spans.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy("at"))).filter(f"_n <= {H.DELIVERY_SPAN}")
    span = spans.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    both = first.unionByName(span.select("doc_id", F.lit("delivery_span").alias("field"), "value"))
    return both.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])


def _clean(c):
    return F.coalesce(T.squash(c), F.lit(""))


def _split_site(c):
    """Leading number and name of ``123 - name``."""
    c = _clean(c)
    p = r"^(\d+)\s*[-–]\s*(.+)$"
    return F.struct(F.regexp_extract(c, p, 1).alias("code"), F.when(c.rlike(p), F.trim(F.regexp_extract(c, p, 2))).otherwise(c).alias("name"))


def _cut(c, pattern):
    return F.trim(F.regexp_replace(_clean(c), pattern, ""))


def _amount(c, drop=r"\."):
    return F.replace(F.regexp_replace(c, drop, ""), F.lit(","), F.lit(".")).try_cast("double")


def _contact(name, role, email, phone, origin, keep):
    made = F.struct(name.alias("name"), F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), email.alias("email"), phone.alias("phone"), F.lit(origin).alias("origin"))
    return F.when(keep, made)


def _record(g):
    """Columns of the result by family, from the gathered fields."""
    c = F.col
    none = F.lit("")
    mail, phone = F.lower(_clean(c("email"))), T.digits(F.coalesce("phone", none))
    has = lambda f: F.coalesce(F.col(f) != "", F.lit(False))
    split = _split_site(c("site"))
    address, delivery = T.parse_address(F.coalesce("address", none)), T.parse_address(F.coalesce("delivery", none))
    out = {}

    out["SIENGE"] = {
        "name": _clean(c("name")), "tax_id": T.digits(F.coalesce("tax_id", none)), "state_id": _clean(c("state_id")), "address": _clean(c("address")), "city": address["city"], "state": address["state"],
        "postcode": address["postcode"], "phone": phone, "email": mail, "site_code": split["code"], "site_name": split["name"], "delivery": _clean(c("delivery")), "site_city": delivery["city"],
        "site_state": delivery["state"], "site_postcode": delivery["postcode"], "number": _clean(c("number")), "date": _clean(c("date")), "kind": F.when(has("is_quote"), "COTACAO").otherwise("OC"),
        "total": _amount(c("total"), r"[^\d,]"), "terms": _clean(c("terms")), "system": F.lit("SIENGE"),
        "contacts": F.array(_contact(none, F.when(mail.contains("financeiro"), "financeiro").otherwise("compras"), mail, phone, "cabecalho_pdf_sienge", has("email")),
                            _contact(_clean(c("person")), "contato", none, none, "cabecalho_pdf_sienge", has("person") & ~F.array_contains(c("own_people"), F.lower("person"))))}

    out["UAU"] = {
        "name": _clean(c("name")), "tax_id": T.digits(F.coalesce("tax_id", none)), "address": _clean(c("address")), "city": address["city"], "state": address["state"], "postcode": address["postcode"],
        "phone": phone, "email": mail, "site_code": split["code"], "site_name": split["name"], "delivery": _clean(c("delivery")), "site_city": delivery["city"], "site_state": delivery["state"],
        "site_postcode": delivery["postcode"], "number": _clean(c("number")), "date": _clean(c("date")), "kind": F.when(has("is_quote"), "COTACAO").otherwise("OC"), "system": F.lit("UAU"),
        "contacts": F.array(_contact(none, "contato", mail, phone, "cabecalho_pdf_uau", has("email")))}

    city = F.coalesce(F.element_at(F.split(_clean(c("city")), " "), -1), none)
    state, postcode = F.upper(_clean(c("state"))), T.digits(F.coalesce("postcode", none))
    invoice = F.lit(H.MRV_INVOICE_EMAIL)
    out["MRV"] = {
        "name": F.trim(F.coalesce("name", none)), "tax_id": F.coalesce("tax_id", none), "state_id": F.coalesce("state_id", none), "address": _clean(c("address")), "city": city, "state": state,
        "postcode": postcode, "email": invoice, "site_name": F.coalesce(F.nullif(_clean(c("site")), none), _clean(c("residence"))), "delivery": _cut(c("delivery"), r"(?iu)\s*USU[ÁA]RIO.*$"),
        "site_city": F.when(has("site_city"), _clean(c("site_city"))).otherwise(city), "site_state": F.when(has("site_city"), F.upper(_clean(c("site_state")))).otherwise(state),
        "site_postcode": F.coalesce("site_postcode", none), "number": F.coalesce("number", none), "date": F.replace(F.coalesce("date", none), F.lit("."), F.lit("/")), "kind": F.lit("OC"),
        "total": _amount(c("total")), "terms": F.when(has("terms"), F.concat("terms", F.lit(" dias"))).otherwise(H.MRV_DEFAULT_TERMS), "system": F.lit("MRV"),
        "contacts": F.array(_contact(none, "nf_eletronica", invoice, none, "cabecalho_pdf_mrv", F.lit(True)),
                            _contact(_clean(c("person")), "contato_krona", none, T.digits(F.coalesce("person_phone", none)), "cabecalho_pdf_mrv", has("person")))}

    field = lambda f: _cut(c(f), r"(?i)\s*Bairro\s*$")
    town = _cut(c("city"), r"(?i)\s*CEP.*$")
    parsed = T.parse_address(town)
    town_name = F.coalesce(F.nullif(parsed["city"], none), _clean(F.get(F.split(town, "-"), F.lit(0))))
    site = _cut(F.coalesce(F.nullif(_clean(c("site")), none), c("site_unit")), r"(?i)\s+OC\s*N.*$")
    postal = T.digits(F.coalesce("postcode", none))
    buyer, supplier = F.lower(F.trim(F.coalesce("buyer_email", none))), F.lower(F.trim(F.coalesce("supplier_email", none)))
    invoice_mail = F.lower(F.trim(F.coalesce("email", none)))
    out["BRASAL"] = {
        "name": field("name"), "tax_id": T.digits(_cut(c("tax_id"), r"(?i)\s*I\.?E\..*$")), "state_id": field("state_id"), "address": field("address"), "district": field("district"), "city": town_name,
        "state": parsed["state"], "postcode": postal, "email": invoice_mail, "site_code": F.trim(F.coalesce("site_code", none)), "site_name": site, "delivery": field("delivery"),
        "site_city": parsed["city"], "site_state": parsed["state"], "site_postcode": postal, "number": F.coalesce("number", none), "date": F.coalesce("date", none), "kind": F.lit("OC"),
        "total": _amount(c("total")), "terms": F.coalesce("terms", none), "system": F.lit("BRASAL"),
        "contacts": F.array(_contact(none, "cobranca", invoice_mail, none, "cabecalho_pdf_brasal_faturamento", has("email")),
                            _contact(_clean(c("buyer")), "responsavel_compras", buyer, none, "rodape_pdf_brasal", has("buyer_email")),
                            _contact(none, "representante", supplier, T.digits(F.coalesce("supplier_phone", none)), "cabecalho_pdf_brasal_fornecedor", has("supplier_email")))}

    span = F.regexp_extract("delivery_span", r"(?iu)ENDERE[CÇ]O ENTREGA[:\s]*\nEndere[cç]o:\s*([^\n]{10,200}(?s:.*))", 1)
    whole = F.regexp_replace(T.squash(F.substring(span, 1, H.DELIVERY_SPAN)), r"\s*,\s*$", "")
    where = F.coalesce(F.nullif(whole, none), _clean(c("address")))
    buyer_mail, office = F.lower(F.trim(F.coalesce("email", none))), F.lower(F.trim(F.coalesce("office_email", none)))
    place = {"city": _clean(c("city")), "state": F.upper(F.coalesce("state", none)), "postcode": postal}
    out["PAVINI"] = {
        "name": _clean(F.get(F.split("name", "Endereço"), F.lit(0))), "tax_id": F.coalesce("tax_id", none), "address": where, **place, "site_code": split["code"], "site_name": split["name"],
        "delivery": where, "site_city": place["city"], "site_state": place["state"], "site_postcode": postal, "number": F.trim(F.coalesce("number", none)), "date": F.trim(F.coalesce("date", none)),
        "kind": F.lit("OC"), "total": _amount(c("total")), "terms": _cut(c("terms"), r"(?i)\s*Forma.*$"), "forecast": F.coalesce("forecast", none), "system": F.lit("PAVINI"),
        "contacts": F.array(_contact(F.lit(H.PAVINI_BUYER), "comprador", buyer_mail, phone, "cabecalho_pdf_pavini", has("email")),
                            _contact(F.lit(H.PAVINI_OFFICE), "contato_geral", office, phone, "cabecalho_pdf_pavini", has("office_email") & (office != buyer_mail)),
                            _contact(_clean(c("seller")), "vendedor_krona", none, none, "cabecalho_pdf_pavini", has("seller")))}
    return out


COLUMNS = ["name", "tax_id", "state_id", "address", "district", "city", "state", "postcode", "phone", "email", "site_code", "site_name", "delivery", "site_city", "site_state", "site_postcode",
           "number", "date", "kind", "total", "terms", "forecast", "system", "contacts"]


def extract_headers(lines, cells=None, own_people=()):
    """One row per document with lines: company, site, document, contacts, confidence, review, format.

    ``lines`` (doc_id, page, line_no, text), ``cells`` (doc_id, page, table_no, row_no, col_no, text).  Confidence is the
    share of a family's evidence fields that were found, two decimals; below ``MINIMUM_CONFIDENCE`` a document goes to
    review.  Missing text fields are empty, a missing total is null.  ``own_people`` are contact names that are ours.
    """
    families = cut_lineage(detect_family(lines))
    evidence, spans = line_evidence(lines, families)
    if cells is not None:
        evidence = evidence.unionByName(cell_evidence(cells, families))
    g = families.join(gather(evidence, spans), "doc_id", "left").withColumn("own_people", F.array(*[F.lit(p.lower()) for p in own_people]).cast("array<string>"))
    by = _record(g)
    reader = F.coalesce("family", F.lit("UAU"))
    kind = {"total": "double", "contacts": "array<struct<name:string,role:string,email:string,phone:string,origin:string>>"}

    def column(name):
        empty = F.lit(None).cast(kind[name]) if name in kind else F.lit("")
        chain = reduce(lambda a, f: a.when(reader == f, by[f].get(name, empty)), by, F)
        return F.array_compact(chain).cast(kind[name]) if name == "contacts" else chain.cast(kind.get(name, "string"))
    raw = [F.coalesce(f, F.lit("")).alias(f"_{f}") for f in ("tax_id", "phone", "email")]
    r = g.select("doc_id", "family", reader.alias("_reader"), *raw, *[column(n).alias(n) for n in COLUMNS])
    seen = {"site": F.col("site_name") != "", "total": F.coalesce(F.col("total") != 0, F.lit(False)), "tax_id": F.col("_tax_id") != "", "phone": F.col("_phone") != "", "email": F.col("_email") != ""}
    share = reduce(lambda a, f: a.when(F.col("_reader") == f, F.bround(sum((F.coalesce(seen.get(x, F.col(x) != ""), F.lit(False)).cast("int") for x in H.EVIDENCE[f]), F.lit(0)) / len(H.EVIDENCE[f]), 2)),
                   H.EVIDENCE, F)
    r = r.withColumn("confidence", share)
    company = F.struct("name", "tax_id", "state_id", "address", "district", "city", "state", "postcode", "phone", "email")
    site = F.struct(F.col("site_code").alias("code"), F.col("site_name").alias("name"), F.col("delivery").alias("delivery_address"), F.col("site_city").alias("city"), F.col("site_state").alias("state"),
                    F.col("site_postcode").alias("postcode"))
    document = F.struct("number", "date", "kind", "total", "terms", "forecast", "system")
    return r.select("doc_id", F.coalesce("family", F.lit("DESCONHECIDO")).alias("format"), company.alias("company"), site.alias("site"), document.alias("document"), "contacts", "confidence",
                    (F.col("confidence") < H.MINIMUM_CONFIDENCE).alias("review"))


def register_rows(headers):
    """Headers as the rows that the register's resolution takes."""
    first_mail = F.coalesce(F.get(F.filter(F.transform("contacts", lambda x: x["email"]), lambda x: x != ""), F.lit(0)), F.lit(""))
    return headers.select(F.col("doc_id").alias("header_id"), "company.name", "company.tax_id", F.col("site.name").alias("site_name"), F.col("site.code").alias("site_code"), first_mail.alias("email"),
                          "company.city", F.col("document.number").alias("doc_number"), F.col("document.system").alias("doc_system"), "confidence")
