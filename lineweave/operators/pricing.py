"""Price reconciliation between orders, price tables and returned quotes."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features as P
from ..functions import rules as R
from ..functions import scores as D
from ..functions import text as T
from ..session import cut_lineage
from .common import last_per_key, ranked

VIA_CODE = f"CÓD. {R.SUPPLIER}"
VIA_TEXT = "DESCRIÇÃO"
VIA_RETURN = "SÓ NO RETORNO"


def compare_order_quote(order, quote, keep=None):
    """Order against quote by code within a document.

    Repeated codes keep their last row on both sides; the full outer join gives
    the side statuses, the decimals give the discount and the safe price.  ``keep`` is a further column of the kept order row.
    """
    extra = [] if keep is None else [keep.alias("kept")]
    o = last_per_key(order.withColumn("code", T.norm_code(F.col("product_code"), "int_zeros")), ["doc_id", "code"], "row_ord") \
        .select("doc_id", "code", "description", "qty", F.col("price").cast(D.MONEY).alias("order_price"), F.lit(1).alias("_o"), *extra)
    q = last_per_key(quote.withColumn("code", T.norm_code(F.col("product_code"), "int_zeros")), ["doc_id", "code"], "row_ord") \
        .select("doc_id", "code", F.col("description").alias("q_description"), F.col("qty").alias("q_qty"),
                F.col("price").cast(D.MONEY).alias("quote_price"), F.lit(1).alias("_q"))
    j = o.join(q, ["doc_id", "code"], "full_outer")
    j = j.withColumn("discount", F.when(F.col("_o").isNotNull(), D.discount(F.col("quote_price"), F.col("order_price"))))
    calc = (F.col("quote_price").cast("decimal(20,6)") * (F.lit(1).cast("decimal(3,0)") - (F.col("discount") / 100).cast("decimal(12,9)"))).cast("decimal(38,12)")
    j = j.withColumn("_calc", calc)
    status = (F.when(F.col("_o").isNull(), "SEM_OC").when(F.col("_q").isNull(), "SEM_ORC")
              .when(F.col("discount").isNull(), "SEM_PRECO")
              .when(F.col("quote_price") <= F.col("order_price"), "ABAIXO").otherwise("OK"))
    return j.select(
        "doc_id", "code", F.coalesce(F.nullif("description", F.lit("")), "q_description").alias("description"),
        F.when(F.col("_o").isNotNull(), F.col("qty")).otherwise(F.col("q_qty")).alias("qty"),
        "order_price", "quote_price", "discount",
        D.safe_price(F.col("_calc"), F.col("order_price")).alias("final_price"),
        F.when(F.col("_calc") > F.col("order_price"), "Limitado pela OC").alias("note"), status.alias("status"), *[c for c in ("kept",) if extra])


def compare_priced(order, quote):
    """C1 plus stated and computed totals of each document line, from the same kept order rows."""
    check = D.total_check(F.col("qty"), F.col("price"), F.col("total"))
    c = compare_order_quote(order, quote, F.struct(F.col("total").alias("stated"), check.alias("t")))
    return c.withColumns({"stated_total": F.col("kept.stated"), "computed_total": F.col("kept.t.computed"), "total_difference": F.col("kept.t.difference")}).drop("kept")


def priced_stats(df):
    """Per-document statistics of a priced comparison."""
    n = F.count_if
    return df.groupBy("doc_id").agg(
        F.count("*").alias("total"), *[n(F.col("status") == s).alias(s.lower()) for s in ("OK", "ABAIXO", "SEM_ORC", "SEM_OC", "SEM_PRECO")],
        n(F.col("status").isin("OK", "ABAIXO")).alias("to_enter"), n(F.col("total_difference") != 0).alias("differences"),
        F.sum("stated_total").alias("document_total"))


def reject_invalid_quote(quote):
    """A quote with a repeated code or a non-finite number is rejected whole."""
    code = T.norm_code(F.col("product_code"), "int_zeros")
    bad_num = F.isnan(F.col("price").cast("double")) | F.isnan(F.col("qty").cast("double")) \
        | (F.abs(F.col("price").cast("double")) == float("inf")) | (F.abs(F.col("qty").cast("double")) == float("inf"))
    # two-step count: the first step pre-aggregates, so one huge quote is no hot group
    per_code = quote.groupBy("doc_id", code.alias("code")).agg(F.count("*").alias("n"), F.max(F.coalesce(bad_num, F.lit(True))).alias("bad"))
    bad = per_code.groupBy("doc_id").agg(F.max(F.col("n") > 1).alias("repeated"), F.max("bad").alias("not_finite")) \
        .filter("repeated or not_finite") \
        .withColumn("reason", F.when(F.col("not_finite"), "preços ou quantidades inválidos").otherwise("código repetido"))
    return quote.join(bad.select("doc_id"), "doc_id", "left_anti"), bad.select("doc_id", "reason")


def consolidate_rows(df):
    """A2: one row per product of a document; quantities add up, totals are recomputed."""
    key = F.when(F.col("product_code") != "", F.col("product_code")).otherwise(
        F.concat_ws("|", F.lit("SEM"), F.coalesce("client_code", F.lit("")), "description", F.coalesce("unit", F.lit(""))))
    g = df.withColumn("_k", key).groupBy("doc_id", "_k").agg(
        F.min("row_ord").alias("row_ord"), F.min_by("product_code", "row_ord").alias("product_code"),
        F.min_by("description", "row_ord").alias("description"), F.min_by("status", "row_ord").alias("status"),
        F.min_by("table_price", "row_ord").alias("table_price"), F.min_by("note", "row_ord").alias("note"),
        F.round(F.sum("qty"), 3).alias("qty"), F.count("*").alias("lines"),
        F.max_by("document_price", F.when(F.col("document_price").isNotNull(), F.col("row_ord"))).alias("document_price"))
    note = F.when(F.col("lines") > 1, F.concat_ws("; ", "note", F.concat(F.col("lines").cast("string"), F.lit(" linhas do documento somadas")))) \
        .otherwise(F.col("note"))
    return g.withColumn("total", F.round(F.col("qty") * F.col("table_price"), 2)).withColumn("note", note).drop("_k")


def consolidate_quote(df):
    """A3: quantities of a code add up, the first price stays; uncoded rows stay apart."""
    code = T.norm_code(F.col("product_code"), "compact")
    key = F.when(code == "", F.concat(F.lit("|"), F.col("row_ord").cast("string"))).otherwise(code)
    return df.withColumn("_k", key).groupBy("process_id", "_k").agg(
        F.min("row_ord").alias("row_ord"), F.min_by("product_code", "row_ord").alias("product_code"),
        F.min_by("description", "row_ord").alias("description"), F.round(F.sum(F.coalesce("qty", F.lit(0.0))), 3).alias("qty"),
        F.min_by("price", "row_ord").alias("price"), F.count("*").alias("lines")).drop("_k")


def consolidate_lines(df):
    """A4: a line joins the last kept line of its code when the wording is the same."""
    w = W.partitionBy("doc_id", "code").orderBy("row_ord")
    change = (F.lag("description").over(w).isNull() | (F.lag("description").over(w) != F.col("description"))).cast("int")
    run = F.when(F.col("code") == "", F.col("row_ord")).otherwise(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    coded = df.withColumn("_c", F.when(F.col("code") == "", F.lit(1)).otherwise(change)).withColumn("_run", run)
    return coded.groupBy("doc_id", "code", "_run").agg(
        F.min("row_ord").alias("row_ord"), F.min_by("description", "row_ord").alias("description"),
        F.round(F.sum("qty"), 3).alias("qty")).drop("_run")


def summary(df):
    """A5."""
    return df.groupBy("doc_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "REVISAR", "SEM")],
        F.count_if(~F.coalesce(F.col("table_price") != 0, F.lit(False))).alias("unpriced"),
        F.count_if(F.coalesce(F.col("document_price") != 0, F.lit(False))).alias("with_document_price"),
        F.round(F.coalesce(F.sum("total"), F.lit(0.0)), 2).alias("value"))


def return_row(df, bar=6.0):
    """C4: one compared row; bars priced per metre, quantity check, statuses and notes.

    Expects ``qty, unit, table_price, table_total`` of the process, ``r_qty,
    r_price, via, score`` of the return (``via`` null when nothing came back).
    """
    missing = F.col("via").isNull()
    tube = ~missing & F.upper(F.trim(F.coalesce("unit", F.lit("")))).isin("BR", "BR.")
    price = F.when(tube, F.col("table_price") * bar).otherwise(F.col("table_price"))
    df = df.withColumn("table_price", price)
    total = F.when(tube & F.col("qty").isNotNull() & F.col("table_price").isNotNull(),
                   F.round(F.col("qty") * F.col("table_price"), 2)).otherwise(F.col("table_total"))
    same = F.abs(F.col("qty") - F.col("r_qty")) <= 1e-6
    low_code = (F.col("via") == VIA_CODE) & (F.col("score") < 0.50)
    low_text = (F.col("via") == VIA_TEXT) & F.coalesce(F.col("score") < 0.80, F.lit(True))
    differs = ~missing & ~same
    notes = F.concat_ws("; ",
                        F.when(tube, "tubo: tabela em metros; comparado por barra de 6 m"),
                        F.when(missing, "sem preço no retorno"),
                        F.when(low_code, f"código {R.SUPPLIER.title()} confere, descrição do retorno muito diferente"),
                        F.when(low_text, "descrição parecida; confirme o item"),
                        F.when(differs, F.concat(F.lit("quantidade difere: processo "), T.format_qty(F.col("qty")),
                                                 F.lit(", retorno "), T.format_qty(F.col("r_qty")))))
    review = F.coalesce(low_code, F.lit(False)) | F.coalesce(low_text, F.lit(False)) | F.coalesce(differs, F.lit(False))
    return (df.withColumn("table_total", total)
            .withColumn("return_total", F.round(F.col("r_qty") * F.col("r_price"), 2))
            .withColumn("discount_pct", D.return_discount(F.col("table_price"), F.col("r_price")))
            .withColumn("qty_equal", same)
            .withColumn("status", F.when(missing, "SEM").when(review, "REVISAR").otherwise("OK"))
            .withColumn("note", F.nullif(notes, F.lit(""))))


def greedy_stream(batches):
    """Serial one-to-one choice over pairs sorted by process, row and falling score.

    Each row takes its first candidate nobody took before it.  Only the taken
    candidates of the current process are held, so a process may be any size.
    """
    process = row = None
    used, done = set(), False
    for pdf in batches:
        keep = []
        for i, (p, r, c) in enumerate(zip(pdf["process_id"], pdf["row_ord"], pdf["r_ord"])):
            if p != process:
                process, row, used = p, None, set()
            if r != row:
                row, done = r, False
            if not done and c not in used:
                used.add(c)
                done = True
                keep.append(i)
        yield pdf.iloc[keep]


def compare_return(process, returned):
    """Code first, then description over what is left, extras at the end.

    ``process``: process_id, row_ord, product_code, description, table_description,
    qty, unit, table_price, table_total.  ``returned``: process_id, row_ord,
    product_code, description, qty, price.
    """
    ret = consolidate_quote(returned).withColumnRenamed("row_ord", "r_ord") \
        .withColumn("code", T.norm_code(F.col("product_code"), "compact")) \
        .select("process_id", "r_ord", "code", F.col("description").alias("r_description"), F.col("qty").alias("r_qty"), F.col("price").alias("r_price"))
    proc = process.withColumn("code", T.norm_code(F.col("product_code"), "compact")) \
        .withColumn("text", F.coalesce(F.nullif(F.trim(T.text(F.col("table_description"))), F.lit("")), F.trim(T.text(F.col("description")))))
    # a code is unique in the return, so the first process row with it takes it
    first = ranked(proc.filter("code <> ''"), ["process_id", "code"], ["row_ord"], "_n").filter("_n = 1").drop("_n")
    by_code = first.join(ret.filter("code <> ''"), ["process_id", "code"]) \
        .withColumn("via", F.lit(VIA_CODE)) \
        .withColumn("score", D.token_set_ratio(T.plain_upper(F.col("text")), T.plain_upper(F.col("r_description"))))
    rest = proc.join(by_code.select("process_id", "row_ord"), ["process_id", "row_ord"], "left_anti")
    free = ret.join(by_code.select("process_id", "r_ord"), ["process_id", "r_ord"], "left_anti")
    by_text = _match_by_text(rest, free)
    found = by_text.withColumn("via", F.lit(VIA_TEXT))
    cols = ["process_id", "row_ord", "product_code", "text", "qty", "unit", "table_price", "table_total",
            "r_ord", "r_description", "r_qty", "r_price", "via", "score"]
    matched = by_code.select(*cols).unionByName(
        rest.join(found.select("process_id", "row_ord", "r_ord", "score", "via"), ["process_id", "row_ord"], "left")
        .join(free.drop("code"), ["process_id", "r_ord"], "left").select(*cols))
    extras = free.join(found.select("process_id", "r_ord"), ["process_id", "r_ord"], "left_anti")
    rows = return_row(matched).select(
        "process_id", "row_ord", F.coalesce("product_code", F.lit("")).alias("product_code"),
        F.coalesce(F.nullif("text", F.lit("")), "r_description", F.lit("")).alias("description"), "qty", "table_price", "table_total",
        "r_price", "return_total", "discount_pct", "qty_equal", "status", F.coalesce("via", F.lit("—")).alias("via"), "note")
    none = F.lit(None)
    extra_rows = extras.select(
        "process_id", (F.col("r_ord") + 4_000_000_000_000_000_000).alias("row_ord"), F.col("code").alias("product_code"), F.col("r_description").alias("description"),
        F.col("r_qty").alias("qty"), none.cast("double").alias("table_price"), none.cast("double").alias("table_total"), "r_price",
        F.round(F.col("r_qty") * F.col("r_price"), 2).alias("return_total"), none.cast("double").alias("discount_pct"),
        none.cast("boolean").alias("qty_equal"), F.lit("SEM").alias("status"), F.lit(VIA_RETURN).alias("via"),
        F.lit("não estava no processo guardado").alias("note"))
    return rows.unionByName(extra_rows)


def _match_by_text(rest, free, serial=200_000):
    """Description stage of C3: (process_id, row_ord, r_ord, score).

    Whether two rows may meet depends on their measures alone, so that is settled once per pair of measure sets of a
    process, and wordings are scored once per pair of texts.  The choice is the serial one, in document order, each
    return row once.  A process of up to ``serial`` pairs streams through one task; a larger one first goes through
    rounds in which every row whose best return nobody before it could still take is settled at once.
    """
    def measured(df, column):
        m = df.withColumn("m", column)
        return m.withColumn("mk", F.md5(F.to_json("m")))
    left = measured(rest.select("process_id", "row_ord", "text", F.coalesce("description", F.lit("")).alias("description")), P.typed_measures(F.concat_ws(" \n ", "text", F.coalesce("description", F.lit("")))))
    right = measured(free.select("process_id", "r_ord", "r_description"), P.typed_measures(F.col("r_description")))
    lp, rp = left.select("process_id", "mk", "m").dropDuplicates(["process_id", "mk"]), right.select("process_id", F.col("mk").alias("r_mk"), F.col("m").alias("rm")).dropDuplicates(["process_id", "r_mk"])
    ok = F.lit(True)
    for k in ("size", "inch", "dim"):
        a, b = F.col("m")[k], F.col("rm")[k]
        ok = ok & ((F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b))
    meet = lp.join(rp, "process_id").filter(ok).select("process_id", "mk", "r_mk")
    pairs = left.drop("m").join(meet, ["process_id", "mk"]).join(right.drop("m").withColumnRenamed("mk", "r_mk"), ["process_id", "r_mk"])
    pairs = cut_lineage(pairs.select("process_id", "row_ord", "r_ord", "text", "description", "r_description"))
    up = T.plain_upper
    texts = ["text", "description", "r_description"]
    score = F.greatest(D.token_set_ratio(up(F.col("text")), up(F.col("r_description"))), D.token_set_ratio(up(F.col("description")), up(F.col("r_description"))))
    scored = pairs.select(*texts).distinct().withColumn("score", score).filter("score >= 0.50")
    pairs = cut_lineage(pairs.join(scored, texts).select("process_id", "row_ord", "r_ord", "score"))
    return choose_in_order(pairs, serial)


def choose_in_order(pairs, serial=200_000):
    """The greedy choice of C3 over (process_id, row_ord, r_ord, score): rows in order, each the best return still free.

    A row's best free return is settled when no row before it has that return among its pairs: nobody can take it first.
    Such rows are settled together, they and their returns leave, and the rest goes on until a process is small enough or a
    round settles less than a tenth of its rows (rows alike that want the same returns); then it is streamed serially.
    """
    schema = "process_id string, row_ord long, r_ord long, score double"
    done = None
    while True:
        large = pairs.groupBy("process_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > serial).select("process_id")
        small = pairs.join(large, "process_id", "left_anti").repartition("process_id").sortWithinPartitions("process_id", "row_ord", F.desc("score"), "r_ord")
        if large.isEmpty():
            out = small.mapInPandas(greedy_stream, schema)
            return out if done is None else done.unionByName(out)
        out = cut_lineage(small.mapInPandas(greedy_stream, schema))
        big = pairs.join(large, "process_id", "left_semi")
        best = big.groupBy("process_id", "row_ord").agg(F.max_by(F.struct("r_ord", "score"), F.struct("score", (-F.col("r_ord")).alias("r"))).alias("b")).select("process_id", "row_ord", "b.r_ord", "b.score")
        first = big.groupBy("process_id", "r_ord").agg(F.min("row_ord").alias("row_ord"))
        settled = cut_lineage(best.join(first, ["process_id", "row_ord", "r_ord"]).select("process_id", "row_ord", "r_ord", "score"))
        done = out.unionByName(settled) if done is None else done.unionByName(out).unionByName(settled)
        slow = settled.count() * 10 < best.count()
        pairs = cut_lineage(big.join(settled.select("process_id", "row_ord"), ["process_id", "row_ord"], "left_anti").join(settled.select("process_id", "r_ord"), ["process_id", "r_ord"], "left_anti"))
        serial = 1 << 62 if slow else serial


def return_summary(df):
    """Totals only where both quantities agree."""
    both = F.col("table_price").isNotNull() & F.col("r_price").isNotNull()
    agree = both & F.coalesce(F.col("qty_equal"), F.lit(False))
    n = F.count_if
    g = df.groupBy("process_id").agg(
        F.count("*").alias("total"), *[n(F.col("status") == s).alias(s.lower()) for s in ("OK", "REVISAR", "SEM")],
        n(F.col("via") == VIA_RETURN).alias("extras"),
        n(F.col("r_price").isNull() & (F.col("via") != VIA_RETURN)).alias("without_return"),
        n(both & (F.col("qty_equal") == F.lit(False))).alias("outside_total"),
        F.round(F.coalesce(F.sum(F.when(agree, F.col("table_total"))), F.lit(0.0)), 2).alias("table_total"),
        F.round(F.coalesce(F.sum(F.when(agree, F.col("return_total"))), F.lit(0.0)), 2).alias("return_total"))
    return g.withColumn("total_discount", F.when(F.col("table_total") != 0, F.round(
        (F.col("table_total") - F.col("return_total")) / F.col("table_total") * 100, 2)))


def discount_sheet(df):
    """S15."""
    return df.filter(F.col("status").isin("OK", "ABAIXO")).select(
        "doc_id", "description", "code", "qty", F.format_string("%.5f", F.col("discount").cast("double")).alias("discount"))


def order_discount_sheet(df):
    """Order total, five-decimal discount text, capped price."""
    return df.filter(F.col("status").isin("OK", "ABAIXO")).select(
        "doc_id", "code", "description", "qty", "order_price",
        F.when((F.col("qty") != 0) & (F.col("order_price") != 0), F.round(F.col("qty").cast("decimal(18,6)") * F.col("order_price"), 2).cast("decimal(18,2)")).alias("order_total"),
        "quote_price", F.coalesce(F.format_string("%.5f", F.col("discount").cast("double")), F.lit("")).alias("discount"),
        F.coalesce(D.safe_price(F.col("final_price"), F.col("order_price")), F.col("final_price")).alias("final_price"),
        F.coalesce("note", F.lit("")).alias("note"))


def comparison_sheet(df):
    """Rows of a comparison plus one total line per document."""
    rows = df.select("doc_id", F.lit(0).alias("is_total"), "product_code", "description", "qty", "table_price", "total", "status")
    totals = df.groupBy("doc_id").agg(F.round(F.sum("total"), 2).alias("total"), F.count_if(F.col("table_price").isNull()).alias("_u")) \
        .select("doc_id", F.lit(1).alias("is_total"), F.lit("").alias("product_code"),
                F.concat(F.lit("TOTAL ("), F.col("_u").cast("string"), F.lit(" sem preço)")).alias("description"),
                F.lit(None).cast("double").alias("qty"), F.lit(None).cast("double").alias("table_price"), "total", F.lit("").alias("status"))
    return rows.unionByName(totals)


def execution_plan(df):
    """Code, description, target price, discount and quantity of approved rows."""
    return df.withColumn("product_code", T.norm_code(F.col("product_code"), "digits_zeros")).filter("product_code <> ''").select(
        "doc_id", "product_code", F.trim(T.text(F.col("description"))).alias("description"),
        *[T.br_number(F.col(c), "last").alias(c) for c in ("target_price", "discount", "qty")])


def plan_actions(plan, observed, tolerance=0.02, need_final=True, need_last=False):
    """The best action of each planned item over the rows read for its document."""
    o = observed.select("doc_id", "line_index", F.col("code").alias("read_code"), "code_valid", "last_price", "final_price",
                        "code_confidence", "last_confidence", "final_confidence") \
        .withColumn("seen", F.nullif(T.norm_code(F.col("read_code"), "digits_zeros"), F.lit(""))) \
        .withColumn("final", T.ocr_price(F.col("final_price"))).withColumn("last", T.ocr_price(F.col("last_price")))
    bad_code = ~F.coalesce(F.col("code_valid"), F.lit(False)) | F.col("seen").isNull()
    reread = F.when(bad_code, "RELER_CODIGO").when(F.lit(need_final) & F.col("final").isNull(), "RELER_PRECO_FINAL") \
        .when(F.lit(need_last) & F.col("last").isNull(), "RELER_ULT_PRECO")
    conf = F.when(bad_code, F.col("code_confidence")).when(F.lit(need_final) & F.col("final").isNull(), F.col("final_confidence")) \
        .otherwise(F.col("last_confidence"))
    # rows to read again concern every item of the document, but only the best of them
    # matters: reduce them per document before they meet the plan
    again = o.withColumn("action", reread).withColumn("confidence", conf).filter("action is not null") \
        .groupBy("doc_id").agg(F.max(F.struct("confidence", (-F.col("line_index")).alias("k"), "action")).alias("_again"))
    p = plan.withColumn("planned", T.norm_code(F.col("product_code"), "digits_zeros"))
    hits = p.join(o.filter(reread.isNull()).withColumnRenamed("seen", "planned"), ["doc_id", "planned"])
    act = F.when(F.col("target_price").isNull(), F.lit(None).cast("string")) \
        .when(F.col("final") <= F.col("target_price") + tolerance, "ITEM_OK_VALIDAR_E_SEGUIR") \
        .when(F.col("discount").isNotNull(), "APLICAR_DESCONTO")
    best = hits.withColumn("action", act).filter("action is not null") \
        .groupBy("doc_id", "planned").agg(F.min_by(F.struct("action", "line_index", "final"), "line_index").alias("_hit"))
    return (p.join(best, ["doc_id", "planned"], "left").join(again, "doc_id", "left")
            .withColumn("action", F.coalesce("_hit.action", "_again.action", F.lit("SCROLL_PROXIMA_PAGINA")))
            .withColumn("line_index", F.coalesce("_hit.line_index", (-F.col("_again.k")).cast("int")))
            .withColumn("over_target", F.round(F.col("_hit.final") - F.col("target_price"), 4))
            .drop("_hit", "_again"))


def line_action(df, tolerance=0.02):
    """C7 for one row already paired with its planned item."""
    return df.withColumn("action", F.when(F.col("seen") != F.col("planned"), "AVANCAR_PROXIMA_LINHA")
                         .when(F.col("target_price").isNull(), "VALIDAR_MANUALMENTE").when(F.col("final").isNull(), "RELER_PRECO_FINAL")
                         .when(F.col("final") <= F.col("target_price") + tolerance, "ITEM_OK_VALIDAR_E_SEGUIR")
                         .when(F.col("discount").isNull(), "CALCULAR_DESCONTO_OU_VALIDAR").otherwise("APLICAR_DESCONTO"))


def post_check(df, tolerance=0.02):
    """C7 after a discount was applied."""
    return df.withColumn("verdict", F.when(F.col("seen") != F.col("planned"), "VALIDAR_MANUALMENTE")
                         .when(F.col("final").isNull() | F.col("target_price").isNull(), "RELER_PRECO_FINAL")
                         .when(F.col("final") <= F.col("target_price") + tolerance, "SUCESSO_VALIDADO").otherwise("REAPLICAR_OU_VALIDAR"))
