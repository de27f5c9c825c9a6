"""Quantity rule, approval and sheet statuses (Q1-Q8): one narrow projection each."""
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scores as D
from ..functions import text as T


def adjust_quantity(df, qty="qty", units=("unit",), tube="is_tube", bar="bar_length_m"):
    """Q1: adjusted quantity, outcome, factor and review flag."""
    unit = F.coalesce(*[F.upper(T.nullify(F.col(u))) for u in units], F.lit(""))
    df = df.withColumn("order_unit", unit).withColumn("unit_class", T.unit_class(F.col("order_unit")))
    cls = F.col("unit_class")
    q, length = T.number_or_null(F.col(qty).cast("double")), T.number_or_null(F.col(bar).cast("double"))
    is_tube = F.coalesce(F.col(tube), F.lit(False))
    kind = (F.when(~is_tube & (cls == "DESCONHECIDA"), "ORIGINAL_NAO_TUBO_UNIDADE_DESCONHECIDA")
            .when(~is_tube, F.concat(F.lit("ORIGINAL_NAO_TUBO_"), cls))
            .when(cls == "UNIDADE", "BARRA_DIRETA_OC_UN").when(cls == "BARRA", "BARRA_DIRETA_OC_BAR")
            .when((cls == "METRO") & (length.isNull() | (length == 0)), "ERRO_TUBO_SEM_COMPRIMENTO")
            .when((cls == "METRO") & q.isNull(), "ERRO_CONVERSAO_QUANTIDADE_TUBO")
            .when((cls == "METRO") & (length < 0), "ERRO_TUBO_COMPRIMENTO_INVALIDO")
            .when((cls == "METRO") & (length < 1.0), "TUBO_COMPRIMENTO_NAO_E_BARRA_REVISAR")
            .when(cls == "METRO", "CONVERTIDO_METRO_PARA_BARRA_CEIL")
            .when(cls.isin("CAIXA", "ROLO", "KG", "LITRO"), F.concat(F.lit("TUBO_UNIDADE_"), cls, F.lit("_REVISAR")))
            .otherwise(F.concat(F.lit("UNIDADE_OC_NAO_MAPEADA("), F.col("order_unit"), F.lit(")"))))
    df = df.withColumn("quantity_kind", kind)
    kind = F.col("quantity_kind")
    converted = kind == "CONVERTIDO_METRO_PARA_BARRA_CEIL"
    return (df.withColumn("adjusted_qty", F.when(converted, F.ceil(q / length).cast("double")).otherwise(q))
            .withColumn("conversion_factor", F.when(converted, length).when(kind.startswith("BARRA_DIRETA"), F.lit(1.0)))
            .withColumn("bars_exact", F.when(converted, q / length))
            .withColumn("unit_review", kind.endswith("REVISAR") | kind.startswith("UNIDADE_OC_NAO_MAPEADA")))


def final_quantity(df):
    """Q2."""
    return (df.withColumn("final_qty", F.coalesce("adjusted_qty", "qty"))
            .withColumn("final_unit", F.coalesce(T.nullify(F.col("sale_unit")), F.lit("UN"))))


def validate(df, approved=R.APPROVED_MATCH_TYPES):
    """Q3: approval with every reason that blocks it."""
    kind = F.upper(F.trim(T.text(F.col("match_type"))))
    qty = T.number_or_null(F.col("final_qty").cast("double"))
    pct = T.number_or_null(F.col("discount_pct").cast("double"))
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("matched"), F.lit(False)), "SEM_MATCH"),
        F.when(~kind.isin(approved), F.concat(F.lit("TIPO_MATCH_NAO_APROVADO:"),
                                              F.when(kind == "", "VAZIO").otherwise(kind))),
        F.when(F.trim(T.text(F.col("product_code"))) == "", f"SEM_CODIGO_{R.SUPPLIER}"),
        F.when(qty.isNull(), "SEM_QUANTIDADE_FINAL").when(qty <= 0, "QUANTIDADE_FINAL_INVALIDA"),
        F.when(pct < 0, "DESCONTO_NEGATIVO"),
        F.when(~F.col("discount_valid") & pct.isNotNull(), "DESCONTO_INVALIDO")))
    df = df.withColumn("_reasons", reasons)
    ok = F.size("_reasons") == 0
    return (df.withColumn("approved", ok).withColumn("manual_review", ~ok)
            .withColumn("validation_reason", F.when(ok, "OK").otherwise(F.concat_ws(" | ", "_reasons")))
            .drop("_reasons"))


def validate_extraction(df):
    """Q4: status and score bounds of an extracted line."""
    desc = F.trim(T.text(F.col("description"))) != ""
    qty = F.coalesce(F.col("qty") > 0, F.lit(False))
    unit = F.trim(T.text(F.col("unit"))) != ""
    up = F.coalesce(F.col("unit_price") >= 0, F.lit(False))
    tot = F.coalesce(F.col("total") >= 0, F.lit(False))
    closes = qty & up & tot & D.almost_equal(F.col("qty") * F.col("unit_price"), F.col("total"))
    status = (F.when(F.col("interrupted"), "ok_com_ressalvas")
              .when(desc & qty & unit & up & tot & closes & (F.col("status") == "ok"), "ok")
              .when(desc & qty & unit, "ok_com_ressalvas").otherwise("duvidoso"))
    score = F.col("score")
    return (df.withColumn("total_closes", closes).withColumn("status", status)
            .withColumn("score", F.when(F.col("status") == "ok", F.greatest(score, F.lit(0.92)))
                        .when(F.col("status") == "ok_com_ressalvas", F.least(score, F.lit(0.80)))
                        .otherwise(F.least(score, F.lit(0.55)))))


def composition_codes(c):
    """Leading numbers of the parts of a suggested composition."""
    parts = F.transform(F.split(T.text(c), r"\+"), lambda p: F.regexp_extract(F.trim(p), r"^(\d+)(?:\s|$)", 1))
    return F.array_join(F.filter(parts, lambda p: p != ""), " + ")


def sheet_status(df, quotation=False):
    """Q5."""
    kind = F.upper(F.trim(T.text(F.col("match_type"))))
    has = F.coalesce(F.col("matched"), F.lit(False)) & (F.trim(T.text(F.col("product_code"))) != "")
    comp = composition_codes(F.col("composition"))
    suggest = ~has & (kind == "SUGESTAO_COMPOSICAO") & (comp != "")
    code = F.when(has, T.drop_zeros(F.col("product_code"))).when(suggest, comp).otherwise("")
    no_price = F.col("unit_price").isNull() | (F.col("unit_price") == 0)
    sale = F.upper(F.trim(T.text(F.col("sale_unit"))))
    return df.select(
        "*", code.alias("sheet_code"),
        F.when(code == "", "SEM_MATCH").when(F.col("manual_review") | suggest | kind.endswith("REVISAR"), "REVISAR")
        .otherwise("COM_MATCH").alias("sheet_status"),
        (has & kind.rlike("MRV|CODIGO") & no_price & F.lit(not quotation)).alias("price_unconfirmed"),
        F.when(has & ~sale.isin("", "PC", "UN", "NAN", "NONE"), sale).otherwise("").alias("sheet_sale_unit"))


def needs_review(df, threshold=0.75):
    """Q6."""
    score = F.coalesce(T.number_or_null(F.col("score")), F.lit(0.0))
    return df.filter((score < threshold) | (F.coalesce(F.col("match_type"), F.lit("")) == "SEM_MATCH")
                     | F.coalesce(F.col("manual_review"), F.lit(False)))


def equivalence_alert(df, alerts):
    """Q7: lines whose client code is on the alert list; the list is joined by its own key."""
    return df.withColumn("_k", T.drop_zeros(F.col("client_code"))).join(
        alerts.select(T.drop_zeros(F.col("alert_code")).alias("_k"), "alert"), "_k").drop("_k")


def unit_warning(doc_unit, table_unit):
    """Q8: only a metre against a bar or unit changes what is bought."""
    d, t = (F.upper(F.trim(x)) for x in (doc_unit, table_unit))
    differs = (d != t) & (d != "") & (t != "")
    metre = d.isin("M", "MT") | t.isin("M", "MT")
    pack = d.isin("BR", "UN") | t.isin("BR", "UN")
    return F.when(differs & metre & pack, F.concat(F.lit("unidade difere: documento "), d, F.lit(", tabela "), t))


def value_counts(df, keys, column):
    """A9."""
    return df.groupBy(*keys, column).agg(F.count("*").alias("n"))


def document_report(df):
    """A10: one row per document."""
    n = F.count_if
    return df.groupBy("doc_id").agg(
        F.count("*").alias("extracted"), n(F.col("status") == "ok").alias("ok"),
        n(F.col("status") == "ok_com_ressalvas").alias("with_reservations"),
        n(F.col("status") == "duvidoso").alias("doubtful"), n(F.col("status") == "falhou").alias("failed"),
        n(~F.col("matched")).alias("unmatched"),
        n(F.col("quantity_kind").contains("ERRO")).alias("quantity_errors"))


def drop_failed(df):
    """lines that failed extraction go; documents left with none are reported."""
    kept = df.filter(F.coalesce(F.col("status") != "falhou", F.lit(True)))
    empty = df.groupBy("doc_id").agg(F.bool_and(F.col("status") == "falhou").alias("all_failed")) \
        .filter("all_failed").select("doc_id", F.lit("todos os itens falharam na extracao").alias("reason"))
    return kept, empty
