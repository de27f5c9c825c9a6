"""Product catalogue: build, enrich, check and look up."""
from pyspark.sql import functions as F

from ..functions import features as P
from ..functions import rules as R
from ..functions import text as T
from ..session import cut_lineage
from .common import first_per_key, last_per_key


def drop_blocked(df, codes=R.BLOCKED_CODES):
    """a short fixed list needs no join."""
    return df.filter(~F.coalesce(F.trim("product_code").isin(codes), F.lit(False)))


def aggregate_aliases(df):
    """A1: names longest first, the type when it is single, the most common line.

    Names and lines are counted per code before they are gathered, so a code
    with very many alias rows is reduced on the map side.
    """
    code = T.drop_zeros(F.col("product_code"))
    names = df.withColumn("code", code).withColumn("alias", F.trim(T.text(F.col("alias")))).filter("alias <> ''") \
        .groupBy("code", "alias").agg(F.lit(1).alias("_one")) \
        .groupBy("code").agg(F.array_sort(F.collect_list(F.struct((-F.length("alias")).alias("k"), "alias"))).alias("_n")) \
        .select("code", F.array_join(F.col("_n.alias"), " | ").alias("aliases"))
    types = df.withColumn("code", code).withColumn("type", F.upper(F.trim(T.text(F.col("type"))))).filter("type <> ''") \
        .groupBy("code").agg(F.min("type").alias("lo"), F.max("type").alias("hi")) \
        .select("code", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("").alias("alias_type"))
    lines = df.withColumn("code", code).withColumn("line", F.trim(T.text(F.col("line")))).filter("line <> ''") \
        .groupBy("code", "line").agg(F.count("*").alias("n"), F.min("row_ord").alias("first")) \
        .groupBy("code").agg(F.min_by("line", F.struct((-F.col("n")).alias("n"), "first")).alias("alias_line"))
    out = names.join(types, "code", "full_outer").join(lines, "code", "full_outer")
    return out.select("code", *[F.coalesce(c, F.lit("")).alias(c) for c in ("aliases", "alias_type", "alias_line")])


def enrich_catalogue(cat, aliases, pdf):
    """Aliases and printed attributes beside each product, by code."""
    attrs = last_per_key(pdf.withColumn("code", T.drop_zeros(F.col("product_code"))), "code", "row_ord").select(
        "code", F.when(F.col("diameter_1_mm") > 0, F.col("diameter_1_mm")).cast("double").alias("printed_diameter_mm"),
        F.when(F.col("diameter_2_mm") > 0, F.col("diameter_2_mm")).cast("double").alias("printed_diameter_2_mm"))
    out = cat.join(aggregate_aliases(aliases), "code", "left").join(attrs, "code", "left")
    alias_category = F.try_element_at(T._map(R.ALIAS_TYPE_CATEGORY), F.col("alias_type"))
    return out.withColumn("aliases", F.coalesce("aliases", F.lit(""))).withColumn(
        "category", F.coalesce(T.nullify(F.col("category")), alias_category))


def no_aliases(cat):
    """Catalogue without side tables: the added columns are empty."""
    return cat.withColumn("aliases", F.lit("")).withColumn("alias_type", F.lit("")) \
        .withColumn("printed_diameter_mm", F.lit(None).cast("double")).withColumn("printed_diameter_2_mm", F.lit(None).cast("double"))


def build_catalogue(raw, aliases=None, pdf=None, length_fixes=None, blocked=R.BLOCKED_CODES):
    """K1: classified, corrected and enriched catalogue, one row per product row."""
    cat = drop_blocked(raw, blocked).withColumn("code", T.drop_zeros(F.col("product_code"))) \
        .withColumn("norm_description", T.norm_description(F.col("description")))
    cat = cat.withColumn("is_tube", P.is_tube(F.col("norm_description"))) \
        .withColumn("detected", P.catalogue_category(F.col("norm_description")))
    up = F.upper(T.text(F.col("description")))
    cat = cat.withColumn("category", F.coalesce("detected", F.when(up.rlike("JUNCAO|JUNC"), "JUNCAO").when(up.rlike("REDUC"), "REDUCAO"))).drop("detected")
    if length_fixes:
        fixed = F.coalesce(*[F.when(F.col("code") == k, F.lit(v)) for k, v in length_fixes.items()])
        cat = cat.withColumn("bar_length_m", F.coalesce(fixed, "bar_length_m"))
    cat = enrich_catalogue(cat, aliases, pdf) if aliases is not None else no_aliases(cat)
    return cat.withColumn("category", F.coalesce("category", F.when(T.text(F.col("description")) != "", P.category(F.col("description")))))


def complete_diameters(cat):
    """Fill both missing diameters from ``AxB`` or ``DN`` text."""
    t = T.plain_upper(F.col("description"))
    pats = [r"\bDN\s*(\d{1,3})\s*X\s*(\d{1,3})\b", r"\b(\d{1,3})\s*X\s*(\d{1,3})\s*MM\b", r"\bD\s*=?\s*(\d{1,3})\s*X\s*(\d{1,3})\b"]
    pair = F.coalesce(*[F.when(t.rlike(p), F.array(F.regexp_extract(t, p, 1).cast("double"), F.regexp_extract(t, p, 2).cast("double"))) for p in pats])
    single = F.nullif(F.regexp_extract(t, r"\bD\.?N\.?\s*(\d{2,3})(?!\d)", 1), F.lit("")).cast("double")
    empty = F.col("diameter_mm").isNull() & F.col("diameter_final_mm").isNull()
    cat = cat.withColumn("_p", F.when(empty, pair)).withColumn("_s", F.when(empty & F.col("_p").isNull(), single))
    return cat.withColumn("diameter_mm", F.coalesce(F.array_max("_p"), "_s", "diameter_mm")) \
        .withColumn("diameter_final_mm", F.coalesce(F.array_min("_p"), "diameter_final_mm")).drop("_p", "_s")


def catalogue_features(cat):
    """Every attribute a candidate is compared on, once per product row."""
    cat = cut_lineage(cat)
    cat = cat.withColumn("c_text", T.norm_text(F.col("description"))) \
        .withColumn("c_all", T.norm_text(F.concat_ws(" ", "description", "norm_description", "aliases"))) \
        .withColumn("c_board_text", T.norm_text(F.concat_ws(" ", "description", "aliases"))) \
        .withColumn("c_alias_text", T.norm_text(F.col("aliases"))).withColumn("c_norm_text", T.norm_text(F.col("norm_description"))) \
        .withColumn("c_text_category", P.category_of(F.col("c_text"))) \
        .withColumn("c_category", F.coalesce(F.upper(F.trim("category")), "c_text_category", F.lit(""))) \
        .withColumn("c_upper", F.upper(T.text(F.col("description"))))
    cc = F.col("c_category")
    texts = [P.diameters_of(F.col(c), F.nullif(cc, F.lit(""))).cast("array<double>") for c in ("c_text", "c_norm_text", "c_alias_text")]
    numeric = F.filter(F.array("diameter_final_mm", "diameter_mm", "printed_diameter_mm", "printed_diameter_2_mm"), lambda d: d > 0)
    cat = cat.withColumn("c_diameters", F.array_sort(F.array_distinct(F.concat(numeric, *texts))))
    cat = cat.withColumn("c_diameters", F.when(cc.isin(*R.ELBOWS), F.filter("c_diameters", lambda d: ~d.isin(45.0, 90.0, 180.0))).otherwise(F.col("c_diameters")))
    t, up = F.col("c_text"), F.col("c_upper")
    text_cat = F.coalesce("c_text_category", F.nullif(F.upper(F.trim("category")), F.lit("")))
    return cut_lineage(cat.select(
        "*", P.line_of(t).alias("c_line"), P.series_of(F.col("c_all")).alias("c_series"), P.angle_of(F.col("c_all"), cc).alias("c_angle"),
        P.short_long_of(t).alias("c_short_long"), P.board_size_of(F.col("c_board_text")).alias("c_board"), P.busbar_of(F.col("c_board_text")).alias("c_busbar"),
        up.rlike(r"\bPY\b").alias("c_py"), t.rlike(r"ELETROD|ELETR\.?\s*CORRUGAD|CORRUGAD").alias("c_electric"), t.contains("ESFERA").alias("c_sphere"),
        P.sliding_of(t).alias("c_sliding"), up.rlike("ULTRA|CPVC").alias("c_cpvc"), up.rlike("PEAD|POLIETILENO").alias("c_pead"), up.contains("PPR").alias("c_ppr"),
        # read from the description alone, for the conflict test
        text_cat.alias("x_category"), P.series_of(t).alias("x_series"), P.angle_of(t, text_cat).alias("x_angle"),
        P.diameters_of(t, text_cat).alias("x_diameters"), P.board_size_of(t).alias("x_board"), P.busbar_of(t).alias("x_busbar"),
        F.coalesce(F.nullif("diameter_final_mm", F.lit(0.0)), F.nullif("diameter_mm", F.lit(0.0))).alias("c_diameter_mm"),
        conflict_materials(F.col("description"), catalogue_side=True).alias("x_materials"),
        P.ptype(F.col("description")).alias("c_ptype")))


def conflict_materials(c, catalogue_side=False):
    """Materials of a description; a product line that is PVC by definition counts as PVC."""
    m = P.materials(c)
    if not catalogue_side:
        return m
    pvc = F.upper(T.text(c)).rlike(r"ROSC[ÃA]?VEL|ROSQUE[ÁA]?VEL|SOLDAVEL|\bSOLD\b|ESGOTO|\bESG\b|INCENDIO|\bFVM\b|\bPSM\b")
    return F.when((F.size(m) == 0) & pvc, F.array(F.lit("PVC"))).otherwise(m)




def lookup_by_code(items, cat, item_code, columns):
    """Catalogue data beside each line by normalised code; the first catalogue row of a code counts."""
    side = first_per_key(cat.select(F.col("code").alias("_code"), "row_ord", *columns), "_code", "row_ord").drop("row_ord")
    return items.withColumn("_code", F.when(T.text(F.col(item_code)) != "", T.drop_zeros(F.col(item_code)))).join(side, "_code", "left").drop("_code")


def read_code_map(raw):
    """Positional code map; the price text becomes a number, blank codes go."""
    return raw.withColumn("client_code", F.trim(T.text(F.col("client_code")))).withColumn("product_code", F.trim(T.text(F.col("product_code")))) \
        .filter("client_code <> '' and product_code <> ''") \
        .withColumn("price", T.br_number(F.replace("price_text", F.lit("R$"), F.lit("")), "dot"))


def join_code_map(items, code_map, columns, mode="digits"):
    """First filled code column of the line against the map; the last map row of a code counts."""
    key = [F.nullif(T.norm_code(F.col(c), mode) if mode == "digits" else F.trim(T.text(F.col(c))), F.lit("")) for c in columns]
    map_key = T.norm_code(F.col("client_code"), mode) if mode == "digits" else F.trim(T.text(F.col("client_code")))
    side = last_per_key(code_map.withColumn("_k", map_key).filter("_k <> ''").select("_k", "row_ord", F.col("product_code").alias("mapped_code"),
                        F.col("description").alias("mapped_description"), F.col("unit").alias("mapped_unit")), "_k", "row_ord").drop("row_ord")
    return items.withColumn("_k", F.coalesce(*key)).join(side, "_k", "left").drop("_k")


def price_index(table, cat):
    """Contracted products only; last price row and first catalogue row of a code count."""
    t = last_per_key(table.withColumn("_k", T.norm_code(F.col("product_code"), "int")).filter("_k <> '' and price <> 0")
                     .select("client", "_k", "row_ord", F.col("price").alias("table_price"), F.col("description").alias("table_description"), "client_code"),
                     ["client", "_k"], "row_ord").drop("row_ord")
    c = first_per_key(cat.withColumn("_k", T.norm_code(F.col("product_code"), "int")), "_k", "row_ord")
    return complete_diameters(t.join(c, "_k")).withColumnRenamed("_k", "index_code")


def check_aliases(alias, cat):
    """Does the type read from an alias agree with the product it names?"""
    side = last_per_key(cat.select(F.trim("product_code").alias("code"), "row_ord", F.coalesce(
        F.nullif(P.alias_type(F.col("description")), F.lit("")), F.upper(F.trim("category")), F.lit("")).alias("_ct"), F.lit(1).alias("_in")), "code", "row_ord").drop("row_ord")
    a = alias.withColumn("code", F.ltrim(F.trim(T.text(F.col("product_code"))), F.lit("0"))).filter("code <> ''")
    a = first_per_key(a.withColumn("_u", F.upper("alias")), ["code", "_u", "source"], "row_ord").drop("_u").withColumn("alias_type", P.alias_type(F.col("alias")))
    return a.join(side, "code", "left").withColumn("consistent", F.when(F.col("_in").isNull(), "fora_catalogo").when(
        (F.col("alias_type") == "") | (F.col("_ct") == "") | (F.col("alias_type") == F.col("_ct")), "sim").otherwise("nao")).drop("_ct", "_in")


def check_pdf_attrs(pdf, cat):
    """Does a printed gauge agree with the catalogue diameter?  First row of a code counts, repeats are noted."""
    p = pdf.withColumn("code", T.drop_zeros(F.col("product_code"))).withColumn("_g", P.gauge(F.col("gauge")))
    first = p.groupBy("code").agg(F.min_by(F.struct("gauge", "_g", "page"), "row_ord").alias("_f"),
                                  F.array_sort(F.collect_set("gauge")).alias("_all"))
    first = first.select("code", F.col("_f.gauge").alias("gauge"), F.col("_f._g.d1").alias("d1"), F.col("_f._g.d2").alias("d2"),
                         F.col("_f._g.kind").alias("kind"), F.col("_f.page").alias("page"), F.filter("_all", lambda g: g != F.col("_f.gauge")).alias("_other"))
    side = last_per_key(cat.select(F.trim("product_code").alias("_pc"), "row_ord", "diameter_mm"), "_pc", "row_ord").select(
        F.col("_pc").alias("code"), "diameter_mm", F.lit(1).alias("_in"))
    d = F.col("diameter_mm")
    near = F.coalesce(F.abs(d - F.col("d1")) < 0.01, F.lit(False)) | F.coalesce(F.abs(d - F.col("d2")) < 0.01, F.lit(False))
    none = F.col("d1").isNull() & F.col("d2").isNull()
    agrees = F.when(F.col("_in").isNull(), "fora_catalogo").when(d.isNull() & ~none, "preenche").when(d.isNull() | (none & ~near), "sem_dado") \
        .when(near, "sim").otherwise("nao")
    return first.join(side, "code", "left").withColumn("agrees", agrees).withColumn("note", F.concat_ws(
        " | ", F.when(F.col("kind") == "texto", "bitola nao numerica"),
        F.when(F.col("agrees") == "nao", F.concat(F.lit("catalogo="), T.format_qty(d), F.lit("mm"))),
        F.when(F.size("_other") > 0, F.concat(F.lit("bitola repetida: "), F.array_join("_other", ", "))))).drop("_other", "_in", "diameter_mm")


def snapshot_delta(old, new, keys):
    """Added, removed and unchanged keys, in one outer join."""
    o = old.select(*keys).distinct().withColumn("_o", F.lit(1))
    n = new.select(*keys).distinct().withColumn("_n", F.lit(1))
    return o.join(n, keys, "full_outer").select(*keys, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("unchanged").alias("change"))


def import_report(df):
    """A20."""
    return df.agg(F.countDistinct("code").alias("codes"), F.count("*").alias("rows"), F.count_if(F.col("consistent") == "nao").alias("conflicts"),
                  F.count_if(F.col("consistent") == "fora_catalogo").alias("outside"), F.countDistinct("source").alias("sources"))


def enrich_description(c):
    """K2: normalised text and what is read from it."""
    return T.let(T.norm_description(c), lambda n: F.struct(
        n.alias("norm_description"), P.category_of(n, R.CATALOGUE_CATEGORIES).alias("category"), P.is_tube(n).alias("is_tube"),
        P.first_diameter(n).alias("diameter_mm"), P.length_m(n).alias("length_m")))


def parse_alias_paths(paths):
    """K3: one alias row per code in a folder name such as ``024 025 - NAME``."""
    name = F.element_at(F.split("path", "/"), -1)
    prefix = F.element_at(F.split(name, r"\s+-\s+|\s+(?=[A-Za-zÀ-ÿ])"), 1)
    alias = F.when(name.contains(" - "), F.trim(F.regexp_replace(name, r"^.*? - ", ""))) \
        .otherwise(F.regexp_replace(F.trim(F.regexp_replace(name, r"^[\d\s\-]+", "")), r"^-\s*", ""))
    codes = F.regexp_extract_all(prefix, F.lit(r"\b0?(\d{3,4})\b"), F.lit(1))
    return paths.withColumn("alias", alias).filter("alias <> ''").withColumn("code", F.explode(codes)) \
        .withColumn("code", F.ltrim("code", F.lit("0"))).withColumn("line", P.line_from_path(F.col("path")))


def distinct_catalogue(df):
    """First row of each code, family and gauge."""
    return first_per_key(df, ["code", "family", "gauge"], "row_ord")
