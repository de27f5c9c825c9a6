"""Description linkage of order texts to catalogue products.

Shape of the job: every distinct order wording is described once by its
attributes; wordings with the same attributes share a *profile*, and so do
products.  Which products survive the attribute filters depends on the two
profiles alone, so that question is answered on profile pairs, which are few
however long the tables are.  Texts are compared only for the survivors, and once
per class of products that differ in nothing but their code and place.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features as P
from ..functions import rules as R
from ..functions import scores as D
from ..functions import text as T
from ..session import cut_lineage
from .catalogue import conflict_materials
from .common import ranked, soft_rank

I_PROFILE = ["category", "diameters", "material", "subcategory", "angle", "line", "board", "busbar", "short_long",
             "sliding", "reduction", "wants_py", "wants_electric", "sphere"]
C_PROFILE = ["c_category", "c_diameters", "c_line", "c_series", "c_angle", "c_short_long", "c_board", "c_busbar", "c_py",
             "c_electric", "c_sphere", "c_sliding", "c_cpvc", "c_pead", "c_ppr"]


def item_features(texts, column="description"):
    """Attributes of each distinct order wording, cleaned (for matching) and raw (for conflicts)."""
    t = texts.withColumn("clean", T.clean_for_match(F.col(column))).withColumn("raw", T.norm_text(F.col(column))) \
        .withColumn("category", P.category_of(F.col("clean"))).withColumn("r_category", P.category_of(F.col("raw")))
    c, r, cat = F.col("clean"), F.col("raw"), F.col("category")
    t = t.select(
        "*", P.diameters_of(c, cat).cast("array<double>").alias("diameters"), P.material_of(c).alias("material"),
        P.subcategory_of(c).alias("subcategory"), P.angle_of(c, cat).alias("angle"), P.line_of(c).alias("line"),
        F.when(cat == "QUADRO", P.board_size_of(c)).alias("board"), P.busbar_of(c).alias("busbar"), P.short_long_of(c).alias("short_long"),
        P.sliding_of(c).alias("sliding"), P.is_reduction_of(c).alias("reduction"), c.contains("PY").alias("wants_py"),
        c.rlike(r"ELETROD|ELETR\b|CORRUGAD|CONDULETE").alias("wants_electric"), c.contains("ESFERA").alias("sphere"),
        F.size(F.filter(F.split(c, " "), lambda w: F.length(w) > 1)).alias("n_tokens"), D.sort_words(c).alias("clean_words"),
        conflict_materials(F.col(column)).alias("r_materials"), P.line_of(r).alias("r_line"), P.short_long_of(r).alias("r_short_long"),
        P.subcategory_of(r).alias("r_subcategory"), P.angle_of(r, F.col("r_category")).alias("r_angle"),
        P.diameters_of(r, F.col("r_category")).alias("r_diameters"), P.board_size_of(r).alias("r_board"), P.busbar_of(r).alias("r_busbar"),
        r.contains("ESFERA").alias("r_sphere"))
    t = t.withColumn("anchors", P.anchors(F.col("category"), F.col("diameters"), F.col("subcategory"), F.col("angle")))
    return cut_lineage(t.withColumn("profile", _key(I_PROFILE)))


def _key(cols):
    return F.md5(F.to_json(F.struct(*cols)))


def with_profile(cat_features):
    return cat_features.withColumn("c_profile", _key(C_PROFILE))


def families_compatible(a, b, a_sphere, b_sphere):
    """F8."""
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    same = (a == b) | (a.isin(*R.ELBOWS) & b.isin(*R.ELBOWS)) | (a.isin("REDUCAO", "BUCHA") & b.isin("REDUCAO", "BUCHA"))
    valves = (a != b) & a.isin("REGISTRO", "VALVULA") & b.isin("REGISTRO", "VALVULA") & a_sphere & b_sphere
    return ~known | same | valves


def block_keys():
    """Category keys; a text with no category meets products by measure, else by line."""
    c = F.col("category")
    fam = F.when(c.isin(*R.ELBOWS), F.array(F.lit("C:JOELHO"), F.lit("C:CURVA"))) \
        .when(c.isin("REDUCAO", "BUCHA"), F.array(F.lit("C:REDUCAO"), F.lit("C:BUCHA"))).otherwise(F.array(F.concat(F.lit("C:"), c)))
    by_measure = F.array(F.concat(F.lit("D:"), F.element_at("diameters", 1).cast("string")), F.lit("D:none"))
    by_line = F.array(F.concat(F.lit("L:"), F.col("line")), F.lit("L:none"))
    none = F.array().cast("array<string>")
    return F.when(c.isNotNull(), fam).when(F.size("diameters") > 0, by_measure).when(F.col("line").isNotNull(), by_line).otherwise(none)


def catalogue_keys():
    cat = F.when(F.col("c_category") != "", F.array(F.concat(F.lit("C:"), F.col("c_category"))))
    diam = F.when(F.size("c_diameters") > 0, F.transform("c_diameters", lambda d: F.concat(F.lit("D:"), d.cast("string")))).otherwise(F.array(F.lit("D:none")))
    line = F.array(F.coalesce(F.concat(F.lit("L:"), F.col("c_line")), F.lit("L:none")))
    return F.concat(F.coalesce(cat, F.array().cast("array<string>")), diam, line)


def subset(a, b):
    return F.size(F.array_except(a, b)) == 0


def filter_tests():
    """F2-F6 as an ordered list of soft tests over a profile pair."""
    cat, d, cd = F.col("category"), F.col("diameters"), F.col("c_diameters")
    yes = F.lit(True)
    has_d = F.size(d) > 0
    mat = F.when(F.col("material") == "CPVC", F.col("c_cpvc")).when(F.col("material") == "PEAD", F.col("c_pead")).when(F.col("material") == "PPR", F.col("c_ppr")).otherwise(yes)
    want = F.when(F.col("subcategory") == "REFORCADA", "REFORCADA").when(F.col("subcategory") == "ESGOTO", "NORMAL")
    elbow = F.coalesce(cat.isin(*R.ELBOWS), F.lit(False))
    single = has_d & (F.size(d) == 1) & cat.isin(*R.TWO_MEASURE_CATEGORIES) & ~F.col("reduction")

    def when(cond, test):
        return F.when(F.coalesce(cond, F.lit(False)), F.coalesce(test, F.lit(False))).otherwise(yes)

    return [
        when(~F.col("wants_py"), ~F.col("c_py")),
        when(~F.col("wants_electric"), ~F.col("c_electric")),
        when(cat.isin("REGISTRO", "VALVULA"), F.col("c_category") == cat),
        when(cat == "LUVA", F.col("c_sliding") == F.col("sliding")),
        when(has_d, F.when(F.size(d) >= 2, subset(d, cd)).otherwise((F.size(cd) == 0) | F.arrays_overlap(d, cd))),
        when(single, F.size(cd) <= 1),
        mat,
        when(want.isNotNull(), F.col("c_series") == want),
        when(elbow & F.col("angle").isNotNull(), F.col("c_angle").isNull() | (F.col("c_angle") == F.col("angle"))),
        when(F.col("short_long").isNotNull(), F.col("c_short_long").isNull() | (F.col("c_short_long") == F.col("short_long"))),
        when(F.col("board").isNotNull(), F.col("c_board").isNull() | (F.col("c_board") == F.col("board"))),
    ]


def is_structural():
    """no hard contradiction between an order text and a product."""
    cat, d, cd = F.col("category"), F.col("diameters"), F.col("c_diameters")

    def clash(a, b):
        return F.coalesce(a != b, F.lit(False))

    fam = families_compatible(cat, F.col("c_category"), F.col("sphere"), F.col("c_sphere"))
    diam = F.when(F.size(d) >= 2, (F.size(cd) > 0) & subset(d, cd)).when(F.size(d) == 1, (F.size(cd) == 0) | F.arrays_overlap(d, cd)).otherwise(True)
    ser = F.when(F.col("subcategory") == "REFORCADA", F.coalesce(F.col("c_series") == "REFORCADA", F.lit(False))) \
        .when(F.col("subcategory") == "ESGOTO", F.coalesce(F.col("c_series") == "NORMAL", F.lit(False))).otherwise(True)
    elbow = F.coalesce(cat.isin(*R.ELBOWS), F.lit(False))
    board = F.coalesce(cat == "QUADRO", F.lit(False))
    return F.coalesce(fam, F.lit(False)) & ~clash(F.col("line"), F.col("c_line")) & diam & ser & ~(elbow & clash(F.col("angle"), F.col("c_angle"))) \
        & ~clash(F.col("short_long"), F.col("c_short_long")) \
        & ~(board & (clash(F.col("board"), F.col("c_board")) | clash(F.col("busbar"), F.col("c_busbar"))))


def profile_pairs(items, cat, scope=()):
    """Surviving profile pairs after the soft filters, with the structural verdict.

    ``scope`` names columns both sides share (a client, say) when the pool of
    products differs between groups of items.
    """
    ip = items.select(*scope, "profile", *I_PROFILE).dropDuplicates([*scope, "profile"]).withColumn("_k", F.explode(block_keys()))
    cp = cat.select(*scope, "c_profile", *C_PROFILE).dropDuplicates([*scope, "c_profile"]).withColumn("_k", F.explode(catalogue_keys()))
    pairs = ip.join(cp, [*scope, "_k"]).dropDuplicates([*scope, "profile", "c_profile"])
    # REGISTRO and VALVULA share no block, so "ESFERA" only narrows the pool when no exact category exists
    pairs = pairs.withColumn("_rank", soft_rank(filter_tests())).withColumn("structural", is_structural())
    best = F.max("_rank").over(W.partitionBy(*scope, "profile"))
    return pairs.withColumn("_best", best).filter("_rank = _best").select(*scope, "profile", "c_profile", "structural", bonus().alias("bonus"))


def bonus():
    """D6 over the attributes of a pair; all of them belong to the profiles."""
    p = {k: F.col(k) for k in ("category", "diameters", "angle", "subcategory", "line", "board", "c_category", "c_diameters", "c_angle", "c_series", "c_line", "c_board")}
    p["family_ok"] = families_compatible(F.col("category"), F.col("c_category"), F.col("sphere"), F.col("c_sphere"))
    return D.attribute_bonus(p)


def candidates(items, cat, scope=()):
    """Item texts against surviving products: one row per (text, product)."""
    pp = profile_pairs(items, cat, scope)
    return items.join(pp, [*scope, "profile"]).join(cat, [*scope, "c_profile"])


def score_pairs(pairs):
    """D5 + D6: textual score plus attribute bonus (``bonus`` where the profiles told it), four decimals, capped at 1."""
    skip = {"c_text": F.col("c_text") == "", "c_norm_text": F.col("c_norm_text").isin("") | (F.col("c_norm_text") == F.col("c_text")), "c_alias_text": F.col("c_alias_text") == ""}
    best = D.best_blended_ratio(F.col("clean"), F.col("clean_words"), [(F.col(c), F.col(c + "_words"), no) for c, no in skip.items()])
    pairs = pairs.withColumn("text_score", F.round(best, 4))
    extra = F.col("bonus") if "bonus" in pairs.columns else bonus()
    return pairs.withColumn("score", F.round(F.least(F.lit(1.0), F.col("text_score") + extra), 4))


def best_candidate(pairs, item, score="score"):
    """Best product per item, catalogue order on ties, gap to the second, sole flag."""
    w = W.partitionBy(*item).orderBy(F.desc(score), "row_ord")
    return pairs.withColumn("_rn", F.row_number().over(w)).withColumn("second", F.lead(score).over(w)) \
        .withColumn("n_candidates", F.count("*").over(W.partitionBy(*item))).filter("_rn = 1").drop("_rn") \
        .withColumn("gap", F.col(score) - F.col("second")).withColumn("sole", F.col("n_candidates") == 1)


def product_classes(cat, keep=2):
    """Products that differ in nothing but code and place as one row: ``n`` of them, and as ``members`` the first ``keep``.

    All members meet a text with the same score, so the best ``k`` of a text are among the first ``k`` of each class.
    """
    own = [c for c in cat.columns if c not in PLACE]
    place = [c for c in cat.columns if c in PLACE]
    c = cat.withColumn("c_class", F.md5(F.to_json(F.struct(*own), {"ignoreNullFields": "false"})))
    first = ranked(c, ["c_class"], ["row_ord"], "_n").filter(F.col("_n") <= keep).groupBy("c_class").agg(
        F.min_by(F.struct(*own), "_n").alias("_c"), F.array_sort(F.collect_list(F.struct("_n", *place))).alias("members"))
    return cut_lineage(first.join(c.groupBy("c_class").agg(F.count("*").alias("n")), "c_class").select("c_class", "n", "members", "_c.*"))


def scored_classes(items, classes, key, scope=()):
    """Texts against the classes of their structural products, narrow: (``key``, c_class, n, members, text_score, score)."""
    pp = profile_pairs(items, classes, scope).filter("structural").select(*scope, "profile", "c_profile", "bonus")
    pairs = items.join(pp, [*scope, "profile"]).join(classes, [*scope, "c_profile"])
    return score_pairs(pairs).select(*key, "c_class", "n", "members", "text_score", "score")


def each_member(scored):
    """One row per kept product of each class."""
    return scored.select("*", F.explode("members").alias("_m")).select(*[c for c in scored.columns if c not in ("members", "n")], "_m.*").drop("_n")


def best_class(scored, items, classes, key):
    """``best_candidate`` over ``scored_classes``: one row per text, with all columns of the text and its product."""
    w = W.partitionBy(*key).orderBy(F.desc("score"), F.col("members")[0]["row_ord"])
    b = scored.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).withColumn("n_candidates", F.sum("n").over(W.partitionBy(*key))) \
        .filter("_rn = 1").withColumn("second", F.when(F.col("n") > 1, F.col("score")).otherwise(F.col("_next")))
    b = b.select(*key, "c_class", "text_score", "score", "second", "n_candidates", (F.col("score") - F.col("second")).alias("gap"), (F.col("n_candidates") == 1).alias("sole"), F.col("members")[0].alias("_m")) \
        .select("*", "_m.*").drop("_m", "_n")
    return b.join(items, key).join(classes.drop("members", "n", *[c for c in key if c in classes.columns]), "c_class")


def near_tie(margin=0.02):
    """W2."""
    return F.coalesce(F.col("gap") < margin, F.lit(False))


def top_candidates(pairs, item, k=3, score="score"):
    """``code description (score)`` of the best ``k``, best first."""
    w = W.partitionBy(*item).orderBy(F.desc(score), "row_ord")
    part = F.concat(F.trim("product_code"), F.lit(" "), F.col("c_description"), F.lit(" ("), F.format_string("%.2f", F.col(score)), F.lit(")"))
    return pairs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).groupBy(*item).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", part.alias("s")))), lambda x: x["s"]), " | ").alias("candidates"))


def shortlist(pairs, item, k=15, score="score"):
    """The best ``k`` per item for an outside decision."""
    w = W.partitionBy(*item).orderBy(F.desc(score), "row_ord")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_conflict(cat_col="x_category"):
    """the product contradicts family, line, series, angle, measure or material of the order text."""
    def both(a, b, test):
        return F.coalesce(a.isNotNull() & b.isNotNull() & test, F.lit(False))
    mo, mc = F.col("r_materials"), F.col("x_materials")
    co, cc = F.col("r_category"), F.col(cat_col)
    do, dc = F.col("r_diameters"), F.col("x_diameters")
    num = T.number_or_null(F.col("c_diameter_mm"))
    two = (F.size(do) >= 2) & F.coalesce(co.isin(*R.TWO_MEASURE_CATEGORIES), F.lit(False))
    inside = F.when(F.size(dc) > 0, subset(do, dc)).otherwise(F.coalesce(F.array_contains(do.cast("array<double>"), num), F.lit(False)))
    near = F.exists(do, lambda m: F.abs(num - m) <= F.greatest(F.lit(1.0), m * 0.05))
    board = F.coalesce(co == "QUADRO", F.lit(False))
    a, xa = F.col("r_angle"), F.col("x_angle")
    return ((F.size(mo) > 0) & (F.size(mc) > 0) & ~F.arrays_overlap(mo, mc)) \
        | ~F.coalesce(families_compatible(co, cc, F.col("r_sphere"), F.col("c_sphere")), F.lit(True)) \
        | both(F.col("r_line"), F.col("c_line"), F.col("r_line") != F.col("c_line")) \
        | both(F.col("r_short_long"), F.col("c_short_long"), F.col("r_short_long") != F.col("c_short_long")) \
        | both(F.col("r_subcategory"), F.col("x_series"), ((F.col("r_subcategory") == "REFORCADA") & (F.col("x_series") != "REFORCADA"))
               | ((F.col("r_subcategory") == "ESGOTO") & (F.col("x_series") != "NORMAL"))) \
        | both(a, xa, a != xa) \
        | ((F.size(do) > 0) & (F.size(dc) > 0) & ~F.arrays_overlap(do, dc)) \
        | (two & ~inside) \
        | ((F.size(do) > 0) & F.coalesce(num > 0, F.lit(False)) & ~near) \
        | (board & (both(F.col("r_board"), F.col("x_board"), F.col("r_board") != F.col("x_board"))
                    | both(F.col("r_busbar"), F.col("x_busbar"), F.col("r_busbar") != F.col("x_busbar"))))


PLACE = ("row_ord", "product_code", "index_code")  # what tells products of a class apart
C_COLS = ["row_ord", "product_code", "description as c_description", "c_profile", "c_text", "c_norm_text", "c_alias_text",
          "c_category", "c_diameters", "c_line", "c_series", "c_angle", "c_short_long", "c_board", "c_busbar", "c_py", "c_electric", "c_sphere", "c_sliding", "c_cpvc",
          "c_pead", "c_ppr", "x_category", "x_series", "x_angle", "x_diameters", "x_board", "x_busbar", "x_materials", "c_diameter_mm", "c_ptype"]


def candidate_side(cat, extra=()):
    """The candidate columns of a featured catalogue, under names the order side does not use."""
    side = with_profile(cat).selectExpr(*C_COLS, *extra)
    return cut_lineage(side.withColumns({t + "_words": D.sort_words(F.col(t)) for t in ("c_text", "c_norm_text", "c_alias_text")}))


def match_description(items, cat, key=("description",), scope=()):
    """M6 + M7: best product of each order text, score floor, near tie, conflict gate.

    ``items`` come from ``item_features``; one row per key.
    """
    key = [*scope, *key]
    classes = product_classes(cat, 3)
    scored = cut_lineage(scored_classes(items, classes, key, scope))
    best = best_class(scored, items, classes, key)
    tops = top_candidates(each_member(scored).join(classes.select("c_class", "c_description"), "c_class"), key)
    floor = D.min_score(F.col("sole"), F.col("anchors"), F.col("n_tokens"), F.col("category"), F.col("diameters"))
    best = best.withColumn("floor", floor).join(tops, key, "left")
    review = near_tie() | F.coalesce(F.col("category") == "QUADRO", F.lit(False))
    passed = F.col("score") >= F.col("floor")
    conflict = hard_conflict()
    diam = F.concat(F.lit("["), F.array_join(F.col("diameters").cast("array<int>").cast("array<string>"), ", "), F.lit("]"))

    def none(c):
        return F.coalesce(c.cast("string"), F.lit("None"))

    reason = F.when(near_tie(), F.concat(F.lit("MATCH_EMPATE_PROXIMO(dif="), F.format_string("%.2f", F.col("gap")), F.lit(")"))).otherwise(
        F.concat(F.lit("MATCH_POR_DESCRICAO(cat="), none(F.col("category")), F.lit(",diam="), diam, F.lit(",serie="), none(F.col("subcategory")),
                 F.lit(",ang="), none(F.col("angle")), F.lit(")")))
    low = F.concat(F.lit("SCORE_DESCRICAO_ABAIXO("), F.format_string("%.2f", F.col("score")), F.lit("<"), F.col("floor").cast("string"), F.lit(")"))
    blocks = F.col("category").isNotNull() | F.col("subcategory").isNotNull() | F.col("angle").isNotNull()
    out = best.select(
        *key, passed.alias("passed"), (passed & conflict).alias("conflict"), (passed & ~conflict).alias("matched"),
        F.when(passed & ~conflict, F.col("product_code")).alias("product_code"), F.when(passed & ~conflict, F.col("c_description")).alias("matched_description"),
        F.col("product_code").alias("best_code"), "row_ord", "text_score", "score", "sole", "anchors", "candidates",
        F.when(passed & conflict, "SEM_MATCH").when(passed & review, "MATCH_DESCRICAO_REVISAR").when(passed, "MATCH_DESCRICAO").otherwise("SEM_MATCH").alias("match_type"),
        F.when(passed & conflict, "CONFLITO_ESTRUTURAL_APOS_DESCRICAO").when(passed, reason).otherwise(low).alias("reason"),
        (F.when(passed, conflict | review).otherwise(True)).alias("manual_review"), F.when(passed, conflict).otherwise(blocks).alias("blocks_fallback"))
    return out


def no_structural(items, cat, limit=80, scope=(), key=("description",)):
    """W3 when nothing is structural: candidates summary from the first products in catalogue order."""
    key = [*scope, *key]
    pp = profile_pairs(items, cat, scope).withColumn("_any", F.max("structural").over(W.partitionBy(*scope, "profile"))).filter("not _any")
    early = ranked(cat.select(*scope, "c_profile", "row_ord"), [*scope, "c_profile"], ["row_ord"], "_n").filter(F.col("_n") <= limit).drop("_n")
    prof = pp.select(*scope, "profile", "c_profile").join(early, [*scope, "c_profile"])
    first = prof.withColumn("_rn", F.row_number().over(W.partitionBy(*scope, "profile").orderBy("row_ord"))).filter(F.col("_rn") <= limit) \
        .select(*scope, "profile", "row_ord")
    pairs = items.join(first, [*scope, "profile"]).join(cat, [*scope, "row_ord"])
    return top_candidates(score_pairs(pairs).withColumn("score", F.col("text_score")), key)


def suggest_composition(items, cat, key=("description",)):
    """For a reducing TEE without a product, a plain TEE of the main size plus a bush of both sizes."""
    want = items.filter((F.col("category") == "TE") & (F.size("diameters") >= 2)) \
        .select(*key, F.array_max("diameters").alias("big"), F.array_min("diameters").alias("small"))
    sizes = want.select("big", "small").distinct()
    tee = cat.filter((F.col("c_category") == "TE") & ~F.col("c_text").rlike(r"\bRED\b|REDU")).select(
        "row_ord", "product_code", "c_description", "c_text", "c_diameters", F.explode("c_diameters").alias("big"))
    bush = cat.filter(F.col("c_category") == "BUCHA").select("row_ord", "product_code", "c_description", "c_text", "c_diameters", F.explode("c_diameters").alias("big"))
    t = sizes.join(tee, "big").filter(~F.array_contains("c_diameters", F.col("small"))).groupBy("big", "small").agg(F.min_by(
        F.struct("product_code", "c_description"), F.struct(F.when(F.col("c_text").contains("SOLD"), 0).otherwise(1).alias("a"), F.length("c_text").alias("b"), "row_ord")).alias("t"))
    b = sizes.join(bush, "big").filter(F.array_contains("c_diameters", F.col("small"))).groupBy("big", "small").agg(F.min_by(
        F.struct("product_code", "c_description"), F.struct(F.when(F.col("c_text").contains("CURTA"), 0).otherwise(1).alias("a"), F.length("c_text").alias("b"), "row_ord")).alias("b"))
    part = lambda s: F.concat_ws(" ", F.trim(s["product_code"]), s["c_description"])
    return want.join(t, ["big", "small"]).join(b, ["big", "small"]).select(
        *key, F.concat_ws(" + ", part(F.col("t")), part(F.col("b"))).alias("composition"),
        F.concat(F.lit("SEM_PRODUTO_UNICO_"), F.col("big").cast("int").cast("string"), F.lit("X"), F.col("small").cast("int").cast("string"), F.lit("_SUGERIR_COMPOSICAO")).alias("reason"))


def board_variants(cat):
    """Boards of each size, in catalogue order, as one text."""
    b = cat.filter(F.col("c_text").rlike(r"\bQUADRO\s+DISTR")).withColumn("size", P.board_size_of(F.col("c_text"))).filter("size is not null")
    part = F.concat_ws(" ", F.trim("product_code"), "c_description")
    return b.groupBy("size", part.alias("part")).agg(F.min("row_ord").alias("row_ord")) \
        .groupBy("size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "part"))), lambda x: x["part"]), " | ").alias("variants"))


# ---- M8: catalogue rules as data ----

def rule_outcome(t):
    """Family, product, reason and block of the fixed catalogue rules, on normalised text."""
    def found(p):
        return t.rlike(p)
    g = F.regexp_replace(F.regexp_replace(t, r"\b1\s*[-.]?\s*1\s*/\s*2\b", "1.1/2"), r"\b1\s*[-.]?\s*1\s*/\s*4\b", "1.1/4")
    g = F.regexp_replace(g, r"\s*/\s*", "/")
    gauge = F.coalesce(*[F.when(g.rlike(rf"(?<![\d.]){k.replace('.', chr(92) + '.')}(?![\d/])"), F.lit(k)) for k in R.PLUG_ORDER])
    plug = F.try_element_at(T._map(R.PLUG_CODES), gauge)
    vol = r"(?:ML|CM\s*[3³]|CC)(?!\w)"
    solution = F.when(found(rf"\b200\s*{vol}"), "520").when(found(rf"\b(?:1000|1\.000)\s*{vol}") | found(r"\b1\s*L\b"), "521") \
        .when(found(r"\b\d+(?:[.,]\d+)?\s*(?:ML|L|CM\s*[3³]|CC)(?!\w)"), F.lit(None)).otherwise("521")
    paste = F.when(found(r"\b160\s*G\b"), "675").when(found(r"\b400\s*G\b"), "676") \
        .when(found(r"\b(?:1000|1\.000)\s*(?:G|KG)\b") | found(r"\b1\s*KG\b"), "677").when(found(r"\b\d+(?:[.,]\d+)?\s*(?:G|KG)\b"), F.lit(None)).otherwise("677")
    weight = F.nullif(F.regexp_extract(t, r"(\d{2,4})\s*(?:G|GR|GRS|GRAMAS?)\b", 1), F.lit("")).cast("int")
    extra, brush = found(r"\bEXTRA\s*FORTE\b"), found(r"\bPINCEL\b")
    w175, w850 = weight.isNull() | (weight == 175), weight.isNull() | (weight == 850)
    glue = F.when(extra & brush & w175, "522").when(extra & ~brush & w850, "523").when(~extra & ~brush & w850, "519")
    glue_blocks = (extra & brush & ~w175) | (extra & ~brush & ~w850) | (~extra & brush & ~w175)
    glue_reason = F.when(glue == "522", "REGRA_CATALOGO_ADESIVO_EXTRAFORTE_175_PINCEL").when(glue == "523", "REGRA_CATALOGO_ADESIVO_EXTRAFORTE_850") \
        .when(glue == "519", "REGRA_CATALOGO_ADESIVO_850").when(glue_blocks, "REGRA_ADESIVO_TAMANHO_NAO_CADASTRADO")
    is_plug = found(r"\bPLUG\b") & ~found(r"\bPPR\b") & found(r"\bPVC\b|\bSOLD|\bROSC")
    is_solution = found(r"\bSOLUCAO\b") & found(r"LIMP|PREPARADORA")
    is_paste = found(r"\bPASTA\b") & found(r"\bLUBRIFICANTE\b")
    is_glue = found(r"\bADESIVO\b") & found(r"PVC|PLASTIC") & ~found(r"CPVC|ULTRATERM")
    is_board = found(r"\bQUADRO\b") & found(r"DISTRIB|DISTR") & F.coalesce(P.board_size_of(t) == 36, F.lit(False))
    family = F.when(is_plug, "PLUG").when(is_solution, "SOLUCAO").when(is_paste, "PASTA") \
        .when(is_glue & (glue.isNotNull() | glue_blocks), "ADESIVO").when(~is_glue & is_board, "QUADRO")
    return T.let(family, lambda fam: F.struct(
        fam.alias("family"),
        F.when(fam == "PLUG", plug).when(fam == "SOLUCAO", solution).when(fam == "PASTA", paste).when(fam == "ADESIVO", glue).when(fam == "QUADRO", "1288").alias("code"),
        F.when(fam == "PLUG", F.concat(F.lit("REGRA_CATALOGO_PLUG_"), gauge)).when(fam == "SOLUCAO", "REGRA_CATALOGO_SOLUCAO_LIMPADORA")
        .when(fam == "PASTA", "REGRA_CATALOGO_PASTA_LUBRIFICANTE").when(fam == "ADESIVO", glue_reason).when(fam == "QUADRO", "REGRA_CATALOGO_QUADRO_36_SEM_BARRAMENTO").alias("reason")))


def match_rules(items, cat, key="description"):
    """M8: fixed product of a recognised family; an unknown size blocks the fallback."""
    r = items.withColumn("_r", T.let(T.norm_text(F.col(key)), rule_outcome)).filter("_r.family is not null") \
        .select(key, F.col("_r.family").alias("family"), F.col("_r.code").alias("rule_code"), F.col("_r.reason").alias("rule_reason"))
    side = cat.groupBy(T.drop_zeros(F.col("product_code")).alias("rule_code")).agg(F.min_by(F.struct("product_code", "c_description"), "row_ord").alias("_c"))
    j = r.join(side, "rule_code", "left").join(board_variants(cat).filter("size = 36").select(F.lit("QUADRO").alias("family"), "variants"), "family", "left")
    hit = F.col("_c").isNotNull()
    return j.filter(hit | (F.col("family") != "QUADRO")).select(
        key, hit.alias("matched"), F.when(hit, F.trim("_c.product_code")).alias("product_code"), F.when(hit, F.col("_c.c_description")).alias("matched_description"),
        F.when(hit & (F.col("family") == "QUADRO"), "MATCH_REGRA_CATALOGO_REVISAR").when(hit, "MATCH_REGRA_CATALOGO").otherwise("SEM_MATCH").alias("match_type"),
        F.when(hit, F.col("rule_reason")).when(F.col("rule_code").isNull() & (F.col("family") == "ADESIVO"), F.col("rule_reason"))
        .when(F.col("rule_code").isNull(), F.concat(F.lit("REGRA_"), F.col("family"), F.lit("_TAMANHO_NAO_CADASTRADO")))
        .otherwise(F.concat(F.lit("REGRA_"), F.col("family"), F.lit("_CODIGO_AUSENTE"))).alias("reason"),
        F.when(hit, 1.0).otherwise(0.0).alias("score"), (~hit | (F.col("family") == "QUADRO")).alias("manual_review"), (~hit).alias("blocks_fallback"),
        F.when(F.col("family") == "QUADRO", F.col("variants")).alias("candidates"))


# ---- M9 / W7: vectors ----

def knn(queries, vectors, k=10, max_products=50_000, max_queries=2048):
    """The ``k`` nearest products of each query by inner product, ties by catalogue order.

    Products are cut into blocks and queries into slices of about the given sizes, whatever the tables'; each pair of a
    block and a slice is one task of bounded memory, and only ``k`` rows per query and block leave it.
    """
    blocks, salts = max(1, -(-vectors.count() // max_products)), max(1, -(-queries.count() // max_queries))
    v = vectors.select((F.pmod(F.xxhash64("row_ord"), F.lit(blocks))).alias("block"), "row_ord", "product_code", F.col("embedding").cast("array<float>").alias("embedding"))
    q = queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"))
    q = q.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)))
    v = v.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    found = q.groupBy("block", "salt").cogroup(v.groupBy("block", "salt")).applyInPandas(
        lambda a, b: nearest(a, b, k), "query_id long, row_ord long, product_code string, cosine double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "row_ord"))).filter(F.col("rank") <= k)


CELLS = 1 << 22


def nearest(queries, products, k):
    """Best ``k`` of one product block for one slice of queries; so many queries meet the block at a time that ``CELLS`` products of vectors are held."""
    if not len(queries) or not len(products):
        return pd.DataFrame({"query_id": [], "row_ord": [], "product_code": [], "cosine": []})
    products = products.sort_values("row_ord")
    P_ = np.stack(products["embedding"].to_numpy()).astype(np.float64)
    out = []
    step = max(1, CELLS // len(products))
    for start in range(0, len(queries), step):
        part = queries.iloc[start:start + step]
        sims = np.stack(part["embedding"].to_numpy()).astype(np.float64) @ P_.T
        most = min(k, sims.shape[1])
        floor = -np.partition(-sims, most - 1, axis=1)[:, most - 1:most]
        row, at = np.nonzero(sims >= floor)  # with all that tie at the k-th place
        order = np.lexsort((at, -sims[row, at], row))
        row, at = row[order], at[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, at = row[nth < most], at[nth < most]
        out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "row_ord": products["row_ord"].to_numpy()[at],
                                 "product_code": products["product_code"].to_numpy()[at], "cosine": sims[row, at]}))
    return pd.concat(out)


def vector_features(texts, column):
    """Attributes the vector stage compares, on technically normalised text."""
    t = texts.withColumn("_t", T.norm_technical(T.enrich_synonyms(F.col(column))))
    c = F.col("_t")
    return t.select(*texts.columns, P.vector_category(c).alias("v_category"), P.first_diameter(c).alias("v_diameter"), P.length_m(c).alias("v_length"))


def match_vector(hits, queries, cat, floor=0.45, margin=0.05):
    """M9: nearest products with attribute bonus, score floor and near-tie flag.

    ``hits`` from ``knn``; ``queries`` carries query_id and the ``vector_features``
    columns; ``cat`` the featured catalogue.
    """
    c = cat.select("row_ord", F.col("description").alias("c_description"), F.col("category").alias("k_category"), "c_diameter_mm", "bar_length_m")
    s = hits.join(c, "row_ord").join(queries.select("query_id", "v_category", "v_diameter", "v_length"), "query_id")
    bonus = D.vector_bonus(F.col("v_category"), F.col("k_category"), F.col("v_diameter"), F.col("c_diameter_mm"), F.col("v_length"), F.col("bar_length_m"))
    s = s.withColumn("score", F.round(F.least(F.lit(1.0), F.col("cosine") + bonus), 4))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    s = s.withColumn("_rn", F.row_number().over(w)).withColumn("gap", F.col("score") - F.lead("score").over(w)).filter("_rn = 1")
    ok = F.col("score") >= floor
    tie = F.coalesce(F.col("gap") < margin, F.lit(False))
    return s.select("query_id", ok.alias("matched"), F.when(ok, F.col("product_code")).alias("product_code"), F.when(ok, F.col("c_description")).alias("matched_description"),
                    F.col("cosine").alias("text_score"), "score",
                    F.when(~ok, "SEM_MATCH_SEMANTICO").when(tie, "MATCH_SEMANTICO_REVISAR").otherwise("MATCH_SEMANTICO").alias("match_type"),
                    F.when(~ok, True).otherwise(tie).alias("manual_review"), "row_ord")
