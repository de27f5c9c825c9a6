"""Priority cascade over all match stages."""
from functools import reduce

from pyspark.sql import functions as F

from ..functions import features as P
from ..functions import rules as R
from ..functions import scores as D
from ..functions import text as T
from ..session import cut_lineage
from . import catalogue as C
from . import clienttable as X
from . import linkage as L
from .quantity import adjust_quantity
from .similarity import closest

RESULT = ["matched", "product_code", "matched_description", "score", "match_type", "reason", "manual_review"]


def result(df, key, matched, code, description, score, kind, reason, review=False):
    lit = lambda v: v if hasattr(v, "alias") else F.lit(v)
    return df.select(*key, lit(matched).alias("matched"), lit(code).alias("product_code"), lit(description).alias("matched_description"), lit(score).cast("double").alias("score"),
                     lit(kind).alias("match_type"), lit(reason).alias("reason"), lit(review).alias("manual_review"))


def match_direct(items, cat, key):
    """M1: a product code on the order itself."""
    j = C.lookup_by_code(items.withColumn("_dc", P.direct_code(F.col("own_code"))), cat.withColumn("_found", F.lit(True)).withColumnRenamed("description", "_cd"), "_dc", ["_found", "_cd"])
    return result(j.filter("_found"), key, True, F.col("_dc"), F.col("_cd"), 1.0, "MATCH_CODIGO_DIRETO_OC", f"CODIGO_{R.SUPPLIER}_PRESENTE_NA_OC")


def match_code_map(items, code_map, cat, key, client="MRV"):
    """M2: the client's own code map, for that client's documents only."""
    j = C.join_code_map(items.filter(F.upper(F.trim("layout")) == client), code_map, ["client_code"]).filter("mapped_code is not null")
    j = C.lookup_by_code(j, cat.withColumnRenamed("description", "_cd"), "mapped_code", ["_cd"])
    return result(j, key, True, F.col("mapped_code"), F.col("_cd"), 1.0, f"MATCH_CODIGO_{client}", f"MATCH_DIRETO_CODIGO_{client}")


def match_code_map_text(items, code_map, key, kind="BRASAL_DIRETO"):
    """M3: exact text codes, known clients only; no catalogue data is attached."""
    known = items.filter(~P.is_unknown_client(F.col("layout"), F.array().cast("array<string>")))
    j = C.join_code_map(known, code_map, ["client_code"], "text").filter("mapped_code is not null")
    return result(j, key, True, F.col("mapped_code"), F.col("mapped_description"), 1.0, kind, F.concat(F.lit("TABELA("), F.col("client_code"), F.lit("→"), F.col("mapped_code"), F.lit(")")))


def match_corrections(texts, corrections, floor=0.85):
    """The most similar learned wording at or above the floor; word order does not matter."""
    i = texts.select("description", D.sort_words(F.upper(F.trim("description"))).alias("a"))
    c = corrections.withColumn("b", D.sort_words(F.upper(F.trim("description")))).filter("b <> ''")
    c = cut_lineage(c.groupBy("b").agg(F.min_by(F.struct("product_code", F.col("product_description").alias("_d"), "row_ord"), F.struct("row_ord")).alias("_c")))
    p = closest(i.select("a"), c.select("b", F.coalesce("_c.row_ord", F.lit(-1 << 63)).alias("place")), floor).withColumnRenamed("ratio", "score").filter(F.col("score") >= floor)
    best = p.join(c, "b").select("a", "score", "_c")
    return i.join(best, "a").select("description", F.col("_c.product_code").alias("product_code"), F.col("_c._d").alias("matched_description"), F.round("score", 2).alias("score"))


def match_fallback(items, cat, floor=0.30):
    """Structure and plain text for wordings the description stage neither matched nor blocked.

    ``items`` may say ``is_tube`` and ``length_m`` of a line, ``cat`` ``c_is_tube`` and ``c_length``; what is missing agrees
    with nothing.  ``conflict`` tells a contradicted best product from a poor one.
    """
    p = L.candidates(items, cat)
    said = lambda c, kind: F.col(c) if c in p.columns else F.lit(None).cast(kind)
    tube, length = said("is_tube", "boolean"), said("length_m", "double")
    c_tube = F.coalesce(said("c_is_tube", "boolean"), F.lit(False))
    struct = D.structure_score(F.col("category"), F.nullif("c_category", F.lit("")), tube, c_tube, F.array_max("diameters"), F.col("c_diameter_mm"), length, said("c_length", "double"))
    s = p.withColumn("structure", struct).withColumn("textual", D.fallback_text(F.col("description"), F.col("c_norm_text"))).withColumn("score", D.fallback_score(F.col("structure"), F.col("textual")))
    b = L.best_candidate(s, ["description"]).withColumn("conflict", L.hard_conflict())
    ok = (F.col("score") >= floor) & ~F.col("conflict")
    low = F.concat(F.lit("SCORE_ABAIXO_DO_MINIMO("), F.format_string("%.2f", F.col("score")), F.lit(f"<{floor})"))
    return result(b, ["description"], ok, F.when(ok, F.col("product_code")), F.when(ok, F.col("c_description")), F.col("score"), F.when(ok, "TRADICIONAL").otherwise("SEM_MATCH"),
                  F.when(ok, "FALLBACK").otherwise(low), ~ok)


def guard_vector(vector, feats, side):
    """M9: vector matches (description, row_ord and ``match_vector``'s columns) that don't contradict their order text, as results."""
    j = vector.filter("matched").select("description", "row_ord", "score", "match_type", "manual_review").join(feats, "description")
    j = j.join(side, "row_ord").filter(~L.hard_conflict())
    return result(j, ["description"], True, F.col("product_code"), F.col("c_description"), F.col("score"), F.col("match_type"), "MOTOR_SEMANTICO", F.col("manual_review"))


def prefer_vector(desc, vector):
    """M9 rule: a weak, not sole description match gives way to a better vector match."""
    v = vector.select("description", *[F.col(c).alias("v_" + c) for c in RESULT])
    j = desc.join(v, "description", "left")
    take = F.coalesce(F.col("v_matched") & F.col("matched") & (F.col("score") < 0.80) & ~F.col("sole") & (F.col("v_score") > F.col("score")), F.lit(False))
    return j.select("description", *[F.when(take, F.col("v_" + c)).otherwise(F.col(c)).alias(c) for c in RESULT])


def apply_verdicts(items, verdicts, cat):
    """Outside decisions count when the product exists and the confidence is not nenhuma; always reviewed."""
    v = verdicts.filter("confidence <> 'nenhuma'")
    j = C.lookup_by_code(items.join(v, "description"), cat.withColumn("_found", F.lit(True)).withColumnRenamed("description", "_cd"), "verdict_code", ["_found", "_cd"]).filter("_found")
    return result(j, ["description"], True, F.col("verdict_code"), F.col("_cd"), F.col("score"), "MATCH_IA", F.col("justification"), True)


def exact_stages(items, cat, code_map=None, text_map=None, key="line_key"):
    """M1-M3: the first code stage that answers, per line."""
    stages = [match_direct(items, cat, [key])]
    if code_map is not None:
        stages.append(match_code_map(items, code_map, cat, [key]))
    if text_map is not None:
        stages.append(match_code_map_text(items, text_map, [key]))
    tagged = reduce(lambda a, b: a.unionByName(b), [s.withColumn("_p", F.lit(n)) for n, s in enumerate(stages)])
    return tagged.groupBy(key).agg(F.min_by(F.struct(*RESULT), "_p").alias("_r")).select(key, "_r.*")


def table_side(table, catalogue):
    """The products of each client's newest price table, as candidates: one row per class of products, price included."""
    index = C.price_index(X.latest_table(table), catalogue)
    d = F.col("description")
    feat = C.catalogue_features(index.withColumns({"c_material": P.material(d), "c_reduction": P.plain_reduction(d), "c_numbers": P.numbers(d)}))
    return L.product_classes(L.candidate_side(feat, ["client", "table_price", "c_material", "c_reduction", "c_numbers", "index_code"]), X.MEMBERS)


def match_client_table(lines, table, catalogue):
    """M4 in the cascade: lines (line_key, doc_id, client, description, unit_price) of clients that have a price table.

    A document's price factor (A8) comes from its priced lines against the products their wordings take; then wordings
    meet the table once per price and factor.
    """
    side = table_side(table, catalogue)
    own = lines.select("line_key", "doc_id", "client", "description", F.col("unit_price").cast("double").alias("price")).join(side.select("client").distinct(), "client", "left_semi")
    words = own.select("client", "description").distinct().withColumn("item_key", F.md5(F.concat_ws("|", "client", "description")))
    names, judged, won = X.judged_wordings(L.item_features(words), side)  # once, whatever the prices
    first = X.of_items(names, won.select("item_key", "table_price")).join(words, "item_key").select("client", "description", "table_price")
    ratios = own.filter("price > 0").join(first, ["client", "description"]).select("doc_id", (F.col("price") / F.col("table_price").cast("double")).alias("ratio")).filter("ratio > 0")
    own = own.join(X.price_factor(ratios), "doc_id", "left").join(words.withColumnRenamed("item_key", "_w"), ["client", "description"])
    own = own.withColumn("item_key", F.md5(F.concat_ws("|", "_w", F.coalesce(F.col("price").cast("string"), F.lit("")), F.coalesce(F.col("factor").cast("string"), F.lit("")))))
    own = cut_lineage(own.select("line_key", "item_key", "_w", "description", "price", "factor"))
    asked = own.select("item_key", "_w", "description", "price", "factor").dropDuplicates(["item_key"])
    at = asked.select(F.col("item_key").alias("_i"), F.col("_w").alias("item_key"), "price", "factor").join(names, "item_key").drop("item_key").withColumnRenamed("_i", "item_key")
    out = X.match_price_table(asked.drop("_w"), X.of_items(at, judged, "price", "factor"), X.of_items(at, won))
    got = own.select("line_key", "item_key").join(out, "item_key")
    return result(got, ["line_key"], True, F.col("product_code"), F.col("matched_description"), F.col("score"), F.col("match_type"), F.col("reason"), F.col("manual_review"))


def match_items(items, raw_catalogue, code_map=None, corrections=None, text_map=None, price_table=None, vectors=None, verdicts=None):
    """First stage that answers wins; (results, featured catalogue).

    Exact code stages run on the lines and are joins; the client's price table takes lines with a ``client`` that has one;
    everything else that reads a description runs once per distinct wording of the lines left over.  ``vectors`` are the
    matches of ``match_vector`` by description, ``verdicts`` outside decisions.
    """
    cat = C.catalogue_features(C.build_catalogue(raw_catalogue))
    side = L.candidate_side(cat, ["is_tube as c_is_tube", "bar_length_m as c_length"])
    done = cut_lineage(exact_stages(items, cat, code_map, text_map))
    if price_table is not None:
        rest = items.join(done.select("line_key"), "line_key", "left_anti")
        done = cut_lineage(done.unionByName(match_client_table(rest, price_table, C.build_catalogue(raw_catalogue))))
    rest = items.join(done.select("line_key"), "line_key", "left_anti")
    by_text = match_texts(rest.select("description").distinct(), side, corrections, vectors, verdicts, cat)
    return done.withColumn("composition", F.lit(None).cast("string")).withColumn("candidates", F.lit(None).cast("string")).unionByName(
        rest.select("line_key", "description").join(by_text, "description").select("line_key", *RESULT, "composition", "candidates")), cat


def match_texts(texts, side, corrections=None, vectors=None, verdicts=None, cat=None):
    """Description half of the cascade, one row per wording: corrections, rules, description, vectors, fallback, verdicts, no match.

    Each stage takes the wordings left by the one before; a result that blocks ends the way of its wording.  ``composition``
    and ``candidates`` come with wordings that go to review without a product.
    """
    none = F.lit(None).cast("string")
    key = ["description"]
    done = []

    def leave(frame, out):
        out = cut_lineage(out.select("description", *RESULT, *[c if c in out.columns else none.alias(c) for c in ("composition", "candidates")]))
        done.append(out)
        return frame.join(out.select("description"), "description", "left_anti")
    left = texts
    if corrections is not None:
        c = match_corrections(left, corrections)
        left = leave(left, result(c, key, True, F.col("product_code"), F.col("matched_description"), F.col("score"), "MATCH_CORRECAO_APRENDIDA", F.concat(
            F.lit("CORRECAO_HUMANA_APRENDIDA(sim="), F.format_string("%.1f", F.col("score") * 100), F.lit("%)"))))
    left = leave(left, L.match_rules(left, side))
    feats = L.item_features(left)
    desc = cut_lineage(L.match_description(feats, side))
    vector = cut_lineage(guard_vector(vectors.join(left, "description", "left_semi"), feats, side)) if vectors is not None else None
    good = desc.filter("matched")
    left = leave(left, prefer_vector(good, vector) if vector is not None else good)
    blocked = desc.filter("blocks_fallback and not matched").select("description", *RESULT, "candidates")
    left = leave(left, blocked)
    # wordings with an anchor but no structural product: nearest products for the reviewer, or a composition of two
    anchored = feats.filter(F.col("category").isNotNull() | F.col("subcategory").isNotNull() | F.col("angle").isNotNull()).join(left.select("description"), "description", "left_semi")
    shown = anchored.select("description").join(L.no_structural(anchored, side), "description", "left").join(
        L.suggest_composition(anchored, side).select("description", "composition", F.col("reason").alias("_why")), "description", "left")
    pair = F.col("composition").isNotNull()
    alone = shown.select("description", F.lit(False).alias("matched"), none.alias("product_code"), none.alias("matched_description"), F.lit(0.0).alias("score"),
                         F.when(pair, "SUGESTAO_COMPOSICAO").otherwise("SEM_MATCH").alias("match_type"), F.coalesce("_why", F.lit("SEM_CANDIDATOS_ESTRUTURAIS")).alias("reason"), F.lit(True).alias("manual_review"),
                         "composition", F.coalesce("composition", "candidates").alias("candidates"))
    left = leave(left, alone)
    fall = cut_lineage(match_fallback(feats.join(left.select("description"), "description", "left_semi"), side))
    left = leave(left, fall.filter("matched and score >= 0.70"))
    if verdicts is not None:  # outside decisions are asked where the fallback has candidates but no match
        poor = left.join(fall.filter("not matched").select("description"), "description", "left_semi")
        left = leave(left, apply_verdicts(poor.join(fall.select("description", "score"), "description"), verdicts, cat))
    if vector is not None:
        left = leave(left, vector.join(left.select("description"), "description", "left_semi"))
    left = leave(left, fall.join(left.select("description"), "description", "left_semi"))
    leave(left, result(left, key, False, none, none, 0.0, "SEM_MATCH", "SEM_CANDIDATOS_ESTRUTURAIS", True))
    return reduce(lambda a, b: a.unionByName(b), done)


def match_batch(items, raw_catalogue, **sides):
    """Price factor per document, cascade, then the quantity rule on each line."""
    matched, cat = match_items(items, raw_catalogue, **sides)
    joined = items.join(matched, "line_key")
    # direct, text-map and learned matches carry no bar length, as in the rules they follow
    meta = C.lookup_by_code(joined, cat.withColumnRenamed("is_tube", "_tube"), "product_code", ["_tube", "bar_length_m", "sale_unit"])
    bare = F.col("match_type").isin("BRASAL_DIRETO", "MATCH_CORRECAO_APRENDIDA")
    meta = meta.withColumn("is_tube", F.when(~bare, F.col("_tube"))).withColumn("bar_length_m", F.when(~bare & (F.col("match_type") != "MATCH_CODIGO_DIRETO_OC"), F.col("bar_length_m")))
    return adjust_quantity(meta)


def shadow_compare(a, b, key="description"):
    """Two matchers side by side on lines that no code map answered."""
    x = a.filter(~F.col("match_type").rlike("CODIGO_MRV|CODIGO_BRASAL")).select(key, F.coalesce("product_code", F.lit("")).alias("code_a"), F.col("score").alias("score_a"))
    y = b.select(key, F.coalesce("product_code", F.lit("")).alias("code_b"), F.col("score").alias("score_b"))
    return x.join(y, key).withColumn("agree", (F.col("code_a") == F.col("code_b")) & (F.col("code_a") != ""))
