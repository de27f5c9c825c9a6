"""A client's own price table: newest validity, identification, matching and comparison."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features as P
from ..functions import rules as R
from ..functions import scores as D
from ..functions import text as T
from ..session import cut_lineage
from . import linkage as L
from .quantity import unit_warning
from .common import contained, soft_rank


def latest_table(tables):
    """Rows of each client's newest validity."""
    t = tables.withColumn("validity_order", T.validity_order(F.col("validity")))
    top = t.groupBy("client").agg(F.max(F.struct("validity_order", "validity")).alias("_m"))
    return t.join(top.select("client", F.col("_m.validity").alias("validity")), ["client", "validity"], "left_semi")


def tables_available(tables):
    return latest_table(tables).groupBy("client", "validity").agg(F.count("*").alias("items"))


def identify_client(docs, ids):
    """Tax number, then e-mail domain, then term; alphabetical within a tier.

    ``ids``: client, kind (cnpj | domain | term), value.  Each kind's identifiers run as one automaton over what a document
    says of that kind, so only hits are joined.
    """
    norm = T.plain_upper(F.col("text"))
    domains = F.upper(F.array_join(F.regexp_extract_all(F.lower(norm), F.lit(r"@([\w.-]+)"), F.lit(1)), " "))
    kinds = [("cnpj", 1, F.regexp_replace(norm, r"\D", ""), T.digits(F.col("value"))), ("domain", 2, domains, T.plain_upper(F.col("value"))), ("term", 3, norm, T.plain_upper(F.col("value")))]
    found = None
    for kind, tier, hay, needle in kinds:
        mine = ids.filter(F.col("kind") == kind if kind != "term" else ~F.col("kind").isin("cnpj", "domain"))
        hits = contained(docs, "doc_id", hay, mine, needle)
        named = mine.select("client", needle.alias("needle")).groupBy("needle").agg(F.min("client").alias("client"))
        part = hits.join(named, "needle").select("doc_id", F.lit(tier).alias("tier"), "client")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id").agg(F.min_by("client", F.struct("tier", "client")).alias("client"))


def codes_reliable(df):
    """all codes filled and not merely the numbers 1..n."""
    w = W.partitionBy("doc_id").orderBy("row_ord")
    r = df.withColumn("_n", F.row_number().over(w))
    filled = F.trim(T.text(F.col("client_code"))) != ""
    return r.groupBy("doc_id").agg((F.bool_and(filled) & ~F.bool_and(F.trim(T.text(F.col("client_code"))) == F.col("_n").cast("string"))).alias("codes_reliable"))


def measures_compatible(a, b):
    """F13."""
    ok = F.lit(True)
    for k in ("size", "inch", "dim"):
        ok = ok & ((F.size(a[k]) == 0) | (F.size(b[k]) == 0) | F.arrays_overlap(a[k], b[k]))
    return ok


def missing_tokens(texts, table):
    """words of a text that no word of the table (of the same type) covers, prefix either way or by synonym.

    A word is covered when a table word of three or more letters begins it, or it
    begins a table word; both become joins on prefixes.
    """
    generic = F.array(*[T.stem(F.lit(w)) for w in R.GENERIC_WORDS])
    words = texts.select("text_id", "client", "ptype", F.posexplode(T.words(F.col("description"))).alias("pos", "word")) \
        .withColumn("stem", T.stem(F.col("word"))).filter("length(stem) >= 4") \
        .filter(~F.array_contains(generic, F.col("stem"))).filter(F.col("stem") != F.coalesce(T.stem(F.col("ptype")), F.lit("")))
    vocab = table.select("client", F.explode(F.array(F.lit("*"), F.coalesce("ptype", F.lit("?")))).alias("scope"), F.explode(T.words(F.col("description"))).alias("vw")) \
        .select("client", "scope", T.stem(F.col("vw")).alias("vs")).distinct()
    syn = F.try_element_at(T._map({"BORRACH": "VEDACA", "VEDACA": "BORRACH", "SANITARI": "ESGOT", "ESGOT": "SANITARI"}), F.col("stem"))
    need = words.withColumn("scope", F.coalesce("ptype", F.lit("*"))).withColumn("try", F.explode(F.array_compact(F.array(F.col("stem"), syn))))
    asked = need.select("client", "scope", "try").distinct()
    prefixes = lambda c, lo: F.transform(F.sequence(F.lit(lo), F.greatest(F.lit(lo), F.length(c))), lambda n: F.substring(c, F.lit(1), n))
    starts = asked.withColumn("vs", F.explode(prefixes(F.col("try"), 3))).join(vocab.filter("length(vs) >= 3"), ["client", "scope", "vs"], "left_semi").select("client", "scope", "try")
    begins = asked.join(vocab.withColumn("try", F.explode(prefixes(F.col("vs"), 4))).select("client", "scope", "try").distinct(), ["client", "scope", "try"], "left_semi")
    ok = starts.unionByName(begins).distinct().withColumn("_ok", F.lit(True))
    j = need.join(ok, ["client", "scope", "try"], "left")
    per = j.groupBy("text_id", "word").agg(F.min("pos").alias("pos"), F.bool_or(F.coalesce("_ok", F.lit(False))).alias("ok")).filter("not ok")
    return per.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: F.lower(x["word"])), ", ").alias("missing"))


#: What the verdicts on a pair look at, beside the profiles of the description stage.
I_VERDICT = ["r_materials", "r_line", "r_short_long", "r_subcategory", "r_angle", "r_diameters", "r_board", "r_busbar", "r_sphere", "r_category"]
C_VERDICT = ["x_category", "x_series", "x_angle", "x_diameters", "x_board", "x_busbar", "x_materials", "c_diameter_mm"]


def verdicts():
    """What the attributes of a pair settle, texts aside: filter rank, structure, conflict and bonus."""
    hard = F.col("category").isNull() | (F.col("c_category") == F.col("category")) | (F.col("category").isin(*R.ELBOWS) & F.col("c_category").isin(*R.ELBOWS)) \
        | (F.col("category").isin("REDUCAO", "BUCHA") & F.col("c_category").isin("REDUCAO", "BUCHA"))
    same_type = F.coalesce(F.col("ptype") == F.col("c_ptype"), F.lit(True))  # c_ptype: the type of c_description
    return {"pool_rank": F.when(hard, soft_rank(L.filter_tests())).otherwise(-1), "structural": L.is_structural(), "conflict": L.hard_conflict() | ~same_type, "bonus": L.bonus()}


def asked_of(items):
    """What a text asks of the products of its client's table."""
    d = F.col("description")
    return items.withColumns({"ptype": P.ptype(d), "asks_reduction": P.asks_reduction(d), "asked_measures": P.measures(d), "r_material": P.material(d)})


def judged_wordings(items, table):
    """W5 once per class of texts that ask the same: (``item_key`` and class ``_w`` of each item, judged pairs, W5's choice; both by class).

    Texts of a client that differ only in what cleaning takes away are alike in everything a product is compared with.
    """
    own = ["client", "ptype", "asks_reduction", "asked_measures", "r_material", "clean", "clean_words", "n_tokens", "anchors", *L.I_PROFILE, *I_VERDICT]
    i = cut_lineage(asked_of(items).select("item_key", F.md5(F.to_json(F.struct(*own), {"ignoreNullFields": "false"})).alias("_w"), *own))
    judged = judged_classes(restricted_pairs(i.drop("item_key").withColumnRenamed("_w", "item_key").dropDuplicates(["item_key"]), table, judge=True))
    return i.select("item_key", "_w"), judged, cut_lineage(first_without_conflict(judged))


def of_items(names, by_class, *columns):
    """Rows of a class for each of its items; ``names`` may bring ``columns`` of the items."""
    return by_class.withColumnRenamed("item_key", "_w").join(names.select("item_key", "_w", *columns), "_w").drop("_w")


def restricted_pairs(items, table, judge=False):
    """products of the client's table an order text may take, with their ``verdicts`` if they are to be judged.

    Same product type when the table has it, then material (hard), reductions out
    unless asked for (soft), every measure among the product's numbers (hard).
    """
    types = table.select("client", F.col("c_ptype").alias("ptype")).distinct().withColumn("_has", F.lit(True))
    i = (items if "asked_measures" in items.columns else asked_of(items)).join(types, ["client", "ptype"], "left")
    # texts with equal answers to these tests share a profile, products too; texts meet products only where profiles pass
    key = lambda cols: F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    asked, told = ["client", "ptype", "_has", "r_material", "asks_reduction", "asked_measures"], ["client", "c_ptype", "c_material", "c_reduction", "c_numbers"]
    i, t = i.withColumn("_ip", key(asked)), table.withColumn("_tp", key(told))
    fine = [asked + L.I_PROFILE + I_VERDICT, told + L.C_PROFILE + C_VERDICT]
    if judge:
        i, t = i.withColumn("_iv", key(fine[0])), t.withColumn("_tv", key(fine[1]))
    i, t = cut_lineage(i), cut_lineage(t)
    ip, tp = i.select("_ip", *asked).dropDuplicates(["_ip"]), t.select("_tp", *told).dropDuplicates(["_tp"])
    typed = ip.filter("_has").join(tp.withColumn("ptype", F.col("c_ptype")), ["client", "ptype"])
    free = ip.filter("_has is null").join(tp, "client")
    p = typed.unionByName(free)
    p = p.filter(F.col("r_material").isNull() | F.col("c_material").eqNullSafe(F.col("r_material")))
    straight = ~F.col("c_reduction")
    p = p.withColumn("_any", F.max(straight).over(W.partitionBy("_ip"))).filter(F.col("asks_reduction") | straight | ~F.col("_any"))
    p = cut_lineage(p.filter((F.size("asked_measures") == 0) | L.subset(F.col("asked_measures"), F.col("c_numbers"))).select("_ip", "_tp"))
    if judge:  # verdicts are a matter of profiles too, finer ones, of pairs that are left
        iv, tv = i.select("_ip", "_iv", *[c for c in fine[0] if c != "client"]).dropDuplicates(["_iv"]), t.select("_tp", "_tv", *[c for c in fine[1] if c != "client"]).dropDuplicates(["_tv"])
        v = iv.join(p.join(tv, "_tp"), "_ip")
        p = cut_lineage(v.select(F.col("_iv").alias("_ip"), F.col("_tv").alias("_tp"), *[c.alias(n) for n, c in verdicts().items()]))
        i, t = i.withColumn("_ip", F.col("_iv")).drop("_iv"), t.withColumn("_tp", F.col("_tv")).drop("_tv")
    # profiles take their products first, so that what is moved is a row per profile and product and not per text and product
    return i.drop("_has").join(p.join(t.drop("client"), "_tp"), "_ip").drop("_ip", "_tp")


#: Products kept of a class: a best and a second are still there when three attempts and the current product are taken out.
MEMBERS = 6


def judged_classes(pairs):
    """Everything about a pair that does not depend on the pool: filter rank, structure, score, conflict and both floors.

    What attributes alone settle comes with the pairs where ``restricted_pairs`` judged them by profiles.
    The retries and price stages then work on these few narrow columns only.  A pair with a product class stays one row, with
    the class's ``members`` in catalogue order.
    """
    p = L.score_pairs(pairs if "pool_rank" in pairs.columns else pairs.withColumns(verdicts()))
    floor = lambda sole: D.min_score(F.lit(sole), F.col("anchors"), F.col("n_tokens"), F.col("category"), F.col("diameters"))
    place = lambda m: F.struct(m["row_ord"].alias("row_ord"), m["product_code"].alias("product_code"))
    members = F.transform("members", place) if "members" in p.columns else F.array(F.struct("row_ord", "product_code"))
    keep = ["item_key", "c_description", "table_price", "pool_rank", "structural", "score", "conflict"] + [c for c in ("price", "factor") if c in pairs.columns]
    return cut_lineage(p.select(*keep, members.alias("members"), floor(True).alias("floor_sole"), floor(False).alias("floor"),
                                F.coalesce(F.col("category") == "QUADRO", F.lit(False)).alias("is_board")))


def judged_pairs(pairs):
    """``judged_classes`` with a row per kept product."""
    j = judged_classes(pairs)
    one = j.select(*[c for c in j.columns if c != "members"], F.explode("members").alias("_m"))
    return one.select(*[c for c in one.columns if c != "_m"], "_m.*", F.array("_m").alias("members"))


def _without(row_ord):
    """Members of a pair's class but for the product at ``row_ord``."""
    return F.filter("members", lambda m: m["row_ord"] != row_ord)


def first_without_conflict(pairs, attempts=4):
    """Rerun the whole match (M6) on the pool minus the loser, at most four times.  ``pairs`` are judged, by class or by product.

    A match: survivors of the soft filters, structural products (else the whole pool), best with its second.  An item is
    settled, out, or goes on without its loser; pairs are dealt by item once for all attempts.
    """
    w = W.partitionBy("item_key")
    p = pairs.withColumns({"_done": F.lit(False), "_review": F.lit(False)})
    for _ in range(attempts):
        p = p.withColumn("_top", F.max("pool_rank").over(w))
        p = p.withColumn("_good", (F.col("pool_rank") == F.col("_top")) & (F.col("pool_rank") >= 0) & F.col("structural")).withColumn("_anygood", F.max("_good").over(w))
        p = p.withColumn("_in", F.coalesce(F.col("_good") | ~F.col("_anygood"), F.lit(False)))
        order = w.orderBy(F.desc("_in"), F.desc("score"), F.col("members")[0]["row_ord"])
        p = p.withColumns({"_rn": F.row_number().over(order), "_next": F.lead(F.when(F.col("_in"), F.col("score"))).over(order), "_n": F.sum(F.when(F.col("_in"), F.size("members"))).over(w)})
        second = F.when(F.size("members") > 1, F.col("score")).otherwise(F.col("_next"))
        ok = F.col("score") >= F.when(F.col("_n") == 1, F.col("floor_sole")).otherwise(F.col("floor"))
        first = (F.col("_rn") == 1) & F.col("_in")
        p = p.withColumns({"gap": F.col("score") - second, "_won": first & (F.col("_done") | F.coalesce(ok & ~F.col("conflict"), F.lit(False))), "_lost": F.when(first & ~F.col("_done") & ok & F.col("conflict"), F.col("members")[0]["row_ord"])})
        p = p.withColumn("_review", F.when(F.col("_done"), F.col("_review")).otherwise(L.near_tie() | F.col("is_board"))).withColumn("_out", F.max("_lost").over(w))
        p = p.filter(F.col("_won") | F.col("_out").isNotNull()).withColumn("members", F.when(F.col("_won"), F.col("members")).otherwise(_without(F.col("_out"))))
        p = p.filter(F.size("members") > 0).withColumn("_done", F.col("_won")).select(*pairs.columns, "_done", "_review")
    head = F.col("members")[0]
    return p.filter("_done").select("item_key", head["row_ord"].alias("row_ord"), head["product_code"].alias("product_code"), "c_description", "table_price", "score", F.lit(True).alias("ok"), "conflict", F.col("_review").alias("review"))


def price_factor(ratios):
    """The densest +-1.5 % group of a document's price ratios; needs two members and 30 %.

    Ratios become a sorted running position, so the size of a group is a
    difference of two range counts and no ratio meets another in a join.
    """
    r = ratios.groupBy("doc_id", "ratio").agg(F.count("*").alias("c"))
    step = 0.0148886124937507  # ln 1.015
    r = r.withColumn("lr", F.log("ratio"))
    near = f"sum(c) OVER (PARTITION BY doc_id ORDER BY lr RANGE BETWEEN {step + 1e-12:.16f}D PRECEDING AND {step + 1e-12:.16f}D FOLLOWING)"
    less = f"sum(c) OVER (PARTITION BY doc_id ORDER BY lr RANGE BETWEEN UNBOUNDED PRECEDING AND {step + 2e-12:.16f}D PRECEDING)"
    w = W.partitionBy("doc_id")
    g = r.withColumn("size", F.expr(near)).withColumn("below", F.coalesce(F.expr(less), F.lit(0))) \
        .withColumn("upto", F.sum("c").over(w.orderBy("lr"))).withColumn("total", F.sum("c").over(w))
    best = g.groupBy("doc_id").agg(F.min_by(F.struct("size", "below", "total"), F.struct((-F.col("size")).alias("s"), "ratio")).alias("_b")) \
        .filter("_b.size >= greatest(2, cast(floor(0.3 * _b.total) as bigint))") \
        .select("doc_id", (F.col("_b.below") + F.floor(F.col("_b.size") / 2)).alias("pos"))
    return g.join(best, "doc_id").filter((F.col("pos") >= F.col("upto") - F.col("c")) & (F.col("pos") < F.col("upto"))).select("doc_id", F.col("ratio").alias("factor"))


def price_band(pairs, tolerance):
    """Products whose table price, corrected by the factor, is within ``tolerance`` of the line's."""
    return pairs.filter(F.abs(F.col("price") / F.col("table_price").cast("double") / F.coalesce("factor", F.lit(1.0)) - 1) <= tolerance)


def same_product(a, b):
    sa, sb = P.signature(a), P.signature(b)
    return F.coalesce(P.ptype(a).isNotNull() & (sa == sb), F.lit(False))


def match_price_table(items, pairs, first=None):
    """M4: description within the client's products; the price only confirms or breaks ties.

    ``items``: item_key, description, price, factor; ``pairs`` from ``restricted_pairs``, with price and factor.  Where the
    same wordings come at many prices, ``pairs`` may be judged already, with ``first`` their ``first_without_conflict``.
    """
    if first is None:
        pairs = judged_classes(pairs)
        first = first_without_conflict(pairs)
    pick = lambda d, n: d.select("item_key", *[F.col(c).alias(n + c) for c in ("row_ord", "product_code", "c_description", "table_price", "score", "review")])
    cur = items.select("item_key", "description", "price", "factor").join(pick(first, ""), "item_key")
    verdict = D.price_verdict(F.col("price") / F.col("table_price").cast("double"), F.col("factor"))
    cur = cut_lineage(cur.withColumn("verdict", F.when(F.col("price") > 0, verdict)))
    # stage a: products within 10 % when the price does not confirm
    doubt = cur.filter("price > 0 and not coalesce(verdict, false)").select("item_key")
    alt = pick(first_without_conflict(price_band(pairs.join(doubt, "item_key", "left_semi"), 0.10)), "a_")
    j = cur.join(alt, "item_key", "left")
    s_oc, s_alt, s_cur = (P.declared_series(F.col(c)) for c in ("description", "a_c_description", "c_description"))
    has = F.col("a_product_code").isNotNull()
    clash = has & F.coalesce(s_oc.isNotNull() & s_alt.isNotNull() & (s_alt != s_oc) & (s_cur == s_oc), F.lit(False))
    confirms = F.abs(F.col("price") / F.col("a_table_price").cast("double") / F.coalesce("factor", F.lit(1.0)) - 1) <= 0.05
    take = has & ~clash & same_product(F.col("description"), F.col("a_c_description")) & ((F.col("a_score") >= F.col("score") - 0.10) | (confirms & (F.col("a_score") >= 0.55)))
    j = j.withColumn("series_conflict", clash).withColumn("_t", F.coalesce(take, F.lit(False)))
    for c in ("row_ord", "product_code", "c_description", "table_price", "score", "review"):
        j = j.withColumn(c, F.when(F.col("_t"), F.col("a_" + c)).otherwise(F.col(c))).drop("a_" + c)
    cur = cut_lineage(j.drop("_t"))
    # stage b: another product with practically the same price
    other = price_band(pairs, 0.01).join(cur.filter("price > 0 and not series_conflict").select("item_key", F.col("row_ord").alias("_cur")), "item_key").withColumn("members", _without(F.col("_cur"))).filter(F.size("members") > 0).drop("_cur")
    alt = pick(first_without_conflict(other), "b_")
    j = cur.join(alt, "item_key", "left")
    s_oc, s_alt = P.declared_series(F.col("description")), P.declared_series(F.col("b_c_description"))
    off = F.abs(F.col("price") / F.col("table_price").cast("double") / F.coalesce("factor", F.lit(1.0)) - 1)
    swap = F.col("b_product_code").isNotNull() & same_product(F.col("description"), F.col("b_c_description")) & ~F.coalesce(s_alt != s_oc, F.lit(False)) & (off > 0.01) \
        & ((F.col("b_score") >= F.col("score") - 0.05) | ((off > 0.20) & (F.col("b_score") >= 0.45)))
    j = j.withColumn("_t", F.coalesce(swap, F.lit(False)))
    for c in ("row_ord", "product_code", "c_description", "table_price", "score", "review"):
        j = j.withColumn(c, F.when(F.col("_t"), F.col("b_" + c)).otherwise(F.col(c))).drop("b_" + c)
    j = j.withColumn("verdict", F.when(F.col("price") > 0, D.price_verdict(F.col("price") / F.col("table_price").cast("double"), F.col("factor"))))
    sure, wrong = F.coalesce(F.col("verdict"), F.lit(False)), F.coalesce(~F.col("verdict"), F.lit(False))
    review = F.col("series_conflict") | wrong | (F.col("review") & ~sure) | ((F.col("score") < 0.65) & ~sure)
    reason = F.concat(F.lit("TABELA_CLIENTE(desc="), F.format_string("%.2f", F.col("score")), F.when(sure, ", preco confere").when(wrong, ", preco diverge").otherwise(""),
                      F.when(F.col("series_conflict"), ", preco aponta outra serie").otherwise(""), F.lit(")"))
    return j.select("item_key", "product_code", F.col("c_description").alias("matched_description"), "score", review.alias("manual_review"),
                    F.when(review, "MATCH_TABELA_CLIENTE_REVISAR").otherwise("MATCH_TABELA_CLIENTE").alias("match_type"), reason.alias("reason"),
                    F.round(F.col("table_price").cast("double"), 4).alias("table_price"), F.round("price", 4).alias("order_price"))


def without_angle(c):
    """``25 X 90`` on an elbow or tee is a 25 mm piece."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?i)\b(\d{1,3})\s*X\s*(?:45|90)\b", "$1"), r"(?i)\b(?:45|90)\s*X\s*(\d{1,3})\b", "$1")
    return F.when(P.ptype(c).isin("JOELHO", "TE", "CURVA"), out).otherwise(c)


def join_client_code(items, table, key="client_code"):
    """Every product of a client code, the best wording wins, table order on ties."""
    k = lambda c: F.regexp_replace(F.upper(F.trim(T.text(F.col(c)))), R.WS, "")
    t = table.withColumn("_k", k("client_code")).filter("_k <> ''").select("client", "_k", "row_ord", "index_code", F.col("description").alias("t_description"), "table_price")
    n = t.groupBy("client", "_k").agg(F.count("*").alias("repeats"))
    p = items.withColumn("_k", k(key)).filter("_k <> ''").select("item_key", "client", "_k", "description").join(t.join(n, ["client", "_k"]), ["client", "_k"])
    p = p.withColumn("score", D.token_set_ratio(T.plain_upper(F.col("description")), T.plain_upper(F.col("t_description"))))
    return p.groupBy("item_key").agg(F.min_by(F.struct("index_code", "t_description", "table_price", "score", "repeats"), F.struct((-F.col("score")).alias("s"), "row_ord")).alias("_b")).select("item_key", "_b.*")


def join_product_code(items, table, key="client_code"):
    """Product code of the document against the table."""
    t = table.select("client", "index_code", F.col("description").alias("t_description"), "table_price")
    return items.withColumn("index_code", T.norm_code(F.regexp_replace(F.upper(F.trim(T.text(F.col(key)))), R.WS, ""), "int")).select("item_key", "client", "index_code", "description") \
        .join(t, ["client", "index_code"]).withColumn("score", D.token_set_ratio(T.plain_upper(F.col("description")), T.plain_upper(F.col("t_description"))))


# Statuses, thresholds and wording of the comparison with a price table.
OK, REVIEW, MISSING = "OK", "REVISAR", "SEM"
CODE_FLOOR, TEXT_FLOOR = 0.50, 0.80
VIA_CLIENT, VIA_PRODUCT, VIA_TEXT = "CÓD. CLIENTE", f"CÓD. {R.SUPPLIER}", "DESCRIÇÃO"
EXTRA_STRONG = r"EXTRA\s*FORTE"


def _notes(*parts):
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def _head_word(c):
    """First word that says what a text without a product type is about."""
    generic = F.array(*[T.stem(F.lit(w)) for w in R.GENERIC_WORDS])
    return F.get(F.filter(T.words(c), lambda w: ~F.array_contains(generic, T.stem(w)) & (F.length(T.stem(w)) >= 4)), F.lit(0))


def described_items(items, side, table):
    """The description stage of M14 per item: product, price, score, status, note.

    A product type that the client's table doesn't have, or a leading word that no word of the table covers, ends it at
    once.  Wordings meet the table with synonyms put in its terms (N34); one that finds nothing is tried again with an
    angle that was read as a measure taken out (M15).  What is found falls if the table lacks a word of the text (F15).
    """
    i = items.select("item_key", "client", "description").withColumn("ptype", P.ptype(F.col("description"))).withColumn("head", F.when(F.col("ptype").isNull(), _head_word(F.col("description"))))
    types = side.select("client", F.col("c_ptype").alias("ptype"), F.lit(True).alias("_has")).distinct()
    i = i.join(types, ["client", "ptype"], "left")
    vocabulary = table.select("client", "description", P.ptype(F.col("description")).alias("ptype"))
    asked = i.select(F.col("item_key").alias("text_id"), "client", "ptype", "description")
    missing = cut_lineage(missing_tokens(asked, vocabulary).withColumnRenamed("text_id", "item_key"))
    i = i.join(missing, "item_key", "left").withColumn("gone", F.when(F.col("ptype").isNotNull() & F.col("_has").isNull(), F.initcap(F.lower("ptype")))
                                                      .when(F.col("ptype").isNull() & (F.get(F.split("missing", ", "), F.lit(0)) == F.lower("head")), F.initcap(F.lower("head"))))
    i = cut_lineage(i.drop("_has"))

    def matched(texts):
        names, judged, won = judged_wordings(L.item_features(texts), side)
        none = F.lit(None).cast("double")
        return match_price_table(texts.select("item_key", "description", none.alias("price"), none.alias("factor")), of_items(names, judged).withColumns({"price": none, "factor": none}), of_items(names, won))
    words = i.filter("gone IS NULL").select("item_key", "client", T.swap_synonyms(T.plain_upper(F.col("description"))).alias("description"))
    first = cut_lineage(matched(words))
    again = words.join(first.select("item_key"), "item_key", "left_anti").withColumn("plain", without_angle(F.col("description"))).filter("plain <> description")
    second = matched(again.select("item_key", "client", F.col("plain").alias("description"))).withColumn("angle", F.lit("ângulo lido como medida na descrição; confirme o item"))
    hit = first.withColumn("angle", F.lit(None).cast("string")).unionByName(second).withColumnRenamed("matched_description", "t_description").drop("reason", "match_type", "order_price")
    j = i.join(hit, "item_key", "left")
    found = F.col("product_code").isNotNull() & F.col("missing").isNull()
    inches, t_inches = F.array_sort(P.fractions(F.col("description"))), F.array_sort(P.fractions(F.coalesce("t_description", F.lit(""))))
    strong = lambda c: T.plain_upper(F.coalesce(c, F.lit(""))).rlike(EXTRA_STRONG)
    note = _notes(F.col("angle"), F.when(F.col("manual_review") | (F.col("score") < TEXT_FLOOR), "descrição parecida; confirme o item"),
                  F.when(inches != t_inches, F.when(F.size(t_inches) > 0, "medida em polegada difere").otherwise("medida em polegada não confirmada")),
                  F.when(strong(F.col("t_description")) & ~strong(F.col("description")), "tabela tem variante extraforte; confirme o item"))
    none_note = (F.when(F.col("gone").isNotNull(), F.concat("gone", F.lit(" não existe nesta tabela de preços"))).when(F.col("product_code").isNull(), "sem descrição compatível na tabela")
                 .otherwise(F.concat(F.lit("sem "), F.col("missing"), F.lit(" nesta tabela de preços"))))
    return j.select("item_key", F.when(found, F.col("product_code")).alias("product_code"), F.when(found, F.col("t_description")).alias("t_description"), F.when(found, F.col("table_price")).alias("table_price"),
                    F.when(found, F.col("score")).alias("score"), F.when(~found, MISSING).when(note.isNotNull(), REVIEW).otherwise(OK).alias("status"), F.when(found, note).otherwise(none_note).alias("note"))


def compare_to_table(items, table, side, rules):
    """Client code, then product code, then catalogue rule, then description; one row per item.

    ``items``: item_key, client, client_code, description, and ``code_trusted``, ``unit`` where they are known; ``table`` is
    the index of the clients' newest tables, ``side`` its candidate side, ``rules`` the candidate side of the catalogue.
    A trusted code that the client's coded table lacks is noted; a metre against a bar or unit is; a note turns OK into review.
    """
    if "code_trusted" not in items.columns:
        items = items.withColumn("code_trusted", F.lit(True))
    if "unit" not in items.columns:
        items = items.withColumn("unit", F.lit(None).cast("string"))
    code = F.regexp_replace(F.upper(F.trim(T.text(F.col("client_code")))), R.WS, "")
    items = cut_lineage(items.withColumn("_code", code).withColumn("_sure", F.coalesce("code_trusted", F.lit(False)) & (code != "")))
    trusted = items.filter("_sure")
    a = join_client_code(trusted, table).withColumn("via", F.lit(VIA_CLIENT))
    rest = trusted.join(a.select("item_key"), "item_key", "left_anti")
    b = join_product_code(rest, table).withColumn("via", F.lit(VIA_PRODUCT)).withColumn("repeats", F.lit(1).cast("bigint")).select(*a.columns)
    coded = cut_lineage(a.unionByName(b)).join(items.select("item_key", "description"), "item_key")
    whose = F.when(F.col("via") == VIA_CLIENT, "do cliente").otherwise(R.SUPPLIER.title())
    poor = F.when(F.trim(T.text(F.col("description"))) == "", F.concat(F.lit("código "), whose, F.lit(" confere, documento sem descrição"))).otherwise(F.concat(F.lit("código "), whose, F.lit(" confere, descrição muito diferente")))
    note = F.when(F.col("repeats") > 1, F.concat(F.lit("código do cliente repetido na tabela ("), F.col("repeats").cast("string"), F.lit(" itens)"))).when(F.col("score") < CODE_FLOOR, poor)
    coded = coded.select("item_key", F.col("index_code").alias("product_code"), "t_description", F.col("table_price").cast("double").alias("table_price"), F.round("score", 3).alias("score"), "via",
                         F.when(F.col("score") < CODE_FLOOR, REVIEW).otherwise(OK).alias("status"), note.alias("note"), F.lit(False).alias("_described"))
    rest = cut_lineage(items.join(coded.select("item_key"), "item_key", "left_anti"))

    ruled = L.match_rules(rest.select("description").distinct(), rules)
    index = table.groupBy("client", "index_code").agg(F.max_by(F.struct("description", "table_price"), "row_ord").alias("_t"))
    r = rest.select("item_key", "client", "description").join(ruled, "description").withColumn("index_code", T.norm_code(F.coalesce("product_code", F.lit("")), "int")).join(index, ["client", "index_code"], "left")
    there = F.col("matched") & F.col("_t").isNotNull()
    why = (F.when(~F.col("matched"), "produto reconhecido no catálogo, mas o tamanho declarado não está cadastrado").when(there, "regra de catálogo")
           .otherwise(F.concat(F.lit("produto do catálogo (cód. "), F.col("product_code"), F.lit(") não está nesta tabela"))))
    by_rule = cut_lineage(r.select("item_key", F.when(there, F.col("index_code")).alias("product_code"), F.when(there, F.col("_t.description")).alias("t_description"),
                                   F.when(there, F.col("_t.table_price").cast("double")).alias("table_price"), F.when(there, 1.0).alias("score"),
                                   F.when(~there, MISSING).when(F.col("match_type").endswith(REVIEW), REVIEW).otherwise(OK).alias("status"), why.alias("note")))
    plain = rest.join(by_rule.select("item_key"), "item_key", "left_anti")
    texts = plain.select(F.md5(F.concat_ws("|", "client", "description")).alias("item_key"), "client", "description").distinct()
    by_text = described_items(texts, side, table)
    by_text = plain.select("item_key", F.md5(F.concat_ws("|", "client", "description")).alias("_k")).join(by_text.withColumnRenamed("item_key", "_k"), "_k").drop("_k")
    out = coded.unionByName(by_rule.unionByName(by_text).withColumn("via", F.lit(VIA_TEXT)).withColumn("_described", F.lit(True)), allowMissingColumns=True)

    uses = table.filter(F.coalesce(F.trim("client_code"), F.lit("")) != "").select("client").distinct().withColumn("_uses", F.lit(True))
    units = table.groupBy("client", F.col("index_code").alias("product_code")).agg(F.max_by("unit", "row_ord").alias("t_unit")) if "unit" in table.columns else None
    j = out.join(items.select("item_key", "client", "unit", "_code", "_sure"), "item_key").join(uses, "client", "left")
    j = j.join(units, ["client", "product_code"], "left") if units is not None else j.withColumn("t_unit", F.lit(None).cast("string"))
    unknown = F.when(F.col("_described") & F.col("_sure") & F.coalesce("_uses", F.lit(False)), F.concat(F.lit("código "), F.col("_code"), F.lit(" não existe na tabela")))
    note = _notes(unknown, F.col("note"), unit_warning(F.coalesce("unit", F.lit("")), F.coalesce("t_unit", F.lit(""))))
    return j.select("item_key", "product_code", "t_description", "table_price", "score", "via", F.when((F.col("status") == OK) & note.isNotNull(), REVIEW).otherwise(F.col("status")).alias("status"), note.alias("note"))
