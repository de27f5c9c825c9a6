"""Queries over the catalogue (K, J1-J4, J6, J16-J18, A1, A20, S5) and description linkage (J5, F, W, M6-M9)."""
from pyspark.sql import functions as F

from ..functions import features as P
from ..functions import rules as R
from ..functions import text as T
from ..operators import catalogue as C
from ..operators import linkage as L
from . import sqlkit as S
from .q_text import _DIAMS, LINE_SQL
from .registry import query


def featured(s):
    return C.catalogue_features(C.build_catalogue(s.catalogue))


def texts(s):
    """Distinct order wordings with how many lines carry each."""
    return s.items.groupBy("description").agg(F.count("*").alias("n_lines"))


def item_side(s):
    return L.item_features(texts(s))


_ND = S.squash(S.rx(S.rx("replace(" + S.rx(S.squash(S.rx(S.rx(S.fold("upper(strip_accents(description))", R.ACRONYMS), "[;/|]+", " "), "-+", " - ")),
                                           r"[^A-Z0-9.,\-\s]", " ") + ", ' MM', 'MM')", "[;/|]+", " "), "-+", " - "))
_CATSQL = f"SELECT *, ltrim(product_code, '0') AS code, {_ND} AS nd FROM {{catalogue}} WHERE product_code NOT IN ({', '.join(S.q('0' + c) for c in R.BLOCKED_CODES)}, '784')"
query("f1_drop_blocked", "SELECT product_code FROM {catalogue} WHERE ltrim(product_code, '0') NOT IN ('784', '1758', '1759', '1761')")(
    lambda s: C.drop_blocked(s.catalogue.withColumn("product_code", T.drop_zeros(F.col("product_code")))).select(F.concat(F.lit("0"), "product_code").alias("product_code"))
    .withColumn("product_code", F.when(F.col("product_code") == "00", "00").otherwise(F.col("product_code"))))
query("k1_build_catalogue", f"SELECT product_code, nd AS norm_description, ({S.starts('nd', chr(92) + 'bTUBO' + chr(92) + 'b')}) = 1 AS is_tube, {S.category('nd', R.CATALOGUE_CATEGORIES)} AS first_category, coalesce({S.category('nd', R.CATALOGUE_CATEGORIES)}, {S.category('nd', R.CATEGORIES)}) AS category FROM (SELECT product_code, {_ND} AS nd FROM {{catalogue}})")(
    lambda s: C.build_catalogue(s.catalogue, blocked=["784", "1758", "1759", "1761"]).select(
        "product_code", "norm_description", "is_tube", P.catalogue_category(F.col("norm_description")).alias("first_category"), "category"))
query("k2_enrich_description", f"""SELECT product_code, nd AS norm_description, {S.category('nd', R.CATALOGUE_CATEGORIES)} AS category, try_cast(regexp_extract(nd, '\\b(\\d{{1,3}})\\s*MM\\b', 1) AS DOUBLE) AS diameter_mm FROM (SELECT product_code, {_ND} AS nd FROM {{catalogue}})""")(
    lambda s: s.catalogue.select("product_code", C.enrich_description(F.col("description")).alias("e")).select("product_code", "e.norm_description", "e.category", "e.diameter_mm"))
_ALIAS = """SELECT CAST(l_partkey AS STRING) AS product_code, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'ALIAS ' || l_returnflag || CAST(l_linenumber AS STRING) END AS alias,
  CASE WHEN l_suppkey % 9 = 0 THEN 'TE' ELSE 'tubo' END AS type, CASE WHEN l_tax = 0 THEN '' ELSE 'L' || CAST(CAST(l_tax * 100 AS INTEGER) % 3 AS STRING) END AS line, l_returnflag AS source,
  (CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 1000000 + l_suppkey AS row_ord FROM {lineitem}"""
_ALSQL = f"""SELECT code, coalesce(aliases, '') AS aliases, coalesce(alias_type, '') AS alias_type, coalesce(alias_line, '') AS alias_line FROM (SELECT product_code AS code FROM ({_ALIAS}) GROUP BY 1)
  LEFT JOIN (SELECT product_code AS code, array_to_string(list_transform(list_sort(list_distinct(list(struct_pack(k := -length(alias), a := alias)))), lambda x: x.a), ' | ') AS aliases FROM ({_ALIAS}) WHERE alias <> '' GROUP BY 1) USING (code)
  LEFT JOIN (SELECT product_code AS code, CASE WHEN count(DISTINCT upper(type)) = 1 THEN min(upper(type)) ELSE '' END AS alias_type FROM ({_ALIAS}) GROUP BY 1) USING (code)
  LEFT JOIN (SELECT code, arg_min(line, struct_pack(n := -n, f := f)) AS alias_line FROM (SELECT product_code AS code, line, count(*) AS n, min(row_ord) AS f FROM ({_ALIAS}) WHERE line <> '' GROUP BY 1, 2) GROUP BY code) USING (code)"""
query("a1_aggregate_aliases", _ALSQL)(lambda s: C.aggregate_aliases(s.sql(_ALIAS)))
_PDF = "SELECT CAST(p_partkey AS STRING) AS product_code, p_size AS diameter_1_mm, CASE WHEN p_size > 30 THEN 20 END AS diameter_2_mm, CAST(p_size AS STRING) || CASE WHEN p_size > 30 THEN ' x 20' ELSE '' END AS gauge, 1 AS page, p_partkey AS row_ord FROM {part}"
query("j6_enrich_catalogue", f"SELECT c.product_code, coalesce(a.aliases, '') AS aliases, coalesce(a.alias_type, '') AS alias_type, CAST(p.diameter_1_mm AS DOUBLE) AS printed_diameter_mm FROM {{catalogue}} AS c LEFT JOIN ({_ALSQL}) a ON coalesce(nullif(ltrim(c.product_code, '0'), ''), '0') = a.code LEFT JOIN ({_PDF}) p ON c.row_ord = p.row_ord".replace("{catalogue} AS c", "(SELECT * FROM {catalogue}) AS c"))(
    lambda s: C.build_catalogue(s.catalogue, s.sql(_ALIAS), s.sql(_PDF), blocked=["x"]).select("product_code", "aliases", F.coalesce("alias_type", F.lit("")).alias("alias_type"), "printed_diameter_mm"))
query("j16_check_aliases", f"""SELECT consistent, count(*) AS n FROM (SELECT CASE WHEN c.code IS NULL THEN 'fora_catalogo' WHEN a.t = c.t OR c.t = '' THEN 'sim' ELSE 'nao' END AS consistent
  FROM (SELECT DISTINCT ON (product_code, upper(alias || ' ' || type), source) ltrim(CAST(CAST(product_code AS BIGINT) * 2 AS VARCHAR), '0') AS code, CASE WHEN upper(type) = 'TE' THEN 'TE' ELSE 'TUBO' END AS t FROM ({_ALIAS})) a
  LEFT JOIN (SELECT CAST(row_ord AS VARCHAR) AS code, coalesce({S.category(S.plain_upper('description'), R.ALIAS_TYPES)}, '') AS t FROM {{catalogue}}) c USING (code) WHERE code <> '') GROUP BY 1""")(
    lambda s: C.check_aliases(s.sql(_ALIAS).withColumn("product_code", (F.col("product_code").cast("long") * 2).cast("string")).withColumn("alias", F.concat_ws(" ", "alias", "type")),
                              s.catalogue.withColumn("product_code", F.col("row_ord").cast("string")).withColumn("category", F.lit(None).cast("string"))).groupBy("consistent").agg(F.count("*").alias("n")))
query("a20_import_report")(lambda s: C.import_report(C.check_aliases(s.sql(_ALIAS), s.catalogue.withColumn("category", F.lit(None).cast("string")))))
query("j17_check_pdf_attrs", f"""SELECT agrees, count(*) AS n FROM (SELECT CASE WHEN c.diameter_mm IS NULL THEN 'preenche' WHEN c.diameter_mm = p.diameter_1_mm OR c.diameter_mm = p.diameter_2_mm THEN 'sim' ELSE 'nao' END AS agrees FROM ({_PDF}) p JOIN (SELECT * FROM {{catalogue}}) c USING (row_ord)) GROUP BY 1""")(
    lambda s: C.check_pdf_attrs(s.sql(_PDF), s.catalogue.withColumn("product_code", F.col("row_ord").cast("string"))).groupBy("agrees").agg(F.count("*").alias("n")))
query("j18_snapshot_delta", "SELECT code, CASE WHEN bool_and(o) THEN 'removed' WHEN bool_and(NOT o) THEN 'added' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT l_partkey AS code, true AS o FROM {lineitem} WHERE l_tax < 0.02 UNION SELECT DISTINCT l_partkey, false FROM {lineitem} WHERE l_tax > 0.05) GROUP BY code")(
    lambda s: C.snapshot_delta(s.lineitem.filter("l_tax < 0.02").select(F.col("l_partkey").alias("code")), s.lineitem.filter("l_tax > 0.05").select(F.col("l_partkey").alias("code")), ["code"]))
_FOLD = "SELECT 'root/' || CASE WHEN p_size % 2 = 0 THEN 'Esgoto/' ELSE 'x/' END || '0' || CAST(100 + p_partkey % 800 AS STRING) || ' ' || CAST(100 + p_size AS STRING) || ' - ' || p_name AS path, p_partkey FROM {part}"
query("k3_parse_alias_paths", f"SELECT p_partkey, path, regexp_replace(path, '^.* - ', '') AS alias, unnest([substr(split_part(path, '/', 3), 2, 3), split_part(split_part(path, '/', 3), ' ', 2)]) AS code, CASE WHEN contains(path, 'Esgoto') THEN 'ESGOTO' ELSE '' END AS line FROM ({_FOLD})")(
    lambda s: C.parse_alias_paths(s.sql(_FOLD)))
query("u14_distinct_catalogue", "SELECT min(p_partkey) AS row_ord, p_brand AS code, p_type AS family, p_size AS gauge FROM {part} GROUP BY p_brand, p_type, p_size")(
    lambda s: C.distinct_catalogue(s.part.select(F.col("p_partkey").alias("row_ord"), F.col("p_brand").alias("code"), F.col("p_type").alias("family"), F.col("p_size").alias("gauge"))))
query("p14_catalogue_features", f"SELECT product_code, {LINE_SQL} AS c_line, {S.joined(_DIAMS)} AS x_diameters, cat AS x_category FROM (SELECT product_code, t, replace(t, ' ', '  ') AS w, coalesce({S.category('t', R.CATEGORIES)}, '') AS cat FROM (SELECT product_code, {S.norm_text('description')} AS t FROM {{catalogue}}))")(
    lambda s: C.catalogue_features(C.build_catalogue(s.catalogue, blocked=["x"])).select("product_code", "c_line", F.array_join(F.col("x_diameters").cast("array<string>"), ",").alias("x_diameters"), F.coalesce("x_category", F.lit("")).alias("x_category")))
_REFS = S.has('t', r'REFOR|\bSR\b')
_ANGLED = "cat IN ('JOELHO', 'CURVA', 'TE') AND regexp_matches(t, '(^|[^0-9])(45|90|180)([^0-9]|$)')"
query("p15_anchors", f"""SELECT CAST(cat IS NOT NULL AS INTEGER) + CAST(len({_DIAMS}) > 0 AS INTEGER) + CAST({_REFS} OR ({LINE_SQL}) IS NOT NULL AS INTEGER) + CAST({_ANGLED} AS INTEGER) AS anchors, count(*) AS texts, CAST(sum(n) AS BIGINT) AS lines
  FROM (SELECT *, replace(t, ' ', '  ') AS w, {S.category('t', R.CATEGORIES)} AS cat FROM (SELECT {S.clean_for_match('description')} AS t, n FROM (SELECT description, count(*) AS n FROM {{items}} GROUP BY 1))) GROUP BY 1""")(lambda s: item_side(s).groupBy("anchors").agg(F.count("*").alias("texts"), F.sum("n_lines").alias("lines")))
_P16 = "SELECT p_partkey AS row_ord, CASE p_size % 3 WHEN 0 THEN 'RED DN ' || CAST(p_size + 50 AS STRING) || ' X ' || CAST(p_size AS STRING) WHEN 1 THEN 'TUBO DN' || CAST(p_size + 10 AS STRING) ELSE 'CAP' END AS description, CASE WHEN p_size > 45 THEN 1.0 END AS diameter_mm, CAST(NULL AS DOUBLE) AS diameter_final_mm, p_size FROM {part}"
query("p16_complete_diameters", f"SELECT row_ord, CASE WHEN diameter_mm IS NOT NULL THEN diameter_mm WHEN p_size % 3 = 0 THEN p_size + 50 WHEN p_size % 3 = 1 THEN p_size + 10 END AS d, CASE WHEN diameter_mm IS NULL AND p_size % 3 = 0 THEN p_size END AS d2 FROM ({_P16})")(
    lambda s: C.complete_diameters(s.sql(_P16)).select("row_ord", F.col("diameter_mm").alias("d"), F.col("diameter_final_mm").alias("d2")))

# ---- exact joins ----
query("j1_lookup_by_code", "SELECT i.doc_id, count(*) AS n, count(c.row_ord) AS found, min(c.description) AS first_description FROM {items} AS i0 GROUP BY 1".replace("{items} AS i0", "(SELECT * FROM {items}) i LEFT JOIN (SELECT * FROM {catalogue}) c ON trim(i.own_code) <> '' AND coalesce(nullif(ltrim(trim(i.own_code), '0'), ''), '0') = coalesce(nullif(ltrim(c.product_code, '0'), ''), '0')"))(
    lambda s: C.lookup_by_code(s.items.select("doc_id", "own_code"), s.catalogue.withColumn("code", T.drop_zeros(F.col("product_code"))).withColumn("found", F.lit(1)).withColumnRenamed("description", "c_desc"), "own_code", ["found", "c_desc"])
    .groupBy("doc_id").agg(F.count("*").alias("n"), F.count("found").alias("found"), F.min("c_desc").alias("first_description")))
_MAP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY row_ord DESC) AS rn FROM (SELECT * FROM {{code_map}}) WHERE {k} <> '') WHERE rn = 1"
query("j2_join_code_map", f"SELECT i.doc_id, count(m.product_code) AS mapped, max(m.product_code) AS top_code FROM (SELECT * FROM {{items}}) i LEFT JOIN ({_MAP.format(k=chr(39).join(['regexp_replace(client_code, ', chr(92) + 'D', ', ', '', ', ', 'g', ')']))}) m ON regexp_replace(coalesce(nullif(regexp_replace(coalesce(i.client_code, ''), '\\D', '', 'g'), ''), i.own_code), '\\D', '', 'g') = regexp_replace(m.client_code, '\\D', '', 'g') AND regexp_replace(m.client_code, '\\D', '', 'g') <> '' GROUP BY i.doc_id")(
    lambda s: C.join_code_map(s.items, s.code_map, ["client_code", "own_code"]).groupBy("doc_id").agg(F.count("mapped_code").alias("mapped"), F.max("mapped_code").alias("top_code")))
query("j3_join_code_map_text", f"SELECT i.doc_id, count(m.product_code) AS mapped, max(m.product_code) AS top_code FROM (SELECT * FROM {{items}}) i LEFT JOIN ({_MAP.format(k='client_code')}) m ON trim(i.client_code) = m.client_code GROUP BY i.doc_id")(
    lambda s: C.join_code_map(s.items, s.code_map, ["client_code"], "text").groupBy("doc_id").agg(F.count("mapped_code").alias("mapped"), F.max("mapped_code").alias("top_code")))
query("s5_read_code_map", "SELECT client_code, product_code, row_ord, try_cast(replace(replace(replace(price_text, 'R$ ', ''), '.', ''), ',', '.') AS DOUBLE) AS price FROM {code_map}")(
    lambda s: C.read_code_map(s.code_map).select("client_code", "product_code", "row_ord", "price"))
query("j4_price_index", """SELECT client, product_code AS index_code, CAST(arg_max(price, row_ord) AS DOUBLE) AS table_price FROM (SELECT * FROM {price_table}) GROUP BY client, product_code""")(
    lambda s: C.price_index(s.price_table, s.catalogue).select("client", "index_code", F.col("table_price").cast("double").alias("table_price")))

# ---- attribute filters on profile pairs ----
_IFEAT = f"""SELECT description, t, cat AS category, {_DIAMS} AS diameters, {LINE_SQL} AS line FROM (SELECT description, t, replace(t, ' ', '  ') AS w, coalesce({S.category('t', R.CATEGORIES)}, '') AS cat FROM (SELECT DISTINCT description, {S.clean_for_match('description')} AS t FROM {{items}}))"""
query("j5_candidates", f"SELECT category, count(*) AS texts FROM ({_IFEAT}) GROUP BY category")(
    lambda s: item_side(s).groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("texts")))


def pair_query(key, names):
    """Soft filter ``names`` of the chain on their own: surviving profile pairs per category."""
    def run(s):
        tests = L.filter_tests()
        items, cat = item_side(s), L.candidate_side(featured(s))
        ip = items.select("profile", *L.I_PROFILE).dropDuplicates(["profile"]).withColumn("_k", F.explode(L.block_keys()))
        cp = cat.select("c_profile", *L.C_PROFILE).dropDuplicates(["c_profile"]).withColumn("_k", F.explode(L.catalogue_keys()))
        pairs = ip.join(cp, "_k")
        for n in names:
            pairs = L_soft(pairs, tests[n])
        return pairs.groupBy("category").agg(F.count("*").alias("pairs"), F.countDistinct("profile").alias("profiles"))
    query(key)(run)


def L_soft(pairs, test):
    from ..operators.common import soft_filter
    return soft_filter(pairs, "profile", test)


pair_query("f2_guard_lines", [0, 1])
pair_query("f3_filter_category", [2])
pair_query("f4_filter_sliding", [3])
pair_query("f5_filter_diameter", [4, 5])
pair_query("f6_filter_attributes", [6, 7, 8, 9, 10])
query("f7_is_structural")(lambda s: L.profile_pairs(item_side(s), L.candidate_side(featured(s))).groupBy("structural").agg(F.count("*").alias("pairs")))
query("f8_families_compatible", """SELECT a, b, (a = '' OR b = '' OR a = b OR (a IN ('JOELHO', 'CURVA') AND b IN ('JOELHO', 'CURVA')) OR (a IN ('REDUCAO', 'BUCHA') AND b IN ('REDUCAO', 'BUCHA'))
  OR (a IN ('REGISTRO', 'VALVULA') AND b IN ('REGISTRO', 'VALVULA') AND sphere)) AS ok, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'JOELHO' WHEN 2 THEN 'REDUCAO' WHEN 3 THEN 'REGISTRO' WHEN 4 THEN '' ELSE 'TE' END AS a,
  CASE l_suppkey % 5 WHEN 0 THEN 'CURVA' WHEN 1 THEN 'BUCHA' WHEN 2 THEN 'VALVULA' WHEN 3 THEN 'TE' ELSE '' END AS b, l_returnflag = 'R' AS sphere FROM {lineitem}) GROUP BY ALL""")(
    lambda s: s.sql("SELECT CASE l_linenumber WHEN 1 THEN 'JOELHO' WHEN 2 THEN 'REDUCAO' WHEN 3 THEN 'REGISTRO' WHEN 4 THEN '' ELSE 'TE' END AS a, CASE l_suppkey % 5 WHEN 0 THEN 'CURVA' WHEN 1 THEN 'BUCHA' WHEN 2 THEN 'VALVULA' WHEN 3 THEN 'TE' ELSE '' END AS b, l_returnflag = 'R' AS sphere FROM {lineitem}")
    .groupBy("a", "b", L.families_compatible(F.col("a"), F.col("b"), F.col("sphere"), F.col("sphere")).alias("ok")).agg(F.count("*").alias("n")))


def scored(s, keep=2):
    """Order wordings, product classes, and the classes each wording meets with their scores."""
    items, classes = item_side(s), L.product_classes(L.candidate_side(featured(s)), keep)
    return items, classes, C.cut_lineage(L.scored_classes(items, classes, ["description"]))


def best(s):
    items, classes, pairs = scored(s)
    return L.best_class(pairs, items, classes, ["description"])


def members(s, keep):
    _, classes, pairs = scored(s, keep)
    return L.each_member(pairs).join(classes.select("c_class", "c_description"), "c_class")


query("f9_hard_conflict")(lambda s: best(s).groupBy(L.hard_conflict().alias("conflict")).agg(F.count("*").alias("texts"), F.sum("n_lines").alias("lines")))
query("d6_attribute_bonus")(lambda s: scored(s)[2].groupBy(F.round(F.col("score") - F.col("text_score"), 2).alias("bonus")).agg(F.sum("n").alias("pairs")))
query("w1_best_candidate")(lambda s: best(s).select("description", "product_code", "score", "n_lines"))
query("w2_near_tie")(lambda s: best(s).groupBy(L.near_tie().alias("tie")).agg(F.count("*").alias("texts")))
query("w3_top_candidates")(lambda s: L.top_candidates(members(s, 3), ["description"]))
query("w4_sole_candidate")(lambda s: best(s).groupBy("sole").agg(F.count("*").alias("texts")))
query("w6_shortlist")(lambda s: L.shortlist(members(s, 15), ["description"]).groupBy("description").agg(F.count("*").alias("n"), F.max("rank").alias("last")))
query("m6_match_description")(lambda s: L.match_description(item_side(s), L.candidate_side(featured(s))))
query("m7_gate_conflict")(lambda s: L.match_description(item_side(s), L.candidate_side(featured(s))).groupBy("match_type", "conflict", "blocks_fallback").agg(F.count("*").alias("texts")))
query("j19_suggest_composition")(lambda s: L.suggest_composition(item_side(s), L.candidate_side(featured(s))))
query("j20_board_variants", "SELECT p_size AS size, array_to_string(list_transform(list_sort(list(struct_pack(r := row_ord, s := code || ' ' || description))), lambda x: x.s), ' | ') AS variants FROM (SELECT row_ord, product_code AS code, description, CAST(regexp_extract(description, '([0-9]+)D/', 1) AS INTEGER) AS p_size FROM {catalogue} WHERE description LIKE 'QUADRO%' AND product_code NOT IN ('784', '1758', '1759', '1761')) GROUP BY p_size")(
    lambda s: L.board_variants(L.candidate_side(C.catalogue_features(C.build_catalogue(s.catalogue, blocked=["784"])))))
_RULE = """SELECT DISTINCT CASE p_size % 8 WHEN 0 THEN 'PLUG PVC ROSC ' || CASE WHEN p_partkey % 2 = 0 THEN '3/4' ELSE '1 1/2' END WHEN 1 THEN 'Solução limpadora ' || CAST(p_size * 10 AS STRING) || ' ml' WHEN 2 THEN 'PASTA LUBRIFICANTE ' || CASE WHEN p_partkey % 2 = 0 THEN '400 G' ELSE '' END
  WHEN 3 THEN 'ADESIVO PVC EXTRA FORTE ' || CASE WHEN p_partkey % 2 = 0 THEN '850G' ELSE '90G' END WHEN 4 THEN 'QUADRO DISTR 36D/27N' WHEN 5 THEN 'ADESIVO PLASTICO 17G' ELSE p_name END AS description, p_size % 8 AS k, p_partkey % 2 AS odd, p_size FROM {part}"""
query("m8_match_rules", f"""SELECT description, CASE WHEN there THEN code END AS product_code, NOT there AS blocks_fallback FROM (SELECT *, code IN (SELECT CAST(p_partkey AS VARCHAR) FROM {{part}}) AS there FROM (SELECT DISTINCT description, k, coalesce(CASE WHEN k = 0 AND odd = 0 THEN '294' WHEN k = 0 THEN '296' WHEN k = 1 AND p_size = 20 THEN '520' WHEN k = 1 AND p_size = 100 THEN '521' WHEN k = 2 AND odd = 0 THEN '676' WHEN k = 2 THEN '677' WHEN k = 3 AND odd = 0 THEN '523' WHEN k = 4 THEN '1288' END, '') AS code FROM ({_RULE}) WHERE k < 5)) WHERE there OR k <> 4""")(
    lambda s: L.match_rules(s.sql(_RULE).select("description").distinct(), L.candidate_side(C.catalogue_features(C.build_catalogue(s.catalogue.withColumn("product_code", F.col("row_ord").cast("string")), blocked=["x"]))))
    .select("description", "product_code", "blocks_fallback"))
_KNN = """SELECT query_id, row_ord, rank, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_ord) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS row_ord, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cosine FROM {embeddings} q, {embeddings} v)) WHERE rank <= 10"""
query("w7_knn", _KNN)(lambda s: L.knn(s.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"),
      s.embeddings.select(F.col("vec_id").alias("row_ord"), F.col("label").cast("string").alias("product_code"), "embedding")).select("query_id", "row_ord", "rank", F.round("cosine", 6).alias("cosine")))


def vector_matches(s):
    cat = featured(s)
    vec = s.embeddings.select(F.col("vec_id").alias("row_ord"), F.concat(F.lit("0"), F.col("vec_id").cast("string")).alias("product_code"), "embedding")
    asked = s.catalogue.filter("row_ord % 50 = 0")  # every row whose id is divisible by 50, against all rows
    q = L.vector_features(asked.select(F.col("row_ord").alias("query_id"), "description").join(s.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id"), "description")
    return L.match_vector(L.knn(q.select("query_id", "embedding"), vec), q, cat)


query("m9_match_vector")(vector_matches)
