"""Queries over text, code, number and unit normalisers (N) and attributes (P)."""
from pyspark.sql import functions as F

from ..functions import features as P
from ..functions import rules as R
from ..functions import text as T
from . import sqlkit as S
from .registry import query

DOCS = ("documents", "doc_id", "text")
CONV = ("(SELECT conv_id * 1000 + turn AS turn_id, text FROM {conversations})", "turn_id", "text")


def per_document(key, fn, sql):
    """One output value per document, over the whole text."""
    query(key, f"SELECT doc_id, {sql} AS out FROM {{documents}}")(
        lambda s: s.documents.select("doc_id", fn(F.col("text")).alias("out")))


def per_item(key, fn, sql, pre=None):
    """Distinct outputs over all order lines, with how many lines give each."""
    inner = pre or "SELECT description AS d FROM {items}"
    query(key, f"SELECT out, count(*) AS n FROM (SELECT {sql} AS out FROM ({inner})) GROUP BY out")(
        lambda s: s.sql(inner).groupBy("d").agg(F.count("*").alias("k"))  # each wording is normalised once
        .select(fn(F.col("d")).alias("out"), "k").groupBy("out").agg(F.sum("k").alias("n")))


per_document("n1_strip_accents", T.strip_accents, "strip_accents(text)")
per_document("n2_norm_text", T.norm_text, S.norm_text("text"))
per_item("n3_expand_acronyms", T.expand_acronyms,
         S.squash(S.rx(S.rx(S.fold("upper(strip_accents(d))", R.ACRONYMS), "[;/|]+", " "), "-+", " - ")))
per_item("n4_norm_description", T.norm_description, S.squash(S.rx(S.rx("replace(" + S.rx(
    S.squash(S.rx(S.rx(S.fold("upper(strip_accents(d))", R.ACRONYMS), "[;/|]+", " "), "-+", " - ")),
    r"[^A-Z0-9.,\-\s]", " ") + ", ' MM', 'MM')", "[;/|]+", " "), "-+", " - ")))
per_item("n5_clean_for_match", T.clean_for_match, S.clean_for_match("d"))
per_item("n6_norm_technical", T.norm_technical, S.squash(S.fold(S.rx("translate(" + S.rx(S.rx(
    f"translate({S.squash('upper(d)')}, {S.q(R.TECHNICAL_ACCENTED)}, {S.q(R.TECHNICAL_UNACCENTED)})",
    R.NOISE_PREFIX), r"\s*-?\s*NBR\s*\d+") + ", '°', ' ')", r"[()\[\]]", " "), R.TECHNICAL_TERMS)))
_SYN = "SELECT replace(replace(description, 'TUBO', 'ELETRODUTO RIGIDO'), 'BUCHA', 'GRELHA QUADR') AS d FROM {items}"
per_item("n7_enrich_synonyms", T.enrich_synonyms,
         "concat_ws(' ', d, CASE " + " ".join(f"WHEN {S.has('upper(d)', p)} THEN {S.q(t)}" for p, t in R.SYNONYM_TEXTS) + " END)", _SYN)
_REP = "SELECT replace(replace(description, 'SR', 'série r'), '25', 'ø25') || ' RECUCAO' AS d FROM {items}"
per_item("n8_repair_text", T.repair_text,
         S.rx(S.rx("translate(d, '�øØ', '   ')", r"(?i)\bS\s*[ÉEée]RIE\s*R\b", "SERIE REFORCADA"), r"\bRECUCAO\b", "REDUCAO"), _REP)

_CODE = "SELECT DISTINCT coalesce(own_code, client_code, '0.0') AS d FROM {items}"
query("n9_norm_code", f"""SELECT d, coalesce(nullif(ltrim(trim(d), '0'), ''), '0') AS zeros,
  coalesce(CAST(CAST(trunc(try_cast(trim(d) AS DOUBLE)) AS BIGINT) AS VARCHAR), trim(d)) AS as_int,
  regexp_replace(d, '\\D', '', 'g') AS only_digits,
  CASE WHEN regexp_replace(d, '\\D', '', 'g') = '' THEN '' ELSE coalesce(nullif(ltrim(regexp_replace(d, '\\D', '', 'g'), '0'), ''), '0') END AS digits_zeros
  FROM ({_CODE})""")(lambda s: s.sql(_CODE).select(
    "d", T.norm_code(F.col("d"), "zeros").alias("zeros"), T.norm_code(F.col("d"), "int").alias("as_int"),
    T.norm_code(F.col("d"), "digits").alias("only_digits"), T.norm_code(F.col("d"), "digits_zeros").alias("digits_zeros")))

query("n10_norm_sku", """SELECT p_partkey, regexp_replace(upper(strip_accents(s)), '[^A-Z0-9]+', '', 'g') AS sku,
  regexp_replace(s, '\\D', '', 'g') AS digits, substr(regexp_replace(upper(strip_accents(s)), '[^A-Z0-9]+', '', 'g'), 1, 4) AS prefix
  FROM (SELECT p_partkey, p_brand || '-' || p_type || '.' || CAST(p_partkey AS STRING) AS s FROM {part})""")(
    lambda s: s.part.select("p_partkey", F.concat_ws("", "p_brand", F.lit("-"), "p_type", F.lit("."), F.col("p_partkey").cast("string")).alias("s"))
    .select("p_partkey", T.norm_sku(F.col("s")).alias("sku"), T.digits(F.col("s")).alias("digits"), T.sku_prefix(F.col("s")).alias("prefix")))

_OCR = "SELECT DISTINCT 'cod ' || replace(replace(CAST(l_partkey * 13 AS STRING), '0', 'O'), '1', 'l') AS d FROM {lineitem}"
query("n11_ocr_code", f"""SELECT d, CASE WHEN length(c) >= 3 THEN substr(c, 1, 6) END AS code FROM (
  SELECT d, regexp_replace(translate(upper(trim(d)), 'ODQIL|ZSBG', '0001112586'), '\\D', '', 'g') AS c FROM ({_OCR}))""")(
    lambda s: s.sql(_OCR).select("d", T.ocr_code(F.col("d")).alias("code")))

_PRICE = """SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN 'R$ ' || replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), '.', ',')
  WHEN l_linenumber % 3 = 1 THEN CAST(CAST(l_quantity AS INTEGER) * 113 AS STRING)
  ELSE replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), '0', 'O') END AS d FROM {lineitem}"""
query("n12_ocr_price", f"""SELECT d, CASE WHEN contains(s, ',') THEN CAST(replace(replace(regexp_extract(s, '\\d{{1,3}}(?:\\.\\d{{3}})*,\\d{{2}}'), '.', ''), ',', '.') AS DOUBLE)
   WHEN contains(s, '.') THEN CAST(s AS DOUBLE) WHEN length(s) >= 3 THEN CAST(s[:-3] || '.' || s[-2:] AS DOUBLE) ELSE CAST(s AS DOUBLE) END AS price
  FROM (SELECT d, translate(replace(replace(upper(d), ' ', ''), 'R$', ''), 'ODQIL|SB', '00011158') AS s FROM ({_PRICE}))""")(
    lambda s: s.sql(_PRICE).select("d", T.ocr_price(F.col("d")).alias("price")))

_NUM = """SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN '1.' || CAST(100 + CAST(l_quantity AS INTEGER) AS STRING) || ',5'
  WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS STRING) || ',25' WHEN 2 THEN '2.' || CAST(100 + CAST(l_quantity AS INTEGER) AS STRING)
  ELSE 'R$ ' || CAST(CAST(l_quantity AS INTEGER) AS STRING) END AS d FROM {lineitem}"""
_ND = "replace(replace(t, '.', ''), ',', '.')"
query("n13_br_number", f"""SELECT d, try_cast({_ND} AS DOUBLE) AS dot, try_cast(CASE WHEN contains(u, ',') THEN replace(replace(u, '.', ''), ',', '.') ELSE u END AS DOUBLE) AS both_marks,
  try_cast(CASE WHEN contains(t, ',') THEN {_ND} ELSE t END AS DOUBLE) AS comma, try_cast({_ND} AS DOUBLE) AS lone,
  try_cast(CASE WHEN contains(u, ',') THEN replace(replace(u, '.', ''), ',', '.') ELSE u END AS DOUBLE) AS last,
  coalesce(try_cast(replace(replace(u, '.', ''), ',', '.') AS DOUBLE), try_cast(replace(u, ',', '.') AS DOUBLE)) AS digits
  FROM (SELECT d, replace(d, ' ', '') AS t, replace(replace(d, ' ', ''), 'R$', '') AS u FROM ({_NUM}))""")(
    lambda s: s.sql(_NUM).select("d", *[T.br_number(F.col("d"), k).alias(a) for k, a in (
        ("dot", "dot"), ("both", "both_marks"), ("comma", "comma"), ("lone", "lone"), ("last", "last"), ("digits", "digits"))]))

_LOT = "SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN 'sim' WHEN p_size % 5 = 1 THEN '-' ELSE CAST(p_size - 20 AS STRING) || ',5' END AS d FROM {part}"
query("n14_positive_number", f"SELECT d, CASE WHEN v > 0 THEN v END AS v FROM (SELECT d, try_cast(replace(d, ',', '.') AS DOUBLE) AS v FROM ({_LOT}))")(
    lambda s: s.sql(_LOT).select("d", T.positive_number(F.col("d")).alias("v")))
_PCT = "SELECT DISTINCT CASE WHEN l_tax = 0 THEN '-' ELSE replace(CAST(CAST(l_tax * 100 AS DECIMAL(8,2)) AS STRING), '.', ',') || ' %' END AS d FROM {lineitem}"
query("n15_parse_percent", f"SELECT d, try_cast(replace(replace(replace(d, ' ', ''), '%', ''), ',', '.') AS DOUBLE) AS v FROM ({_PCT})")(
    lambda s: s.sql(_PCT).select("d", T.parse_percent(F.col("d")).alias("v")))
_UNIT = "SELECT unit AS d FROM {items}"
per_item("n16_norm_unit", T.norm_unit, "CASE rtrim(upper(trim(d)), '.') " + " ".join(
    f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in R.UNIT_NAMES.items()) + " ELSE rtrim(upper(trim(d)), '.') END", _UNIT)
per_item("n17_unit_class", T.unit_class, "CASE " + " ".join(
    f"WHEN upper(trim(d)) IN ({', '.join(S.q(x) for x in v)}) THEN {S.q(k)}" for k, v in R.UNIT_CLASSES.items())
    + " ELSE 'DESCONHECIDA' END", _UNIT)
_COMP = "SELECT name AS d FROM {companies}"
per_item("n18_company_key", T.company_key, S.squash(S.fold("upper(trim(d))", [(p, "") for p in R.COMPANY_SUFFIXES])), _COMP)
query("n19_stem", """SELECT w, s, count(*) AS n FROM (SELECT w, CASE WHEN length(t) >= 4 AND t[-1] IN ('A', 'O') THEN t[:-2] ELSE t END AS s
  FROM (SELECT w, CASE WHEN length(w) >= 5 AND w[-1] = 'S' THEN w[:-2] ELSE w END AS t FROM (
  SELECT unnest(regexp_extract_all(upper(strip_accents(replace(text, 'ß', 'ss'))), '[A-Z]{2,}')) AS w FROM {documents}))) GROUP BY w, s""")(
    lambda s: s.documents.select(F.explode(T.words(F.col("text"))).alias("w")).select("w", T.stem(F.col("w")).alias("s"))
    .groupBy("w", "s").agg(F.count("*").alias("n")))
per_item("n20_rule_key", T.rule_key, S.squash(S.rx(S.rx("upper(d)", r"NBR[\s\-]*\d+[\w/]*"), r"[°º\-./()]", " ")))
_NUL = "SELECT CASE l_linenumber % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN '' WHEN 2 THEN 'None' WHEN 3 THEN NULL ELSE l_returnflag || ' ' END AS d FROM {lineitem}"
per_item("n21_nullify", T.nullify, "CASE WHEN lower(trim(d)) NOT IN ('', 'nan', 'none', 'nat') THEN trim(d) END", _NUL)
_BOOL = "SELECT CASE l_linenumber % 4 WHEN 0 THEN ' Sim' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'nao' ELSE NULL END AS d FROM {lineitem}"
per_item("n22_parse_bool", T.parse_bool, "coalesce(lower(trim(d)) IN ('true', '1', 'sim', 'yes'), false)", _BOOL)
_ADDR = "SELECT DISTINCT 'Rua ' || CAST(c_custkey AS STRING) || chr(10) || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' -GO' ELSE ' - GO' END || chr(10) || CAST(70000 + c_custkey % 9999 AS STRING) || '-136' AS d FROM {customer}"
query("n23_parse_address", rf"""SELECT d, CASE WHEN c = '' THEN z || '-136' ELSE upper(c[:1]) || c[2:] END AS city, 'GO' AS state, z || '136' AS postcode
  FROM (SELECT d, regexp_extract(d, chr(10) || '(\w+) -GO', 1) AS c, regexp_extract(d, '(\d{{5}})-\d{{3}}', 1) AS z FROM ({_ADDR}))""")(
    lambda s: s.sql(_ADDR).select("d", T.parse_address(F.col("d")).alias("a")).select("d", "a.*"))
_FILE = "SELECT 'PED_' || CAST(o_orderkey % 1000 AS STRING) || ' OC ' || CAST(o_orderkey * 3 AS STRING) || '.v2.pdf' AS d, CAST(o_custkey AS STRING) AS crm FROM {orders}"
query("n24_doc_number", rf"""SELECT d, coalesce(list_sort(list_transform(regexp_extract_all(b, '\d{{4,}}'), lambda x, i: struct_pack(k := -length(x), i := i, v := x)))[1].v,
   nullif(crm, ''), list_sort(list_transform(regexp_extract_all(b, '\d+'), lambda x, i: struct_pack(k := -length(x), i := i, v := x)))[1].v, '') AS number
  FROM (SELECT d, crm, regexp_replace(d, '\.[^.]*$', '') AS b FROM ({_FILE}))""")(
    lambda s: s.sql(_FILE).select("d", T.doc_number(F.col("d"), F.col("crm")).alias("number")))
_STEM = "SELECT DISTINCT url AS d FROM {pages}"
per_item("n25_safe_stem", T.safe_stem, "coalesce(nullif(trim(" + S.rx(S.rx(S.rx("trim(d)", r"[\\/:*?\"<>|]+", "_"), r"\s+", "_"), "_+", "_") + ", '_.'), ''), 'oc')", _STEM)
_VAL = "SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN 'tabela' ELSE CAST(1 + o_custkey % 2 AS STRING) || ' sem - ' || CAST(CASE WHEN o_custkey % 2 = 0 THEN 2020 ELSE 20 END + o_custkey % 7 AS STRING) END AS d FROM {orders}"
query("n26_validity_order", rf"""SELECT d, coalesce((CASE WHEN y < 100 THEN 2000 + y ELSE y END) * 10 + h, 0) AS v FROM (
  SELECT d, try_cast(regexp_extract(upper(d), '(\d)\s*SEM.*?(\d{{2,4}})', 2) AS INTEGER) AS y,
  try_cast(regexp_extract(upper(d), '(\d)\s*SEM.*?(\d{{2,4}})', 1) AS INTEGER) AS h FROM ({_VAL}))""")(
    lambda s: s.sql(_VAL).select("d", T.validity_order(F.col("d")).alias("v")))
query("n27_format_qty", """SELECT out, count(*) AS n FROM (SELECT CASE WHEN abs(v - round(v)) < 1e-9 THEN CAST(CAST(v AS BIGINT) AS VARCHAR)
   ELSE rtrim(rtrim(printf('%.3f', v), '0'), '.') END AS out FROM (SELECT l_quantity / CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 8 END AS v FROM {lineitem})) GROUP BY out""")(
    lambda s: s.sql("SELECT l_quantity / CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 8 END AS v FROM {lineitem}")
    .select(T.format_qty(F.col("v")).alias("out")).groupBy("out").agg(F.count("*").alias("n")))
query("n28_hours_text", """SELECT out, count(*) AS n FROM (SELECT CASE WHEN h < 1 THEN CAST(greatest(1, CAST(round_even(h * 60, 0) AS BIGINT)) AS VARCHAR) || ' min'
   WHEN h < 48 THEN CAST(CAST(round_even(h, 0) AS BIGINT) AS VARCHAR) || ' h' ELSE replace(CAST(CAST(round(CAST(h / 24 AS DECIMAL(18,9)), 1) AS DECIMAL(18,1)) AS VARCHAR), '.', ',') || ' d' END AS out
  FROM (SELECT value + 0.013 AS h FROM {events})) GROUP BY out""")(
    lambda s: s.events.select(T.hours_text(F.col("value") + 0.013).alias("out")).groupBy("out").agg(F.count("*").alias("n")))
_DBL = "SELECT CASE line_no % 3 WHEN 0 THEN description || '  ' || lower(description) WHEN 1 THEN description || description ELSE description END AS d FROM {items}"
per_item("n29_undouble", T.undouble, r"""CASE WHEN len(string_split_regex(trim(d), '\s{2,}')) = 2 AND upper(string_split_regex(trim(d), '\s{2,}')[1]) = upper(string_split_regex(trim(d), '\s{2,}')[2])
  THEN string_split_regex(trim(d), '\s{2,}')[1] WHEN length(trim(d)) % 2 = 0 AND upper(trim(substr(trim(d), 1, length(trim(d)) // 2))) = upper(trim(substr(trim(d), length(trim(d)) // 2 + 1)))
  THEN trim(substr(trim(d), 1, length(trim(d)) // 2)) ELSE trim(d) END""", _DBL)
per_document("n30_norm_line", T.norm_line, S.squash(S.rx("translate(text, chr(9) || chr(10), '  ')", r"\p{C}")))
_BOIL = "SELECT CASE line_no % 3 WHEN 0 THEN description || ' deverão ser enviados com NF' WHEN 1 THEN 'TE CERTIFICADO DE QUALIDADE ' || description ELSE description END AS d FROM {items}"
query("n31_cut_boilerplate", rf"""SELECT kept, removed, count(*) AS n FROM (SELECT CASE WHEN ok THEN head ELSE d END AS kept, CASE WHEN ok THEN substr(d, pos, 80) END AS removed
  FROM (SELECT d, pos, trim(substr(d, 1, pos - 1)) AS head, pos > 0 AND length(trim(substr(d, 1, pos - 1))) >= 8 AS ok
  FROM (SELECT d, {S.starts('d', '(?i)DEVER[AÃaã]O' + chr(92) + 's*SER' + chr(92) + 's*ENVIAD|CERTIFICAD[OI]' + chr(92) + 's*DE' + chr(92) + 's*QUALIDADE')} AS pos FROM ({_BOIL})))) GROUP BY kept, removed""")(
    lambda s: s.sql(_BOIL).select(T.cut_boilerplate(F.col("d")).alias("c"))
    .groupBy(F.col("c.text").alias("kept"), F.col("c.removed").alias("removed")).agg(F.count("*").alias("n")))
per_document("n32_doc_signature", T.doc_signature, f"substr({S.squash(S.rx(S.rx("upper(replace(text, 'ß', 'ss'))", chr(92) + 'd+', '#'), '[^A-Z# ]+', ' '))}, 1, 400)")
per_document("n33_search_key", T.search_key, "lower(strip_accents(text))")
_SWAP = "SELECT replace(replace(description, 'ESGOTO', 'Sanitário'), 'PVC', 'borracha') AS d FROM {items}"
per_item("n34_swap_synonyms", T.swap_synonyms, "replace(replace(d, 'Sanitário', 'ESGOTO'), 'borracha', 'VEDACAO')", _SWAP)


# ---- attributes (P) ----
_N = S.norm_text("d")
DIST = "SELECT DISTINCT description AS d FROM {items}"


def per_text(key, fn, sql, pre=DIST):
    """One output per distinct order wording."""
    query(key, f"SELECT d, {sql} AS out FROM ({pre})")(lambda s: s.sql(pre).select("d", fn(F.col("d")).alias("out")))


def _csv(c):
    return F.array_join(c.cast("array<string>"), ",")


_T = f"SELECT d, {_N} AS t FROM ({DIST})"
query("p1_category", f"""SELECT d, {S.category('t', R.CATEGORIES)} AS category, {S.category('t', R.CATALOGUE_CATEGORIES)} AS catalogue_category,
   coalesce({S.category('u', R.ALIAS_TYPES)}, '') AS alias_type, CASE {' '.join(f"WHEN {S.has('t', p)} THEN {S.q(n)}" for n, p in R.VECTOR_CATEGORIES)} END AS vector_category
   FROM (SELECT *, {S.plain_upper('d')} AS u FROM ({_T}))""")(
    lambda s: s.sql(DIST).withColumn("t", T.norm_text(F.col("d"))).select(
        "d", P.category_of(F.col("t")).alias("category"), P.catalogue_category(F.col("t")).alias("catalogue_category"),
        P.alias_type(F.col("d")).alias("alias_type"), P.vector_category(F.col("t")).alias("vector_category")))
per_text("p2_is_tube", lambda c: P.is_tube(T.norm_text(c)),
         f"({S.starts(_N, chr(92) + 'bTUBO' + chr(92) + 'b')}) > 0 AND NOT (({S.starts(_N, R.ACCESSORY)}) > 0 AND ({S.starts(_N, R.ACCESSORY)}) < ({S.starts(_N, chr(92) + 'bTUBO' + chr(92) + 'b')}))")
_PAIR = r"(?:^|[^0-9])(\d{1,3})\s*(?:MM)?\s*(?:X|×)\s*(?:DN\s*)?(\d{1,3})(?:[^0-9]|$)"
_MMX = r"(?:^|[^0-9])(\d{1,3})\s*MM\b"
_DNX = r"\bD\.?N\.?\s*(\d{2,3})(?:[^0-9]|$)"
_DIAMS = f"""list_sort(list_filter(list_distinct(flatten([flatten(list_transform(list_zip({S.ints('w', _PAIR, 1)}, {S.ints('w', _PAIR, 2)}),
   lambda p: CASE WHEN ((cat = 'JOELHO' AND p[1] IN (45, 90, 180)) OR (cat = 'TE' AND p[1] = 90)) AND p[2] >= 10 THEN [p[2]] ELSE [p[1], p[2]] END)),
   {S.ints('w', _DNX)}, list_filter({S.ints('w', _MMX)}, lambda m: NOT (cat = 'JOELHO' AND m IN (45, 90, 180)))])), lambda m: m BETWEEN 10 AND 1000))"""
_CAT = f"SELECT d, t, replace(t, ' ', '  ') AS w, coalesce({S.category('t', R.CATEGORIES)}, '') AS cat FROM ({_T})"
query("p3_diameters", f"SELECT d, {S.joined(_DIAMS)} AS out FROM ({_CAT})")(
    lambda s: s.sql(DIST).select("d", _csv(P.diameters(F.col("d"))).alias("out")))
query("p4_first_diameter", rf"""SELECT d, coalesce(try_cast(replace(regexp_extract(t, '\bDN\s*(\d{{1,3}}(?:[.,]\d+)?)\b', 1), ',', '.') AS DOUBLE),
   try_cast(replace(regexp_extract(t, '\b(\d{{1,3}}(?:[.,]\d+)?)\s*MM\b', 1), ',', '.') AS DOUBLE)) AS diameter,
   CASE WHEN try_cast(regexp_extract(t, '\b(\d{{1,2}})\s*M\b', 1) AS DOUBLE) BETWEEN 0.3 AND 12 THEN CAST(regexp_extract(t, '\b(\d{{1,2}})\s*M\b', 1) AS DOUBLE) END AS length
   FROM ({_T})""")(lambda s: s.sql(DIST).withColumn("t", T.norm_text(F.col("d"))).select(
    "d", P.first_diameter(F.col("t")).alias("diameter"), P.length_m(F.col("t")).alias("length")))
query("p5_angle", f"""SELECT d, CASE WHEN cat IN ('JOELHO', 'TE') THEN CASE WHEN {S.has('t', '(^|[^0-9])45([^0-9]|$)')} THEN 45
   WHEN {S.has('t', '(^|[^0-9])90([^0-9]|$)')} THEN 90 WHEN {S.has('t', '(^|[^0-9])180([^0-9]|$)')} THEN 180 END END AS out FROM ({_CAT})""")(
    lambda s: s.sql(DIST).select("d", P.angle(F.col("d")).alias("out")))
query("p6_material", f"""SELECT d, CASE WHEN {S.has('t', r'\bPP[\s-]?R\b')} THEN 'PPR' WHEN {S.has('t', r'\bCPVC\b|ULTRA[\s-]?TERM')} THEN 'CPVC'
   WHEN {S.has('t', r'\bPEAD\b|\bPOLIETILENO\b')} THEN 'PEAD' END AS material,
   array_to_string(list_filter([CASE WHEN {S.has('u', r'\bCPVC\b|ULTRA[\s-]?TERM')} THEN 'CPVC' END, CASE WHEN {S.has('u', r'\bPP[\s-]?R\b')} THEN 'PPR' END,
   CASE WHEN {S.has('u', r'(^|[^C])PVC')} THEN 'PVC' END, CASE WHEN {S.has('u', r'\bBRASO\b|\bLAT[AÃ]O\b')} THEN 'BRASO' END], lambda x: x IS NOT NULL), ',') AS materials
   FROM (SELECT *, upper(d) AS u FROM ({_T}))""")(
    lambda s: s.sql(DIST).select("d", P.material(F.col("d")).alias("material"), _csv(P.materials(F.col("d"))).alias("materials")))
LINE_SQL = f"""CASE WHEN {S.has('t', r'\bESGOTO\b|\bESG\b|\bPRIM\b|\bSEC\b|\bSN\b')} THEN 'ESGOTO' WHEN {S.has('t', r'\bROSC')} THEN 'ROSCAVEL'
   WHEN {S.has('t', r'\bSOLD')} THEN 'SOLDAVEL' WHEN {S.has('t', r'ULTRA[\s-]?TERM|\bCPVC\b')} THEN 'ULTRATERM'
   WHEN {S.has('t', r'\bPP[\s-]?R\b')} THEN 'PPR' WHEN {S.has('t', r'\bPEAD\b')} THEN 'PEAD' END"""
query("p7_product_line", f"SELECT d, {LINE_SQL} AS out FROM ({_T})")(
    lambda s: s.sql(DIST).select("d", P.product_line(F.col("d")).alias("out")))
_REF = S.has('t', r'REFOR|\bSR\b')
query("p8_series", f"""SELECT d, CASE WHEN {_REF} THEN 'REFORCADA' WHEN {S.has('t', r'\bSN\b|\bNORMAL\b|\bPRIM\b|\bSEC\b|\bESGOTO\b|\bESG\b')} THEN 'NORMAL' END AS series,
   CASE WHEN {_REF} THEN 'REFORCADA' ELSE {LINE_SQL} END AS subcategory,
   CASE WHEN {S.has('t', r'REFORC|\bSR\b')} THEN 'REFORCADA' WHEN {S.has('t', r'SERIE\s*NORMAL|\bPRIM\b|\bSEC\b')} THEN 'NORMAL' END AS declared FROM ({_T})""")(
    lambda s: s.sql(DIST).select("d", P.series(F.col("d")).alias("series"), P.subcategory(F.col("d")).alias("subcategory"),
                                 P.declared_series(F.col("d")).alias("declared")))
query("p9_board_and_flags", rf"""SELECT d, coalesce(try_cast(regexp_extract(t, '(\d{{1,3}})\s*D\s*/\s*\d{{1,3}}\s*N', 1) AS INTEGER), try_cast(regexp_extract(t, '(\d{{1,3}})\s*DIN\b', 1) AS INTEGER),
   try_cast(regexp_extract(t, '(\d{{1,3}})\s*DISJ', 1) AS INTEGER), try_cast(regexp_extract(t, '(\d{{1,3}})\s*D\b', 1) AS INTEGER)) AS board,
   CASE WHEN {S.has('t', r'\bSEM\s+BARRAMENTO\b|\bS/\s*BARRAMENTO\b')} THEN 'SEM' WHEN {S.has('t', r'\bCOM\s+BARRAMENTO\b|\bC/?\s*BARRAMENTO\b')} THEN 'COM' END AS busbar,
   {S.has('t', r'\bREDU|\bRED\b')} AS reduction, CASE WHEN {S.has('t', r'\bCURT[OA]\b')} THEN 'CURTA' WHEN {S.has('t', r'\bLONG[OA]\b')} THEN 'LONGA' END AS short_long,
   {S.has('t', r'\bCORRER\b')} AS sliding FROM ({_T})""")(
    lambda s: s.sql(DIST).select("d", P.board_size(F.col("d")).alias("board"), P.busbar(F.col("d")).alias("busbar"), P.is_reduction(F.col("d")).alias("reduction"),
                                 P.short_long(F.col("d")).alias("short_long"), P.sliding(F.col("d")).alias("sliding")))
_PT = f"CASE WHEN {S.has('u', r'\bELETROD(?:UTO)?\b')} THEN 'ELETRODUTO' WHEN {S.has('u', r'\bCX\b')} THEN 'CAIXA' ELSE nullif(regexp_extract(u, {S.q(r'\b(' + '|'.join(R.PRODUCT_TYPES) + r')\b')}, 1), '') END"
_U = f"SELECT d, {S.plain_upper('d')} AS u, replace({S.plain_upper('d')}, ' ', '  ') AS w FROM ({DIST})"
query("p10_signature", f"""SELECT d, {_PT} AS ptype, array_to_string(list_sort(list_distinct({S.ints('w', '(?:^|[^0-9])(45|90)(?:[^0-9]|$)')})), ',') AS angles,
   {S.has('u', r'\bRED(U|\.|\b)')} AS reduction, {S.has('u', r'\bROSCA|\bLR\b')} AS thread FROM ({_U})""")(
    lambda s: s.sql(DIST).withColumn("g", P.signature(F.col("d"))).select("d", P.ptype(F.col("d")).alias("ptype"), _csv(F.col("g.angles")).alias("angles"), "g.reduction", "g.thread"))
_RAW = f"""flatten([{S.ints('w', _MMX)}, {S.ints('w', _PAIR.replace('(?:MM)?', '').replace('(?:DN' + chr(92) + 's*)?', ''), 1)},
   {S.ints('w', _PAIR.replace('(?:MM)?', '').replace('(?:DN' + chr(92) + 's*)?', ''), 2)}, {S.ints('w', r'\bD\.?N\.?\s*(\d{2,3})\b')}])"""
query("p11_numbers_measures", f"""SELECT d, {S.joined(f"list_sort(list_distinct(list_filter({S.ints('u', '([0-9]{1,3})')}, lambda n: n >= 10)))")} AS numbers,
   {S.joined(f"list_sort(list_distinct(list_filter({_RAW}, lambda n: n >= 10)))")} AS measures FROM ({_U})""")(
    lambda s: s.sql(DIST).select("d", _csv(P.numbers(F.col("d"))).alias("numbers"), _csv(P.measures(F.col("d"))).alias("measures")))
_FRAC = "SELECT DISTINCT description || ' ' || CAST(1 + line_no AS STRING) || '/' || CAST(line_no % 4 + 2 AS STRING) || ' x 1 / 2' AS d FROM {items}"
_FP = r"(?:^|[^0-9/])(\d{1,2})\s*/\s*(\d{1,2})(?:[^0-9/]|$)"
query("p12_fractions", f"""SELECT d, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_zip({S.ints('w', _FP, 1)}, {S.ints('w', _FP, 2)}),
   lambda p: p[1] > 0 AND p[1] < p[2]), lambda p: CAST(p[1] AS VARCHAR) || '/' || CAST(p[2] AS VARCHAR)))), ',') AS out FROM (SELECT d, replace({S.plain_upper('d')}, ' ', '  ') AS w FROM ({_FRAC}))""")(
    lambda s: s.sql(_FRAC).select("d", F.array_join(F.array_sort(F.transform(P.fractions(F.col("d")), lambda x: F.concat_ws("/", x["n"].cast("string"), x["d"].cast("string")))), ",").alias("out")))
_TM = r"list_transform(regexp_extract_all(d, '{}', 1), lambda x: CAST(replace(x, ',', '.') AS DOUBLE))"
query("p13_typed_measures", f"""SELECT d, list_sum(list_distinct(flatten([{_TM.format(r'(?i)' + chr(92) + r'bDN' + chr(92) + r's*([0-9]{1,4})' + chr(92) + 'b')}, {_TM.format(r'(?i)' + chr(92) + r'b([0-9]{1,4}(?:[.,][0-9]+)?)' + chr(92) + r's*mm' + chr(92) + 'b')}]))) AS size_sum,
   round(list_sum(list_distinct(list_transform(list_zip({S.ints('d', r'\b(\d+)\s*/\s*(\d+)\b', 1)}, {S.ints('d', r'\b(\d+)\s*/\s*(\d+)\b', 2)}), lambda p: round(p[1] / p[2], 3)))), 3) AS inch_sum FROM ({_FRAC})""")(
    lambda s: s.sql(_FRAC).withColumn("m", P.typed_measures(F.col("d"))).select("d", *[
        F.when(F.size("m." + k) > 0, F.round(F.aggregate("m." + k, F.lit(0.0), lambda a, x: a + x), 3)).alias(k + "_sum") for k in ("size", "inch")]))
_GA = "SELECT DISTINCT CASE p_size % 6 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN CAST(p_size AS STRING) || ' x 20' WHEN 2 THEN '3/4\"' WHEN 3 THEN CAST(p_size AS STRING) || ' x 1.1/4\"' WHEN 4 THEN p_type ELSE 'T1 - ' || CAST(p_size AS STRING) || ' (a)' END AS d, p_size % 6 AS k, p_size FROM {part}"
query("p17_gauge", f"SELECT d, CASE WHEN k IN (0, 1, 3, 5) THEN p_size END AS d1, CASE WHEN k = 1 THEN 20 END AS d2, CASE k WHEN 2 THEN 'pol' WHEN 3 THEN 'mm_pol' WHEN 4 THEN 'texto' ELSE 'mm' END AS kind FROM ({_GA})")(
    lambda s: s.sql(_GA).select("d", P.gauge(F.col("d")).alias("g")).select("d", "g.*"))
_PATH = "SELECT DISTINCT p_brand || '/' || CASE p_size % 5 WHEN 0 THEN 'Água Quente' WHEN 1 THEN 'agua-fria' WHEN 2 THEN 'Esgoto' WHEN 3 THEN 'Elétrica' ELSE 'x' END AS d, p_size % 5 AS k FROM {part}"
query("p18_line_from_path", f"SELECT d, CASE k WHEN 0 THEN 'AGUA_QUENTE' WHEN 1 THEN 'AGUA_FRIA' WHEN 2 THEN 'ESGOTO' WHEN 3 THEN 'ELETRICA' ELSE '' END AS out FROM ({_PATH})")(
    lambda s: s.sql(_PATH).select("d", P.line_from_path(F.col("d")).alias("out")))
query("p19_unit_price", """SELECT l_orderkey, round(max(CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice WHEN l_linenumber % 3 = 1 THEN l_extendedprice / l_quantity ELSE l_tax / l_quantity END), 9) AS top_price
   FROM {lineitem} WHERE NOT (l_linenumber % 3 = 2 AND l_tax = 0) GROUP BY l_orderkey""")(
    lambda s: s.lineitem.withColumn("u", P.unit_price(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_extendedprice")), F.col("l_quantity"),
              F.when(F.col("l_linenumber") % 3 == 1, F.col("l_extendedprice")), F.col("l_tax"))).filter("u is not null")
    .groupBy("l_orderkey").agg(F.round(F.max("u"), 9).alias("top_price")))
query("p20_source_format", """SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'UAU' WHEN source = 'src2' THEN 'SIENGE' END AS fmt FROM {documents}""")(
    lambda s: s.documents.withColumn("notes", F.array(F.lit("x"), F.when(F.col("source").startswith("src1"), "origem uau").when(F.col("source") == "src2", "Sienge").otherwise("y")))
    .select("doc_id", P.source_format(F.col("notes")).alias("fmt")))
query("p21_unknown_client", "SELECT layout, count(*) AS n, layout IN ('GENERICO', 'DESCONHECIDO') OR layout = 'UAU' AS unknown FROM {items} GROUP BY layout")(
    lambda s: s.items.withColumn("notes", F.array(F.when(F.col("layout") == "UAU", "cliente_novo").otherwise("ok")))
    .groupBy("layout", P.is_unknown_client(F.col("layout"), F.col("notes")).alias("unknown")).agg(F.count("*").alias("n")))
query("p22_direct_code", "SELECT nullif(trim(own_code), '') AS code, count(*) AS n FROM {items} GROUP BY 1")(
    lambda s: s.items.groupBy(P.direct_code(F.col("own_code")).alias("code")).agg(F.count("*").alias("n")))
