"""Attributes read from product descriptions (``Column -> Column``).

Functions named ``*_of`` expect text already passed through ``norm_text``.
"""
from pyspark.sql import functions as F

from . import rules as R
from . import text as T

PAIR = r"(?<!\d)(\d{1,3})\s*(?:MM)?\s*(?:X|×)\s*(?:DN\s*)?(\d{1,3})(?!\d)"
MM = r"(?<!\d)(\d{1,3})\s*MM\b"
DN = r"\bD\.?N\.?\s*(\d{2,3})(?!\d)"


def ints(c, pattern, group=1):
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group)).cast("array<int>")


def category_of(t, table=R.CATEGORIES):
    """The pattern found earliest in the text; the list order breaks ties."""
    keys = [F.nullif(F.regexp_instr(t, F.lit(p)), F.lit(0)) * 64 + i for i, (_, p) in enumerate(table)]
    names = F.array(*[F.lit(n) for n, _ in table])
    return F.get(names, (F.least(*keys) % 64).cast("int"))


def category(c):
    return T.let(T.norm_text(c), category_of)


def catalogue_category(c):
    """P1, catalogue variant: on normalised catalogue text."""
    return T.let(T.text(c), lambda t: category_of(t, R.CATALOGUE_CATEGORIES))


def alias_type(c):
    return T.let(T.plain_upper(c), lambda t: F.coalesce(category_of(t, R.ALIAS_TYPES), F.lit("")))


def vector_category(c):
    """P1, first-in-list variant."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(n)) for n, p in R.VECTOR_CATEGORIES])


def is_tube(c):
    """TUBO present and no accessory word before it."""
    c = T.text(c)
    tube = F.regexp_instr(c, F.lit(r"\bTUBO\b"))
    acc = F.regexp_instr(c, F.lit(R.ACCESSORY))
    return (tube > 0) & ~((acc > 0) & (acc < tube))


def diameters_of(t, cat):
    """Every measure in the text except angle readings, 10..1000."""
    elbow = F.coalesce(cat.isin(*R.ELBOWS), F.lit(False))
    tee = F.coalesce(cat == "TE", F.lit(False))
    pairs = F.arrays_zip(ints(t, PAIR, 1).alias("a"), ints(t, PAIR, 2).alias("b"))

    def measures(p):
        a, b = p["a"], p["b"]
        angle = ((elbow & a.isin(*R.ANGLES)) | (tee & (a == 90))) & (b >= 10)
        return F.when(angle, F.array(b)).otherwise(F.array(a, b))

    from_pairs = F.flatten(F.transform(pairs, measures))
    from_mm = F.filter(ints(t, MM), lambda d: ~(elbow & d.isin(*R.ANGLES)))
    every = F.array_distinct(F.concat(from_pairs, ints(t, DN), from_mm))
    return F.array_sort(F.filter(every, lambda d: d.between(10, 1000)))


def diameters(c):
    return T.let(T.norm_text(c), lambda t: T.let(category_of(t), lambda k: diameters_of(t, k)))


def raw_diameters(c):
    """P3 without the angle guard."""
    t = F.upper(T.text(c))
    pair = r"(?<!\d)(\d{1,3})\s*(?:X|×)\s*(\d{1,3})(?!\d)"
    return F.array_sort(F.array_distinct(F.concat(
        ints(t, MM), ints(t, pair, 1), ints(t, pair, 2), ints(t, r"\bD\.?N\.?\s*(\d{2,3})\b"))))


def _first_number(c, patterns):
    return [F.replace(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
            for p in patterns]


def first_diameter(c):
    """P4."""
    return F.coalesce(*_first_number(T.text(c), [r"\bDN\s*(\d{1,3}(?:[.,]\d+)?)\b",
                                                 r"\b(\d{1,3}(?:[.,]\d+)?)\s*MM\b"]))


def length_m(c):
    """Metres; a pattern whose first hit is out of 0.3..12 gives way to the next."""
    vals = _first_number(T.text(c), [r"\b(\d{1,2}(?:[.,]\d+)?)\s*M\b", r"\b(\d{1,2}(?:[.,]\d+)?)M\b"])
    return F.coalesce(*[F.when(v.between(0.3, 12), v) for v in vals])


def angle_of(t, cat):
    """P5."""
    hit = F.coalesce(*[F.when(t.rlike(rf"(?<!\d){a}(?!\d)"), F.lit(a)) for a in R.ANGLES])
    return F.when(cat.isin("JOELHO", "CURVA", "TE"), hit)


def angle(c):
    return T.let(T.norm_text(c), lambda t: angle_of(t, category_of(t)))


def material_of(t):
    """P6."""
    return F.when(t.rlike(r"\bPPR\b|\bPP[\s-]?R\b"), "PPR") \
        .when(t.rlike(r"\bCPVC\b") | t.rlike(r"ULTRA[\s\-]?TERM"), "CPVC") \
        .when(t.rlike(r"\bPEAD\b|\bPOLIETILENO\b"), "PEAD")


def material(c):
    return T.let(T.norm_text(c), material_of)


def materials(c):
    """P6, multi-valued."""
    t = F.upper(T.text(c))
    return F.array_compact(F.array(
        F.when(t.rlike(r"\bCPVC\b") | t.rlike(r"ULTRA[\s\-]?TERM"), "CPVC"),
        F.when(t.rlike(r"\bPP[\-\s]?R\b"), "PPR"),
        F.when(t.rlike(r"(?<!C)PVC"), "PVC"),
        F.when(t.rlike(r"\bBRASO\b|\bLAT[AÃ]O\b"), "BRASO")))


def line_of(t):
    """P7."""
    return F.when(t.rlike(r"\bESGOTO\b|\bESG\.?\b|\bPRIM\.?\b|\bSEC\.?\b|\bSN\b"), "ESGOTO") \
        .when(t.rlike(r"\bROSC"), "ROSCAVEL").when(t.rlike(r"\bSOLD"), "SOLDAVEL") \
        .when(t.rlike(r"ULTRA[\s-]?TERM|\bCPVC\b"), "ULTRATERM") \
        .when(t.rlike(r"\bPPR\b|\bPP[\s-]?R\b"), "PPR").when(t.rlike(r"\bPEAD\b"), "PEAD")


def product_line(c):
    return T.let(T.norm_text(c), line_of)


def series_of(t):
    """P8."""
    return F.when(t.rlike(r"REFOR|\bSR\b"), "REFORCADA") \
        .when(t.rlike(r"\bSN\b|\bNORMAL\b|\bPRIM\.?\b|\bSEC\.?\b|\bESGOTO\b|\bESG\.?\b"), "NORMAL")


def series(c):
    return T.let(T.norm_text(c), series_of)


def subcategory_of(t):
    return F.when(t.rlike(r"REFOR|\bSR\b"), "REFORCADA").otherwise(line_of(t))


def subcategory(c):
    return T.let(T.norm_text(c), subcategory_of)


def declared_series(c):
    """P8, strict: only a series the text states."""
    t = T.plain_upper(T.repair_text(c))
    return F.when(t.rlike(r"REFORC|\bSR\b"), "REFORCADA") \
        .when(t.rlike(r"SERIE\s*NORMAL|\bPRIM\b|\bSEC\b"), "NORMAL")


def board_size_of(t):
    """P9."""
    pats = [r"(\d{1,3})\s*D\s*/\s*\d{1,3}\s*N", r"(\d{1,3})\s*DIN\b", r"(\d{1,3})\s*DISJ", r"(\d{1,3})\s*D\b"]
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("int") for p in pats])


def board_size(c):
    return T.let(T.norm_text(c), board_size_of)


def busbar_of(t):
    return F.when(t.rlike(r"\bSEM\s+BARRAMENTO\b|\bS/\s*BARRAMENTO\b"), "SEM") \
        .when(t.rlike(r"\bCOM\s+BARRAMENTO\b|\bC/\s*BARRAMENTO\b|\bC\s+BARRAMENTO\b"), "COM")


def busbar(c):
    return T.let(T.norm_text(c), busbar_of)


def is_reduction_of(t):
    return t.rlike(r"\bREDU|\bRED\b|\bRED\.")


def is_reduction(c):
    return T.let(T.norm_text(c), is_reduction_of)


def short_long_of(t):
    return F.when(t.rlike(r"\bCURT[OA]\b"), "CURTA").when(t.rlike(r"\bLONG[OA]\b"), "LONGA")


def short_long(c):
    return T.let(T.norm_text(c), short_long_of)


def sliding_of(t):
    return t.rlike(r"\bCORRER\b")


def sliding(c):
    return T.let(T.norm_text(c), sliding_of)


def plain_reduction(c):
    """Reduction as the client table stage reads it."""
    return T.plain_upper(c).rlike(r"\bRED(U|\.|\b)")


def asks_reduction(c):
    u = T.plain_upper(c)
    return u.rlike(r"\bRED(U|\.|\b)") | (F.size(raw_diameters(u)) >= 2)


def ptype(c):
    """P10."""
    t = T.plain_upper(c)
    first = F.nullif(F.regexp_extract(t, r"\b(" + "|".join(R.PRODUCT_TYPES) + r")\b", 1), F.lit(""))
    return F.when(t.rlike(r"\bELETROD(?:UTO)?\b"), "ELETRODUTO").when(t.rlike(r"\bCX\.?\b"), "CAIXA").otherwise(first)


def signature(c):
    """P10: type, angles, reduction, thread."""
    c = T.repair_text(c)
    t = T.plain_upper(c)
    return F.struct(ptype(c).alias("ptype"),
                    F.array_sort(F.array_distinct(ints(t, r"(?<!\d)(45|90)(?!\d)"))).alias("angles"),
                    plain_reduction(c).alias("reduction"),
                    t.rlike(r"\bROSCA|\bLR\b|\(LR\)").alias("thread"))


def numbers(c):
    """P11."""
    return F.array_sort(F.array_distinct(F.filter(ints(T.plain_upper(c), r"(\d{1,3})"), lambda n: n >= 10)))


def measures(c):
    local = r"(\d{2,3})\s*X\s*(\d{2,3})"
    t = T.plain_upper(c)
    every = F.concat(raw_diameters(c), ints(t, local, 1), ints(t, local, 2))
    return F.array_sort(F.array_distinct(F.filter(every, lambda n: n >= 10)))


def fractions(c):
    """Proper fractions as ``n/d`` structs."""
    t = T.plain_upper(c)
    p = r"(?<![\d/])(\d{1,2})\s*/\s*(\d{1,2})(?![\d/])"
    z = F.arrays_zip(ints(t, p, 1).alias("n"), ints(t, p, 2).alias("d"))
    s = F.transform(z, lambda x: F.struct(x["n"].alias("n"), x["d"].alias("d")))
    return F.array_sort(F.array_distinct(F.filter(s, lambda x: (x["n"] > 0) & (x["n"] < x["d"]))))


def _decimals(c, pattern):
    arr = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return F.transform(arr, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def typed_measures(c):
    """Sizes (DN and mm), inches and ``AxB`` dimensions."""
    c = T.text(c)
    frac = r"\b(\d+)\s*/\s*(\d+)\b"
    fr = F.transform(F.filter(F.arrays_zip(F.regexp_extract_all(c, F.lit(frac), F.lit(1)).cast("array<double>").alias("n"),
                                           F.regexp_extract_all(c, F.lit(frac), F.lit(2)).cast("array<double>").alias("d")),
                              lambda x: x["d"] > 0), lambda x: F.round(x["n"] / x["d"], 3))
    dim = r"\b(\d{1,4})\s*[xX]\s*(\d{1,4})(?!\s*/)\b"
    dims = F.zip_with(ints(c, dim, 1), ints(c, dim, 2),
                      lambda a, b: F.concat_ws("x", a.cast("string"), b.cast("string")))
    return F.struct(
        F.array_sort(F.array_distinct(F.concat(_decimals(c, r"(?i)\bDN\s*(\d{1,4})\b"),
                                               _decimals(c, r"(?i)\b(\d{1,4}(?:[.,]\d+)?)\s*mm\b")))).alias("size"),
        F.array_sort(F.array_distinct(F.concat(
            _decimals(c, r"(?i)\b(\d+(?:[.,]\d+)?)\s*(?:pol(?:egada)?s?|\")\b"), fr))).alias("inch"),
        F.array_sort(F.array_distinct(dims)).alias("dim"))


def gauge(c):
    """Up to two sides, each mm or inch; anything else is text."""
    t = F.translate(F.trim(T.text(c)), "”″�*", '""" ')
    t = F.regexp_replace(t, r"^(?:T\d|U\d)\s*[-–]?\s*", "")
    t = T.squash(F.regexp_replace(t, r"\([^)]*\)", " "))
    t = F.btrim(t, F.lit(" -–"))
    sides = F.split(t, r"\s*[xX×]\s*")

    def mm(i):
        s = F.trim(F.get(sides, F.lit(i)))
        return F.when(s.rlike(r"^\d{1,3}$"), s.cast("int"))

    def inch(i):
        s = F.trim(F.get(sides, F.lit(i)))
        return F.coalesce(s.rlike(r'^\d(?:\.\d+)?/\d+"?$') | s.rlike(r'^\d"$'), F.lit(False))

    two = F.size(sides) == 2
    ok = (t != "") & (F.size(sides) <= 2) & (mm(0).isNotNull() | inch(0)) & (~two | mm(1).isNotNull() | inch(1))
    any_inch = inch(0) | (two & inch(1))
    any_mm = mm(0).isNotNull() | (two & mm(1).isNotNull())
    kind = F.when(~ok, "texto").when(any_mm & any_inch, "mm_pol").when(any_inch, "pol").otherwise("mm")
    d1 = F.when(kind.isin("mm", "mm_pol"), F.coalesce(mm(0), mm(1)))
    d2 = F.when((kind == "mm") & two, mm(1))
    return F.struct(d1.alias("d1"), d2.alias("d2"), kind.alias("kind"))


def line_from_path(c):
    """P18."""
    t = T.plain_upper(c)
    return F.when(t.rlike("AGUA[ -]QUENTE"), "AGUA_QUENTE").when(t.rlike("AGUA[ -]FRIA"), "AGUA_FRIA") \
        .when(t.contains("ESGOTO"), "ESGOTO").when(t.contains("ELETRIC"), "ELETRICA") \
        .when(t.contains("ACESSORIO"), "ACESSORIOS").otherwise("")


def canonical_line(c):
    t = T.plain_upper(c)
    return F.when(t.contains("AGUA QUENTE"), "AGUA_QUENTE").when(t.contains("AGUA FRIA"), "AGUA_FRIA") \
        .when(t.contains("ESGOTO"), "ESGOTO") \
        .when(t.rlike("ELETR|QUADRO|CAIXA DE PASSAGEM|CAIXAS DE ESGOTO|VDI"), "ELETRICA") \
        .when(t.contains("ACESSORIO"), "ACESSORIOS").otherwise("")


def unit_price(unit_value, qty, total, price):
    """The third rule divides by the quantity on purpose."""
    v = [T.number_or_null(x.cast("double")) for x in (unit_value, qty, total, price)]
    u, q, t, p = [F.when(x > 0, x) for x in v]
    return F.coalesce(u, t / q, p / q)


def source_format(notes):
    """P20: the first note that names a format decides."""
    up = F.transform(notes, F.upper)
    hits = F.filter(F.transform(up, lambda n: F.when(n.contains("SIENGE"), "SIENGE").when(n.contains("UAU"), "UAU")
                                .when(n.contains("BRASAL"), "BRASAL").when(n.contains("MRV"), "MRV")),
                    lambda n: n.isNotNull())
    return F.get(hits, F.lit(0))


def is_unknown_client(layout, notes):
    """P21."""
    joined = F.upper(F.concat_ws(" ", notes))
    return F.upper(F.trim(T.text(layout))).isin("GENERICO", "DESCONHECIDO") \
        | joined.contains("CLIENTE_NOVO") | joined.contains("EXTRATOR_GENERICO")


def direct_code(c):
    """P22."""
    return F.nullif(F.trim(T.text(c)), F.lit(""))


def anchors(cat, diams, sub, ang):
    """P15."""
    return cat.isNotNull().cast("int") + (F.size(diams) > 0).cast("int") \
        + sub.isNotNull().cast("int") + ang.isNotNull().cast("int")
