"""Text, code, number and unit normalisers (``Column -> Column``).

Everything here stays inside Spark SQL expressions, so it is planned with the
scan that feeds it and needs neither a shuffle nor a Python worker.
"""
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def _latin_pairs():
    """Accented Latin letters and their base letter, from the Unicode tables."""
    src, dst = [], []
    for cp in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)):
        base = [c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != chr(cp):
            src.append(chr(cp))
            dst.append(base[0])
    return "".join(src), "".join(dst)


_ACC, _BASE = _latin_pairs()
_COMPAT = ("ºª²³¹", "oa231")


def fold(c, rules):
    """Apply regular-expression replacements in order."""
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, c)


def let(value, body):
    """Bind ``value`` once and use it many times in ``body``.

    Without it a text used by twenty patterns is inlined twenty times and the
    generated code outgrows what the JVM compiles.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def text(c):
    return F.coalesce(c.cast("string"), F.lit(""))


def squash(c):
    return F.trim(F.regexp_replace(c, R.WS, " "))


def strip_accents(c, compat=False):
    """Drop combining marks; ``compat`` also folds superscripts and ordinals."""
    c = text(c)
    if compat:
        c = F.translate(c, *_COMPAT)
    return F.regexp_replace(F.translate(c, _ACC, _BASE), r"\p{Mn}+", "")


def plain_upper(c):
    """Compatibility-folded, accent-free upper case."""
    return F.upper(strip_accents(c, compat=True))


def norm_text(c):
    """N2."""
    c = F.translate(F.upper(text(c)), R.ACCENTED + "�º°", R.UNACCENTED + "   ")
    return squash(c)


def clean_separators(c):
    c = F.regexp_replace(F.regexp_replace(c, "[;/|]+", " "), "-+", " - ")
    return squash(c)


def expand_acronyms(c):
    """N3."""
    return clean_separators(fold(F.upper(strip_accents(c)), R.ACRONYMS))


def norm_description(c):
    """N4."""
    c = F.regexp_replace(expand_acronyms(c), r"[^A-Z0-9.,\-\s]", " ")
    return clean_separators(F.replace(c, F.lit(" MM"), F.lit("MM")))


def clean_for_match(c):
    """Order of the abbreviation rules matters."""
    c = F.regexp_replace(norm_text(c), R.NOISE_PREFIX, "")
    c = F.regexp_replace(F.regexp_replace(c, R.STANDARD_NUMBER, ""), R.BOILERPLATE_TAIL, "")
    c = let(fold(c, R.ABBREVIATIONS), lambda t: F.when(
        t.rlike(r"\bCPVC\b") & ~t.contains("ULTRATERM"),
        F.replace(t, F.lit("CPVC"), F.lit("ULTRATERM"))).otherwise(t))
    return squash(F.regexp_replace(c, r"[()\[\]]", " "))


def norm_technical(c):
    """N6."""
    c = F.translate(squash(F.upper(text(c))), R.TECHNICAL_ACCENTED, R.TECHNICAL_UNACCENTED)
    c = F.regexp_replace(c, R.NOISE_PREFIX, "")
    c = F.regexp_replace(c, r"\s*-?\s*NBR\s*\d+", "")
    c = F.regexp_replace(F.translate(c, "°", " "), r"[()\[\]]", " ")
    return squash(fold(c, R.TECHNICAL_TERMS))


def enrich_synonyms(c):
    """The first pattern that hits appends its text."""
    c = text(c)
    hit = let(F.upper(c), lambda up: F.coalesce(*[F.when(up.rlike(p), F.lit(t)) for p, t in R.SYNONYM_TEXTS]))
    return F.concat_ws(" ", c, hit)


def repair_text(c):
    """N8."""
    c = F.translate(text(c), "�øØ", "   ")
    c = F.regexp_replace(c, r"(?iu)\bS\s*[ÉE]RIE\s*R\b", "SERIE REFORCADA")
    return F.regexp_replace(c, r"\bRECUCAO\b", "REDUCAO")


def drop_zeros(c):
    """Strip leading zeros, keeping one zero for an all-zero or blank code."""
    return F.coalesce(F.nullif(F.ltrim(F.trim(text(c)), F.lit("0")), F.lit("")), F.lit("0"))


def norm_code(c, mode="zeros"):
    """``zeros`` | ``int`` | ``digits`` | ``digits_zeros`` | ``compact``."""
    t = F.trim(text(c))
    if mode == "zeros":
        return drop_zeros(t)
    if mode == "digits":
        return F.regexp_replace(t, r"\D", "")
    if mode == "digits_zeros":
        d = F.regexp_replace(t, r"\D", "")
        return F.when(d == "", F.lit("")).otherwise(drop_zeros(d))
    number = t.try_cast("double")
    whole = F.when(F.isnan(number), F.lit(None)).otherwise(F.floor(F.abs(number)) * F.signum(number))
    whole = whole.cast("bigint").cast("string")
    if mode == "int":
        return F.coalesce(whole, t)
    if mode == "int_zeros":
        return F.coalesce(whole, drop_zeros(t))
    if mode == "compact":
        return F.when(t == "", t).otherwise(
            F.coalesce(whole, F.regexp_replace(F.upper(t), R.WS, "")))
    raise ValueError(mode)


def norm_sku(c):
    """N10."""
    return F.regexp_replace(strip_accents(F.upper(F.trim(text(c)))), "[^A-Z0-9]+", "")


def digits(c):
    return F.regexp_replace(text(c), r"\D", "")


def sku_prefix(c):
    return F.substring(norm_sku(c), 1, 4)


def ocr_code(c):
    """Confusable letters read as digits; 3 to 6 digits or null."""
    d = F.regexp_replace(F.translate(F.upper(F.trim(text(c))), "ODQIL|ZSBG", "0001112586"), r"\D", "")
    d = F.when(F.length(d) > 6, F.substring(d, 1, 6)).otherwise(d)
    return F.when(F.length(d) >= 3, d)


def _price_candidate(c):
    """One candidate of an OCR price to a double."""
    parts_dot = F.size(F.split(c, r"\."))
    comma = F.regexp_replace(F.regexp_replace(c, r",(?=.*,)", ""), r"\.", "")
    comma = F.replace(comma, F.lit(","), F.lit("."))
    dots = F.regexp_replace(c, r"\.(?=.*\.)", "")
    bare = F.regexp_replace(c, r"^(\d+)(\d\d)$", "$1.$2")
    return F.when(c.contains(","), comma).when(parts_dot > 2, dots) \
        .when(c.rlike(r"^\d{3,}$"), bare).otherwise(c).try_cast("double")


def ocr_price(c):
    """Candidate formats in order; first value within 0..999999.99."""
    s = F.replace(F.upper(F.trim(text(c))), F.lit(" "), F.lit(""))
    s = F.translate(F.replace(s, F.lit("R$"), F.lit("")), "ODQIL|SB", "00011158")
    s = F.replace(F.replace(s, F.lit(".."), F.lit(".")), F.lit(",,"), F.lit(","))
    return let(F.regexp_replace(s, r"[^0-9,.\-]", ""), _first_price)


def _first_price(s):
    money = F.concat(F.regexp_extract_all(s, F.lit(r"\d{1,3}(?:\.\d{3})*,\d{2}"), F.lit(0)),
                     F.regexp_extract_all(s, F.lit(r"\d+,\d{2}"), F.lit(0)),
                     F.regexp_extract_all(s, F.lit(r"\d+\.\d{2}"), F.lit(0)))
    blocks = F.filter(F.regexp_extract_all(s, F.lit(r"[\d.,]+"), F.lit(0)), lambda b: b.rlike(r"\d"))
    longest = F.transform(
        F.array_sort(F.transform(blocks, lambda b, i: F.struct((-F.length(b)).alias("k"), i.alias("i"), b.alias("b")))),
        lambda x: x["b"])
    cands = F.when(F.size(money) > 0, money).otherwise(longest)
    vals = F.filter(F.transform(cands, _price_candidate), lambda v: v.between(0, 999999.99))
    return F.get(vals, F.lit(0))


def br_number(c, dialect):
    """Brazilian number text to double; the dialect is never guessed.

    ``dot``     dot is always a thousands mark
    ``both``    dots go only when a comma is present, any spacing, ``R$`` allowed
    ``comma``   dots go when a comma is present
    ``last``    last separator is the decimal mark
    ``lone``    a lone dot is a thousands mark
    ``digits``  foreign characters dropped, then ``dot`` with ``comma`` as second try
    """
    t = F.regexp_replace(text(c), R.WS, "")
    has_comma = t.contains(",")
    no_dot = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    if dialect == "dot":
        out = no_dot
    elif dialect == "both":
        t = F.replace(t, F.lit("R$"), F.lit(""))
        no_dot = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        out = F.when(t.contains(","), no_dot).otherwise(t)
    elif dialect == "comma":
        out = F.when(has_comma, no_dot).otherwise(t)
    elif dialect == "lone":
        out = F.when(t.rlike(r"\d"), no_dot)
    elif dialect == "last":
        t = F.regexp_replace(F.regexp_replace(t, r"[Rr]\$", ""), r"[^0-9,.\-]", "")
        comma = F.replace(F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), r",(?=.*,)", ""),
                          F.lit(","), F.lit("."))
        out = F.when(t.contains(","), comma).otherwise(F.regexp_replace(t, r"\.(?=.*\.)", ""))
    elif dialect == "digits":
        t = F.regexp_replace(text(c), r"[^\d,.]", "")
        out = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return F.coalesce(out.try_cast("double"), F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))
    else:
        raise ValueError(dialect)
    return out.try_cast("double")


def positive_number(c):
    """N14."""
    t = F.regexp_replace(F.trim(text(c)), " ", "")
    v = F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
    return F.when((v > 0) & ~F.isnan(v), v)


def parse_percent(c):
    """N15."""
    t = F.regexp_replace(F.trim(text(c)), "[ %]", "")
    v = F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(v), v)


def _map(d):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def norm_unit(c):
    """N16."""
    u = F.nullif(F.rtrim(F.upper(F.trim(text(c))), F.lit(".")), F.lit(""))
    return F.coalesce(F.try_element_at(_map(R.UNIT_NAMES), u), u)


def unit_class(c):
    """N17."""
    u = F.upper(F.trim(text(c)))
    return F.coalesce(*[F.when(u.isin(v), F.lit(k)) for k, v in R.UNIT_CLASSES.items()],
                      F.lit("DESCONHECIDA"))


def company_key(c):
    """N18."""
    return squash(fold(F.upper(F.trim(text(c))), [(p, "") for p in R.COMPANY_SUFFIXES]))


def stem(w):
    """Plural S, then final A or O."""
    w = F.when((F.length(w) >= 5) & w.endswith("S"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.when((F.length(w) >= 4) & (w.endswith("A") | w.endswith("O")),
                  F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def words(c):
    """Runs of two or more plain capitals."""
    return F.regexp_extract_all(plain_upper(c), F.lit("[A-Z]{2,}"), F.lit(0))


def rule_key(c):
    """N20."""
    c = F.regexp_replace(F.upper(text(c)), r"NBR[\s\-]*\d+[\w/]*", "")
    return squash(F.regexp_replace(c, r"[°º\-./()]", " "))


def nullify(c):
    """Every spelling of "empty" becomes null."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none", "nat"), t)


def number_or_null(c):
    return F.when(~F.isnan(c), c)


def parse_bool(c):
    """N22."""
    return F.lower(F.trim(text(c))).isin("true", "1", "sim", "yes")


def parse_address(c):
    """City, state and postcode."""
    c = text(c)
    up = F.upper(c)
    cep = F.regexp_replace(F.regexp_extract(c, r"\b(\d{5}-?\d{3})\b", 1), r"\D", "")
    state = F.regexp_extract(up, r"[-/\s]([A-Z]{2})\b", 1)
    before = F.split(up, F.concat(F.lit("[-/]"), state)).getItem(0)
    before = F.trim(F.btrim(F.trim(before), F.lit("-")))
    lines = F.filter(F.transform(F.split(before, r"[\r\n]+"), F.trim), lambda x: x != "")
    city = F.when(state != "", F.initcap(F.lower(F.try_element_at(lines, F.lit(-1)))))
    return F.struct(F.coalesce(city, F.lit("")).alias("city"), state.alias("state"), cep.alias("postcode"))


def _longest(arr):
    s = F.array_sort(F.transform(arr, lambda b, i: F.struct((-F.length(b)).alias("k"), i.alias("i"), b.alias("b"))))
    return F.get(s, F.lit(0))["b"]


def doc_number(name, crm_number=None):
    """Longest digit run of 4+, the register's number, else the longest run."""
    base = F.regexp_replace(text(name), r"(?<=[^.])\.[^.]*$", "")
    long_run = _longest(F.regexp_extract_all(base, F.lit(r"\d{4,}"), F.lit(0)))
    any_run = _longest(F.regexp_extract_all(base, F.lit(r"\d+"), F.lit(0)))
    crm = F.nullif(crm_number.cast("string"), F.lit("")) if crm_number is not None else F.lit(None).cast("string")
    return F.coalesce(long_run, crm, any_run, F.lit(""))


def safe_stem(c):
    """N25."""
    c = F.regexp_replace(F.trim(text(c)), r"[\\/:*?\"<>|]+", "_")
    c = F.regexp_replace(F.regexp_replace(c, R.WS, "_"), "_+", "_")
    return F.coalesce(F.nullif(F.btrim(c, F.lit("_.")), F.lit("")), F.lit("oc"))


def validity_order(c):
    """``1 SEM - 26`` becomes 20261."""
    up = F.upper(text(c))
    half = F.regexp_extract(up, r"(\d)\s*SEM.*?(\d{2,4})", 1).try_cast("int")
    year = F.regexp_extract(up, r"(\d)\s*SEM.*?(\d{2,4})", 2).try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    return F.coalesce(year * 10 + half, F.lit(0))


def format_qty(q):
    """Whole number, or at most three decimals."""
    whole = F.abs(q - F.round(q)) < 1e-9
    frac = F.rtrim(F.rtrim(F.format_string("%.3f", q), F.lit("0")), F.lit("."))
    return F.when(q.isNull(), F.lit("")).when(whole, F.rint(q).cast("bigint").cast("string")).otherwise(frac)


def hours_text(h):
    """Minutes, hours or days."""
    days = F.replace(F.format_string("%.1f", h / 24), F.lit("."), F.lit(","))
    return F.when(h < 1, F.concat(F.greatest(F.lit(1), F.rint(h * 60).cast("bigint")).cast("string"), F.lit(" min"))) \
        .when(h < 48, F.concat(F.rint(h).cast("bigint").cast("string"), F.lit(" h"))) \
        .when(h.isNotNull(), F.concat(days, F.lit(" d")))


def undouble(c):
    """Drop a doubled half or a doubled part."""
    t = F.trim(text(c))
    parts = F.split(t, r"\s{2,}")
    n = F.length(t)
    half = F.floor(n / 2).cast("int")
    a = F.trim(F.substring(t, F.lit(1), half))
    b = F.trim(F.substring(t, half + 1, n))
    return F.when((F.size(parts) == 2) & (F.upper(parts[0]) == F.upper(parts[1])), parts[0]) \
        .when((n % 2 == 0) & (F.upper(a) == F.upper(b)), a).otherwise(t)


def norm_line(c):
    """Control characters out (tabs and breaks are spaces), squeezed."""
    c = F.translate(text(c), "\t\n", "  ")
    return squash(F.regexp_replace(c, r"\p{C}", ""))


def cut_boilerplate(c):
    """Cut at the first boilerplate mark when 8 or more characters remain."""
    c = text(c)
    pat = "(?iu)" + R.BOILERPLATE_MARKS
    pos = F.regexp_instr(c, F.lit(pat))
    head = F.trim(F.substring(c, F.lit(1), pos - 1))
    ok = (pos > 0) & (F.length(head) >= 8)
    return F.struct(F.when(ok, head).otherwise(c).alias("text"),
                    F.when(ok, F.substring(c, pos, F.lit(80))).alias("removed"),
                    ((pos > 0) & ~ok).alias("too_short"))


def doc_signature(c, size=400):
    """N32."""
    c = F.regexp_replace(F.upper(text(c)), r"\d+", "#")
    return F.substring(squash(F.regexp_replace(c, "[^A-Z# ]+", " ")), 1, size)


def search_key(c):
    """N33."""
    return F.lower(strip_accents(c))


def swap_synonyms(c):
    """Accent-insensitive whole-word swaps."""
    left, right = r"(?<![\p{L}])", r"(?![\p{L}])"
    c = F.regexp_replace(text(c), "(?iu)" + left + "SANIT[AÁÀÂÃ]RIO" + right, "ESGOTO")
    return F.regexp_replace(c, "(?iu)" + left + "BORRACHA" + right, "VEDACAO")
