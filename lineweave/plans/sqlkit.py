"""Small builders for the DuckDB side of the checks."""
from ..functions import rules as R


def q(s):
    return "'" + s.replace("'", "''") + "'"


def rx(x, pattern, repl=""):
    return f"regexp_replace({x}, {q(pattern)}, {q(repl.replace('$', chr(92)))}, 'g')"


def fold(x, rules):
    for p, r in rules:
        x = rx(x, p, r)
    return x


def has(x, pattern):
    return f"regexp_matches({x}, {q(pattern)})"


def squash(x):
    return f"trim({rx(x, R.WS, ' ')})"


def norm_text(x):
    return squash(f"translate(upper(replace({x}, 'ß', 'ss')), {q(R.ACCENTED + '�º°')}, {q(R.UNACCENTED + '   ')})")


def plain_upper(x):
    return f"upper(strip_accents(translate(replace({x}, 'ß', 'ss'), 'ºª²³¹', 'oa231')))"


def clean_for_match(x):
    x = rx(rx(rx(norm_text(x), R.NOISE_PREFIX), R.STANDARD_NUMBER), R.BOILERPLATE_TAIL)
    x = fold(x, R.ABBREVIATIONS)
    return squash(rx(f"(SELECT CASE WHEN {has('t', chr(92) + 'bCPVC' + chr(92) + 'b')} AND NOT contains(t, 'ULTRATERM') "
                     f"THEN replace(t, 'CPVC', 'ULTRATERM') ELSE t END FROM (SELECT {x} AS t))", r"[()\[\]]", " "))


def starts(x, pattern):
    """1-based start of the first hit of ``pattern``, 0 when there is none."""
    return (f"CASE WHEN {has(x, pattern)} THEN length(regexp_extract({x}, {q('(?s)^(.*?)(?:' + pattern + ')')}, 1)) + 1 "
            f"ELSE 0 END")


def category(x, table):
    items = ", ".join(f"struct_pack(p := {starts(x, p)}, o := {i}, n := {q(n)})" for i, (n, p) in enumerate(table))
    return f"(list_sort(list_filter([{items}], lambda s: s.p > 0))[1]).n"


def joined(x):
    return f"array_to_string({x}, ',')"


def ints(x, pattern, group=1):
    return f"list_transform(regexp_extract_all({x}, {q(pattern)}, {group}), lambda v: CAST(v AS INTEGER))"


def lcs(a, b):
    """Longest common subsequence length: one list of row values per character of ``a``."""
    return (f"list_last(list_reduce(list_prepend(list_resize([]::INTEGER[], length({b}) + 1, 0), "
            f"list_transform(range(1, length({a}) + 1), lambda i: [CAST(i AS INTEGER)])), "
            f"lambda dp, i: list_reduce(list_prepend([0], list_transform(range(1, length({b}) + 1), lambda j: "
            f"[CASE WHEN substr({a}, i[1], 1) = substr({b}, j, 1) THEN dp[j] + 1 ELSE dp[j + 1] END])), "
            f"lambda row, v: list_append(row, greatest(row[-1], v[1])))))")


def ratio(a, b):
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0 * {lcs(a, b)} / (length({a}) + length({b})) END)"


def sort_words(x):
    return f"array_to_string(list_sort(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')), ' ')"
