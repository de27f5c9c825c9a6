"""URL filters: pattern rules indexed by their rarest literal token.

Every rule has a host suffix, a path prefix and a regular expression over ``host path``, and literal tokens that any
URL it fits must hold.  Token counts over all URLs name each rule's rarest token; a URL's tokens fetch the rules filed
under them, and only those fetched run their expression.
"""
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

TOKEN = r"[^\x00-\x2C\x2E\x2F\x3A-\x40]+"  # runs without ASCII punctuation other than the hyphen

#: (host, path, verdict): a rule fits the host and all its subdomains where the path starts with its own.
HOST_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
              ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: (name, literal tokens, expression over host and path, verdict): used where no host rule fits.
PATTERN_RULES = [("spam farm", ["spam-farm"], r"^([^ /]*\.)?spam-farm\.", "block"),
                 ("cheap pills", ["cheap-pills"], r"^([^ /]*\.)?cheap-pills\.", "block"),
                 ("casino", ["casino"], r"^([^ /]*\.)?casino\.", "block"),
                 ("tracker", ["click", "track"], r"^[^/]* [^?#]*/click/track(/|$)", "block")]


def _tokens(text):
    return [t for t in re.findall(TOKEN, text)]


def rule_rows(host_rules, pattern_rules):
    """(rule_id, rule, kind, length, tokens, expression, verdict) of both kinds.

    The last token of a path prefix may be the head of a longer one in the URL, unless a slash ends it; it isn't
    indexed then.
    """
    rows = []
    for host, path, verdict in host_rules:
        literal = _tokens(host) + (_tokens(path) if path.endswith("/") else _tokens(path.rsplit("/", 1)[0]))
        rows.append((f"{host}{path}", "host", len(host) + len(path), sorted(set(literal)),
                     rf"^(?:[^/]*\.)?\Q{host}\E \Q{path}\E", verdict))
    for name, tokens, pattern, verdict in pattern_rules:
        rows.append((name, "pattern", len(name), sorted(set(tokens)), pattern, verdict))
    return [(i, *r) for i, r in enumerate(rows)]


def with_parts(pages: DataFrame) -> DataFrame:
    """Host and path of each URL; null or without ``://``: both empty."""
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    cut = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 0)
    host = F.translate(F.regexp_extract(cut, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ok = F.coalesce(F.contains("url", F.lit("://")), F.lit(False))
    return pages.withColumns({"host": F.when(ok, host).otherwise(""), "path": F.when(ok, F.regexp_extract(cut, r"(?s)^[^/?#]*(.*)$", 1)).otherwise("")})


def judge_urls(pages: DataFrame, host_rules=None, pattern_rules=None) -> DataFrame:
    """``pages`` (page_id, url) as (page_id, host, path, rule, verdict).

    One row per given row, repeated and null ones too; a URL that no rule fits is allowed.  The longest host rule wins
    (ties: first given), pattern rules speak only where no host rule does.  Rules join as a table: Spark broadcasts them
    only while their known size is under its own threshold.
    """
    spark = pages.sparkSession
    rows = rule_rows(HOST_RULES if host_rules is None else host_rules, PATTERN_RULES if pattern_rules is None else pattern_rules)
    rules = spark.createDataFrame(rows, "rule_id int, name string, kind string, length int, tokens array<string>, pattern string, verdict string")
    judged = with_parts(pages.select("page_id", "url"))
    distinct = judged.select("host", "path").distinct().withColumn("line", F.concat_ws(" ", "host", "path"))
    tokens = F.array_distinct(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)))
    exploded = distinct.select("host", "path", "line", F.explode(tokens).alias("token"))
    literal = rules.select("rule_id", F.explode("tokens").alias("token"))
    counts = exploded.join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = (literal.join(counts, "token", "left").groupBy("rule_id")
              .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token")))
    index = rules.join(rarest, "rule_id").drop("tokens")
    rank = F.struct((F.col("kind") == "host").alias("host_first"), "length", (-F.col("rule_id")).alias("earliest"))
    found = (exploded.join(index, "token").filter(F.regexp_like("line", F.col("pattern"))).groupBy("host", "path")
             .agg(F.max_by(F.struct("name", "kind", "verdict"), rank).alias("r")))
    return (judged.join(found, ["host", "path"], "left")
            .select("page_id", "host", "path", F.when(F.col("r.kind") == "host", F.col("r.name")).alias("rule"),
                    F.coalesce("r.verdict", F.lit("allow")).alias("verdict"), F.when(F.col("r.kind") == "pattern", F.col("r.name")).alias("pattern")))


def op4_url_filters(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, s, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m(name, e, n) AS (VALUES ('spam farm', '^([^ /]*\.)?spam-farm\.', 1), ('cheap pills', '^([^ /]*\.)?cheap-pills\.', 2), ('casino', '^([^ /]*\.)?casino\.', 3),
                         ('tracker', '^[^ ]*/click/track(/|$)', 4)),
k AS (SELECT host, path, max_by(h || s, length(h) + length(s)) AS rule, max_by(v, length(h) + length(s)) AS verdict
      FROM (SELECT DISTINCT host, path FROM p) q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY ALL),
b AS (SELECT host, path, max_by(name, length(name)) AS pattern FROM (SELECT DISTINCT host, path FROM p) q JOIN m ON regexp_matches(host || ' ' || path, e) GROUP BY ALL)
SELECT page_id, host, path, rule, COALESCE(verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM p LEFT JOIN k USING (host, path) LEFT JOIN b USING (host, path)
"""
