"""Registry of runnable queries and their SQL oracles."""
import re

from .standins import FRAGMENTS

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

QUERIES = {}
ORACLES = {}


def _expand(sql, table_name):
    """Inline fragments; given tables are named by ``table_name``."""
    def sub(m):
        name = m.group(1)
        if name in FRAGMENTS:
            return "(" + _expand(FRAGMENTS[name], table_name) + ") AS " + name
        return table_name(name)
    return re.sub(r"\{(" + "|".join(list(FRAGMENTS) + TABLES) + r")\}", sub, sql)


class Source:
    """The given tables of one folder, and the fragments derived from them."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir
        self.prefix = "lw_" + re.sub(r"\W", "_", sf_dir) + "_"

    def table(self, name):
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _view(self, name):
        self.table(name).createOrReplaceTempView(self.prefix + name)
        return self.prefix + name

    def sql(self, query):
        return self.spark.sql(_expand(query, self._view))

    def __getattr__(self, name):
        if name in FRAGMENTS:
            return self.sql(FRAGMENTS[name])
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def query(key, oracle=None):
    """Register ``fn(source) -> DataFrame`` and, when given, its DuckDB SQL."""
    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = _expand(oracle, lambda n: n)
        return fn
    return wrap
