"""Readers: delimited files, code maps, price tables, JSON logs."""
import unicodedata

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import text as T

REQUIRED = ["product_code", "description", "norm_description", "category", "is_tube"]


def read_catalogue(spark, path, required=REQUIRED):
    """Semicolon CSV with a fixed set of columns; a missing one is an error."""
    df = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def sniff_delimiter(spark, path, marks=";,\t|", encoding="ISO-8859-1"):
    """The mark that occurs most in the first line; only that line is read."""
    line = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    first = line[0][0] if line else ""
    return max(marks, key=first.count)


def read_delimited(spark, path, encoding="ISO-8859-1"):
    return spark.read.csv(path, sep=sniff_delimiter(spark, path), header=True, encoding=encoding)


def read_csv_robust(spark, path):
    """S3: separators and encodings in order; the first readable file with a column wins.

    Spark reads bytes that aren't UTF-8 as replacement characters without an error, so one pass over the lines looks for them.
    """
    broken = not spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()
    for sep in (";", ","):
        try:
            df = spark.read.csv(path, sep=sep, header=True, encoding="ISO-8859-1" if broken else "UTF-8")
            if df.columns:
                return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
        except AnalysisException:
            continue
    raise ValueError(f"unreadable file: {path}")


def name_key(name):
    s = unicodedata.normalize("NFD", str(name or "").strip().lower())
    s = "".join("_" if c in " -./\\" else c for c in s if unicodedata.category(c) != "Mn")
    while "__" in s:
        s = s.replace("__", "_")
    return s.strip("_")


def resolve_columns(df, spec):
    """Rename columns by candidate lists over normalised names; the first candidate present wins."""
    have = {}
    for c in df.columns:
        have.setdefault(name_key(c), c)
    picked = {out: next((have[name_key(c)] for c in cands if name_key(c) in have), None) for out, cands in spec.items()}
    return df.select(*[(F.col(f"`{src}`") if src else F.lit(None).cast("string")).alias(out) for out, src in picked.items()])


def read_code_map_regional(df, states=("PR", "SC", "RS", "MT", "MS", "GO", "DF"), keys=("client_code", "product_code")):
    """Regional prices as rows; ``#N/D`` and other text become null."""
    have = [s for s in states if s in df.columns]
    clean = df.select(*keys, *[F.replace(F.replace(F.col(s).cast("string"), F.lit("#N/D"), F.lit("")), F.lit(","), F.lit(".")).try_cast("double").alias(s) for s in have])
    return clean.unpivot(list(keys), have, "state", "price")


def import_price_table(raw, layout):
    """Positional columns from the layout; rows without description or with no positive price go."""
    cols = raw.columns
    df = raw
    if "first_row" in layout:
        df = df.filter(F.col(layout.get("row_column", "row_ord")) >= layout["first_row"])
    out = {k: F.col(f"`{cols[i]}`") for k, i in layout["columns"].items()}
    price = T.br_number(out["price"].cast("string"), "both")
    df = df.select(F.lit(layout["client"]).alias("client"), F.lit(layout["validity"]).alias("validity"),
                   T.norm_code(F.replace(out["product_code"].cast("string"), F.lit(","), F.lit(".")), "int").alias("product_code"),
                   T.squash(T.text(out["description"])).alias("description"), price.alias("price"), F.col(layout.get("row_column", "row_ord")).alias("row_ord"))
    ok = (F.col("description") != "") & (F.col("price") > 0)
    if layout.get("code_required"):
        ok = ok & (F.col("product_code") != "")
    return df.filter(ok)


SHADOW_SCHEMA = ("ts string, descricao_oc string, motor_atual struct<codigo:string,tipo_match:string,score:double>, "
                 "motor_novo struct<codigo:string,tipo_match:string,score:double>, concordam boolean, elapsed_ms double")


def read_shadow_log(spark, path):
    """JSON lines; a broken line gives nulls, not an error."""
    return spark.read.schema(SHADOW_SCHEMA).option("mode", "PERMISSIVE").json(path)


def read_json_array(spark, path, schema=None):
    """One JSON array per file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)
