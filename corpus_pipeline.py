"""From raw documents to a training mix: quality, near-duplicates, benchmark leaks, personal data, source weights.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows that its predecessor kept; rows are matched by
a hash of the id and text where an operator's verdict has to come back to them, so null and repeated ids are fine.
"""
from pyspark.sql import functions as F

from lineweave.llm.decontam import leaks
from lineweave.llm.minhash import near_duplicates
from lineweave.llm.mixing import mix
from lineweave.llm.pii import detect, redact
from lineweave.llm.quality import good_documents
from lineweave.llm.shared import shared_table, table


def _row():
    return F.xxhash64("doc_id", "text")


def quality(spark, docs, sf_dir):
    """Documents that the base or a risk-controlled rule rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """Of each class of near-duplicates the document of the least id stays, once (null ids come last, equal ids by content)."""
    keyed = docs.withColumn("_row", _row())
    classes = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).distinct().withColumnRenamed("doc_id", "_row")
    names = keyed.select("_row", F.col("doc_id").alias("_id")).distinct()
    first = classes.join(names, "_row").groupBy("class_id").agg(F.min(F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "_row")).alias("_first"))
    kept = shared_table(first.select(F.col("_first._row").alias("_row")), "firsts")
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    found = leaks(docs.select(_row().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = shared_table(found.select(F.col("doc_id").alias("_row")).distinct(), "leaks")
    return docs.withColumn("_row", _row()).join(bad, "_row", "left_anti").drop("_row")


def personal_data(spark, docs, sf_dir):
    """Every span found is replaced by its kind; all documents stay."""
    found = detect(docs.select(_row().alias("doc_id"), "text")).filter(F.size("found") > 0)
    found = shared_table(found.select(F.col("doc_id").alias("_row"), F.col("found").alias("_spans")).dropDuplicates(["_row"]), "spans")
    text = F.when(F.col("_spans").isNotNull(), redact(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    out = docs.withColumn("_row", _row()).join(found, "_row", "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixture(spark, docs, sf_dir):
    """How often the mix takes each document that is left, and its words."""
    return mix(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("personal data", personal_data), ("mixing", mixture)]
ORACLE_SQL = None  # near-duplicates, latent retrieval and boosted trees aren't SQL; tests hold the stages against brute force


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs, "stage")
    return docs
