"""Writers (S8, S12-S14, S17)."""
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage


def write_price_table(df, path):
    """An import replaces its own (client, validity) partitions and no others."""
    df.repartition("client", "validity").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("client", "validity").parquet(path)


def write_processed(df, path):
    """S12."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def entry_sheet(df):
    """Description, unit, code and quantity with their fallbacks."""
    blank = lambda c: T.nullify(F.col(c))
    return df.select(F.coalesce(blank("matched_description"), blank("description"), F.lit("")).alias("description"),
                     F.coalesce(blank("final_unit"), blank("sale_unit"), blank("unit"), F.lit("UN")).alias("unit"),
                     "product_code", F.coalesce("final_qty", "adjusted_qty").alias("qty"))


def write_validation(df, approved_path, review_path):
    """Two sheets of one frame, which is worked out once and written to the shared folder in between."""
    df = cut_lineage(df)
    df.filter("approved").write.mode("overwrite").option("sep", ";").option("header", True).csv(approved_path)
    df.filter("not approved").write.mode("overwrite").option("sep", ";").option("header", True).csv(review_path)


def save_process(df, path):
    """One row per process; its lines stay rows, partitioned by client, so no process is gathered in memory."""
    df.write.mode("append").partitionBy("client").parquet(path)


def load_process(spark, path, process_id):
    return spark.read.parquet(path).filter(F.col("process_id") == process_id)
