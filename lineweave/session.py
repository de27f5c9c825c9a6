"""Session set-up for local runs and tests.  A cluster supplies its own session."""
import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus=8, name="lineweave"):
    return (SparkSession.builder.master(f"local[{cpus}]").appName(name)
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def checkpoint_dir(spark):
    """The shared folder the cluster names.  Only a local session may go without one and gets a private folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if named is None and not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = named or tempfile.mkdtemp(prefix="lineweave-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df):
    """Write ``df`` to the shared checkpoint folder and continue from there.

    Attribute tables go through here: they are read several times, and a join
    key computed from them must not be pushed back down as a filter, which would
    inline every pattern many times over.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
