"""Line-wise text files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.text import strip

#: Files whose splits' counts go to all tasks.
FEW = 10_000


def lines(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """path, ord (line number from 1) and line of a text file, blank lines left out.

    A large file is split among tasks. Its lines are counted by split; the counts of the splits before it, summed by file,
    are where a split's numbers begin, and inside a split lines are numbered as they are read. So no task and no row holds a whole file.
    With ``numbered=False`` ord is only a unique number, and lines are read once instead of twice.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    if numbered:
        # a split is read by one task from its first line to its last, so its places follow one another; both readings plan the same splits
        counted = read.groupBy(F.col("path").alias("of"), F.col("split").alias("from")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
        before = F.sum("n").over(W.partitionBy("of").orderBy("from")) - F.col("n")
        starts = counted.select("of", "from", (before - F.col("first") + 1).alias("shift"))
        # a row a split; where the files are few those are few too, and the lines needn't be shuffled by file and split
        starts = F.broadcast(starts) if len(read.inputFiles()) <= FEW else starts
        joined = read.join(starts, (F.col("path") == F.col("of")) & (F.col("split") == F.col("from")))
        rows = joined.select("path", (F.col("at") + F.col("shift")).alias("ord"), "line")
    else:
        rows = read.select("path", F.col("at").alias("ord"), "line")
    return rows.where(strip(F.col("line")) != "")


def read_id_manifest(spark: SparkSession, path: str) -> DataFrame:
    """ord and id: one id a line as it stands, without lines that are blank or begin with '#'."""
    return lines(spark, path).where(~F.col("line").startswith("#")).select("ord", F.col("line").alias("id"))
