"""Training rows from records: the rows of RL and chat files, and oversampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.labels import index_of
from plumbline.functions.text import sft_target, video_path, with_video_token
from plumbline.operators.selection import with_rank
from plumbline.sources.shared import free_name
from plumbline.taxonomy import Taxonomy


def label_values(taxonomy: Taxonomy, label_format: str) -> Column:
    """Labels as ids, or as 1-based places of the categories."""
    if label_format == "id":
        return F.col("labels")
    if label_format == "index":
        return F.transform("labels", lambda x: (index_of(x, taxonomy) + 1).cast("bigint"))
    raise ValueError("label_format is 'index' or 'id'")


def rl_rows(records: DataFrame, taxonomy: Taxonomy, prompt: str, label_format: str = "id", path_prefix: str | None = None) -> DataFrame:
    """ord, id, video_path, prompt, response."""
    task = F.lit(with_video_token(prompt))
    return records.select("ord", "id", video_path(F.col("video"), path_prefix).alias("video_path"), task.alias("prompt"), label_values(taxonomy, label_format).alias("response"))


def chat_rows(records: DataFrame, taxonomy: Taxonomy, prompt: str, target_style: str, block_name: str | None = None, label_format: str = "id", path_prefix: str | None = None, extra_fields: tuple[str, ...] = ()) -> DataFrame:
    """ord, id, messages (a user's and an assistant's), videos, labels, and extra columns, which must be there."""
    lacking = [f for f in extra_fields if f not in records.columns]
    if lacking:
        raise KeyError(f"records have no field {lacking[0]!r}")
    turn = lambda content, role: F.struct(content.alias("content"), F.lit(role).alias("role"))
    messages = F.array(turn(F.lit(with_video_token(prompt)), "user"), turn(sft_target(F.col("labels"), taxonomy, target_style, block_name), "assistant"))
    return records.select("ord", "id", messages.alias("messages"), F.array(video_path(F.col("video"), path_prefix)).alias("videos"), label_values(taxonomy, label_format).alias("labels"), *extra_fields)


def oversample(rows: DataFrame, class_index: int, labels: str = "response") -> DataFrame:
    """The rows and, after them, a copy of each whose labels contain the 1-based class, in order.

    A copy of x is named ``x__aug_cls<k>_<n>``, n being the least counter that neither a row nor an earlier copy has: the
    j-th copy of x gets the j-th counter that no row has. The suffix decodes uniquely, so copies of x meet
    only what is named after x.

    The i-th taken counter c of x has c - i free ones below it. So the j-th free counter is j and one more for each taken counter with fewer than j free ones
    below it: taken counters, by that gap, and copies, by j, are merged in order under each x, and a running sum counts the taken ones passed. Nothing is
    gathered, however many counters one x has.
    """
    has = F.exists(F.col(labels).cast("array<string>"), lambda v: v.rlike(r"^\d+$") & (v.try_cast("bigint") == class_index))
    suffix, row = f"__aug_cls{class_index}_", F.struct(*rows.columns)
    pattern = rf"^(?s)(.*){suffix}([1-9]\d*)$"
    named = rows.where(F.col("id").contains(suffix)).select(F.regexp_extract("id", pattern, 1).alias("x"), F.regexp_extract("id", pattern, 2).try_cast("bigint").alias("n"))
    gap = F.col("n") - F.row_number().over(W.partitionBy("x").orderBy("n"))
    taken = named.where("n is not null").distinct().select("x", gap.alias("at"), F.lit(1).alias("passed"), F.lit(None).cast(rows.select(row).schema[0].dataType).alias("row"))
    hits = rows.where(has).select(F.col("id").alias("x"), F.row_number().over(W.partitionBy("id").orderBy("ord")).cast("bigint").alias("at"), F.lit(0).alias("passed"), row.alias("row"))
    so_far = W.partitionBy("x").orderBy("at", "passed").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = hits.unionByName(taken).withColumn("n", F.col("at") + F.sum("passed").over(so_far)).where("passed = 0")
    copies = merged.select("row.*", F.concat("x", F.lit(suffix), F.col("n").cast("string")).alias("__name")).withColumn("id", F.col("__name")).drop("__name")
    top = rows.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("__top"))
    rank = free_name(rows, "__rank")
    moved = with_rank(copies, name=rank).crossJoin(F.broadcast(top)).withColumn("ord", (F.col("__top") + F.col(rank)).cast("bigint")).select(*rows.columns)
    return rows.unionByName(moved)


def distinct_prompts(rows: DataFrame) -> DataFrame:
    """The prompts of a training file; an export needs exactly one, so two are enough to see."""
    return rows.select("prompt").distinct().limit(2)
