"""Other projects' annotation files as canonical records (ord or sort keys, id, video, labels, extra columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.labels import resolve_labels
from plumbline.operators.selection import with_rank
from plumbline.sources.arrays import array_items
from plumbline.sources.lines import lines
from plumbline.sources.records import DataError, load_json_lines
from plumbline.taxonomy import Taxonomy


def _none() -> Column:
    return F.array().cast("array<string>")


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """ord from 1 by the sort keys."""
    ranked = with_rank(rows.withColumn("__keys", F.struct(*keys)).drop(*keys), "__keys")
    return ranked.withColumn("ord", (F.col("rank") + 1).cast("bigint")).drop("__keys", "rank")


def folder_annotations(spark: SparkSession, root: str, taxonomy: Taxonomy, video_type: str = "full", video_prefix: str = "") -> DataFrame:
    """Folders of full.json (the videos) and full_gt.json (their labels; the last entry of a video counts)."""
    docs = array_items(spark, root).withColumn("parts", F.split("path", "/"))
    docs = docs.select(F.element_at("parts", -2).alias("folder"), F.element_at("parts", -1).alias("name"), "place", F.parse_json("item").alias("item"))
    get = lambda p, kind: F.try_variant_get("item", p, kind)
    truth = docs.where("name = 'full_gt.json'").select(F.col("folder").alias("of"), F.coalesce(get("$.video_path", "string"), F.lit("")).alias("key"), "place", get("$.labels", "array<string>").alias("found"), get("$.subcategories", "array<string>").alias("sub"))
    truth = truth.groupBy("of", "key").agg(F.max_by(F.struct("found", "sub"), "place").alias("t"))
    videos = docs.where("name = 'full.json'").select("folder", "place", F.coalesce(get("$.video", "string"), F.lit("")).alias("v"))
    if video_type != "all":
        videos = videos.where(F.col("v").startswith(f"dataset/{video_type}/"))
    joined = videos.join(truth, (F.col("folder") == F.col("of")) & (F.col("v") == F.col("key")), "left")
    path = F.regexp_replace("v", "^dataset/", "")
    out = joined.select(
        "folder",
        "place",
        path.alias("id"),
        F.concat(F.lit(video_prefix), path).alias("video"),
        resolve_labels(F.coalesce("t.found", _none()), taxonomy).alias("labels"),
        F.coalesce("t.sub", _none()).alias("subcategories"),
    )
    return _numbered(out, "folder", "place")


def benchmark_annotations(spark: SparkSession, root: str, taxonomy: Taxonomy, benign_labels: str, sources: tuple[str, ...] = ("real", "genai"), video_prefix: str = "", skip_unknown_video: bool = True) -> DataFrame:
    """JSON files below the sources, sorted by path component by component; labels from the item or its folder.

    benign_labels: 'folder' leaves benign videos their folder's category, 'empty' takes it from them.
    """
    if benign_labels not in ("folder", "empty"):
        raise ValueError("benign_labels is 'folder' or 'empty'")
    docs = None
    for s in sources:
        try:
            found = array_items(spark, f"{root}/{s}", unwrap=True)
        except Exception as e:  # a source that isn't there has no files
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        docs = found if docs is None else docs.unionByName(found)
    if docs is None:
        raise DataError(f"{root} has none of {', '.join(sources)}")
    rows = docs.select(F.split("path", "/").alias("sort"), "place", F.parse_json("item").alias("item")).where(F.schema_of_variant("item").startswith("OBJECT"))
    get = lambda p, kind: F.try_variant_get("item", p, kind)
    raw = F.coalesce(F.nullif(get("$.video_path", "string"), F.lit("")), get("$.videoPath", "string"), get("$.video", "string"))
    rows = rows.withColumn("raw", raw).where(F.coalesce("raw", F.lit("")) != "")
    rows = rows.withColumn("id", F.array_join(T.without_first(F.split("raw", "/"), "videos"), "/"))
    if skip_unknown_video:
        rows = rows.where(~F.col("id").endswith(".unknown_video"))
    given = lambda p: F.when(F.size(get(p, "array<string>")) > 0, get(p, "array<string>"))
    sub = F.coalesce(given("$.subcategories"), T.path_subcategory(F.col("id")))
    rows = rows.withColumn("subcategories", sub)
    labels = F.coalesce(given("$.labels"), T.folder_category(F.col("id")))
    if benign_labels == "empty":
        labels = F.when(F.col("subcategories") == F.array(F.lit("benign")), _none()).otherwise(labels)
    harm = F.when(F.lower("id").contains("benign"), 0).otherwise(1)
    out = rows.select("sort", "place", "id", F.concat(F.lit(video_prefix), "id").alias("video"), resolve_labels(labels, taxonomy).alias("labels"), "subcategories", harm.alias("harmfulness"))
    return _numbered(out, "sort", "place")


def label_list(spark: SparkSession, path: str, taxonomy: Taxonomy, video_path: str, video_prefix: str = "") -> DataFrame:
    """Lines ``<name>_label_<codes>``; the id is the line with ``.mp4``, the video the id or its base name."""
    if video_path not in ("id", "basename"):
        raise ValueError("video_path is 'id' or 'basename'")
    rows = lines(spark, path).withColumn("line", T.strip(F.col("line")))
    bad = rows.where(~F.col("line").contains("_label_")).orderBy("ord").limit(1).collect()
    if bad:
        raise DataError(f"{bad[0].path}:{bad[0].ord}: missing '_label_' in {bad[0].line!r}")
    codes = T.list_codes(F.element_at(F.split("line", "_label_", 2), 2))
    vid = F.when(F.col("line").endswith(".mp4"), F.col("line")).otherwise(F.concat("line", F.lit(".mp4")))
    video = vid if video_path == "id" else T.basename(vid)
    return rows.select("ord", vid.alias("id"), F.concat(F.lit(video_prefix), video).alias("video"), resolve_labels(codes, taxonomy).alias("labels"))


def rl_parquet(spark: SparkSession, path: str, taxonomy: Taxonomy, path_prefix: str | None = None, keep_prompt_hash: bool = True) -> DataFrame:
    """Training rows (id, video_path, prompt, response) as records."""
    rows = spark.read.parquet(path)
    columns = [F.col("id").cast("string").alias("id"), T.strip_prefix(F.col("video_path"), path_prefix).alias("video"), resolve_labels(F.col("response").cast("array<string>"), taxonomy).alias("labels")]
    if keep_prompt_hash:
        columns.append(F.sha2("prompt", 256).alias("source_prompt_sha256"))
    return rows.select(F.monotonically_increasing_id().alias("ord"), *columns)


def chat_jsonl(spark: SparkSession, path: str, taxonomy: Taxonomy, path_prefix: str | None = None, extra_fields: tuple[str, ...] = ()) -> DataFrame:
    """Chat rows (id, messages, videos, labels) as records; each has exactly one video."""
    fields = "".join(f", `{f}` variant" for f in extra_fields)
    rows = load_json_lines(spark, path, f"id string, videos array<string>, labels array<string>{fields}")
    bad = rows.where("coalesce(size(videos), 0) <> 1").orderBy("ord").limit(1).collect()
    if bad:
        raise DataError(f"{path}:{bad[0].ord}: exactly one video is needed")
    labels = resolve_labels(F.coalesce("labels", _none()), taxonomy)
    return rows.select("ord", "id", T.strip_prefix(F.element_at("videos", 1), path_prefix).alias("video"), labels.alias("labels"), *extra_fields)
