"""Canonical records: JSON lines with id, video, labels and any other fields.

Rows keep their order in ``ord``; other fields stay in the variant column ``extra``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.labels import in_order, label_id
from plumbline.sources.lines import lines
from plumbline.sources.shared import discard, free_name, written
from plumbline.taxonomy import Taxonomy

REQUIRED = ("id", "video", "labels")


class DataError(ValueError):
    """Input rows that can't be taken as they are."""


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("NONE"))


def parse_records(rows: DataFrame, taxonomy: Taxonomy, line: str = "line") -> DataFrame:
    """The rows with id, video, labels (ids in order), extra, and error (null for a good record).

    Whole numbers and text are ids and labels, booleans aren't; two labels of one category are an error.
    """
    taken = {k: free_name(rows, f"__{k}") for k in ("data", "whole", "text_id", "text_video", *(f"{x}_{k}" for x in ("part", "kind") for k in REQUIRED), "spelled", "named", "found")}
    of = lambda k: F.col(taken[k])
    parse = lambda df, **columns: df.withColumns({taken[k]: c for k, c in columns.items()})
    get = lambda k, kind: F.try_variant_get(of("data"), f"$.{k}", kind)
    # step by step, each in columns of its own: in one expression a line would be parsed again for every use of it
    read = parse(rows, data=F.try_parse_json(F.col(line)))
    read = parse(read, whole=_kind(of("data")), text_id=get("id", "string"), text_video=get("video", "string"), **{f"part_{k}": get(k, "variant") for k in REQUIRED})
    read = parse(read, spelled=F.transform(get("labels", "array<variant>"), _spelling), **{f"kind_{k}": _kind(of(f"part_{k}")) for k in REQUIRED})
    read = parse(read, named=F.transform(of("spelled"), lambda s: F.coalesce(label_id(s, taxonomy), F.lit(""))))  # no id is empty
    read = parse(read, found=F.coalesce(in_order(of("named"), taxonomy), F.array().cast("array<string>")))
    kinds, found, spelled = {k: of(f"kind_{k}") for k in REQUIRED}, of("found"), of("spelled")
    sid = F.when(kinds["id"].isin("STRING", "BIGINT", "INT", "SMALLINT", "TINYINT") | kinds["id"].startswith("DECIMAL") & kinds["id"].endswith(",0)"), of("text_id"))
    missing = F.concat_ws(", ", *(F.when(kinds[k] == "NONE", F.lit(k)) for k in REQUIRED))
    error = (
        F.when(of("data").isNull(), "invalid JSON")
        .when(~of("whole").startswith("OBJECT"), "record must be a JSON object")
        .when(missing != "", F.concat(F.lit("missing field(s) "), missing))
        .when(F.coalesce(sid, F.lit("")) == "", "'id' must be a non-empty string")
        .when((kinds["video"] != "STRING") | (of("text_video") == ""), "'video' must be a non-empty string")
        .when(~kinds["labels"].startswith("ARRAY"), "'labels' must be a list (use [] for benign)")
        .when(F.array_contains(of("named"), ""), F.concat(F.lit("unknown label in "), get("labels", "string")))
        .when(F.size(found) != F.size(spelled), F.concat(F.lit("duplicate labels "), get("labels", "string")))
    )
    parsed = read.withColumns({"id": sid, "video": of("text_video"), "labels": found, "extra": of("data"), "error": error})
    good = F.col("error").isNull()
    return parsed.withColumns({c: F.when(good, F.col(c)) for c in ("id", "video", "labels")}).drop(*taken.values())


def _spelling(v: Column) -> Column:
    """A label as text; null for what can't be one. 2.0 stands for 2."""
    kind, text = _kind(v), F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    whole = (kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")) & (number == F.floor(number))
    return F.when(kind.isin("STRING", "BIGINT", "INT", "SMALLINT", "TINYINT"), text).when(whole, F.floor(number).cast("string"))


def load_records(spark: SparkSession, path: str, taxonomy: Taxonomy) -> DataFrame:
    """ord, id, video, labels and extra of a JSON-lines file. Bad lines are an error that names the first of them.

    Lines are parsed once, into a written table that the checks and all later steps read.
    """
    parsed = written(parse_records(lines(spark, path), taxonomy).drop("line"), spark)
    bad = parsed.where("error is not null").orderBy("path", "ord").select("path", "ord", "error").limit(1).collect()
    if bad:
        discard(parsed, spark)
        raise DataError(f"{bad[0].path}:{bad[0].ord}: {bad[0].error}")
    return parsed.select("ord", "id", "video", "labels", "extra")


def load_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file under a schema, with ord; a line that isn't JSON is an error."""
    rows = lines(spark, path)
    fault = F.raise_error(F.concat(F.col("path"), F.lit(":"), F.col("ord").cast("string"), F.lit(": invalid JSON"))).cast("boolean")
    checked = rows.where(F.when(F.try_parse_json("line").isNull(), fault).otherwise(F.lit(True)))
    return checked.select("ord", F.from_json("line", schema).alias("r")).select("ord", "r.*")


def load_inputs(spark: SparkSession, videos: list[str] | None = None, path: str | None = None, video_root: str | None = None) -> DataFrame:
    """ord, id and video (resolved) to predict on: a list of videos, or JSON lines with video and perhaps id."""
    from plumbline.functions.text import resolve_video

    if (videos is None) == (path is None):
        raise ValueError("give videos or a path, one of them")
    if videos is not None:
        return spark.createDataFrame([(k, str(v), str(v)) for k, v in enumerate(videos)], "ord bigint, id string, video string")
    rows = load_json_lines(spark, path, "id string, video string")
    if rows.where("video is null").limit(1).count():
        raise DataError(f"{path}: a record without 'video'")
    root = video_root or path.rpartition("/")[0]
    out = rows.select("ord", F.coalesce("id", "video").alias("id"), resolve_video(F.col("video"), root).alias("video"))
    twice = out.groupBy("id").count().where("count > 1").orderBy("id").limit(5).collect()
    if twice:
        raise DataError(f"{path}: duplicate ids, e.g. {[r.id for r in twice]}")
    return out
