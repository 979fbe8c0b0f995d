"""Choosing records: seeded samples, id lists, media bounds, and what is left to do."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from random import Random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import resolve_video
from plumbline.sources.mp4 import is_mp4, read_mp4
from plumbline.sources.records import DataError
from plumbline.sources.shared import free_name, written
from plumbline.sources.stores import located
from plumbline.sources.versions import VersionedTable

REASONS = ("suffix", "unreadable", "too_long", "too_short", "too_few_frames")


#: Places in a partition, as ``monotonically_increasing_id`` has them.
PLACES = 1 << 33


def with_rank(records: DataFrame, order: str = "ord", name: str = "rank") -> DataFrame:
    """rank (or another name) from 0 in the order of a column, without one task that sees all rows: sorted ranges are numbered side by
    side, and each begins after the rows of the ranges before it.

    Ranges depend on sampled bounds, so rows are dealt out and numbered once, in a written table.
    """
    ranged = records.repartitionByRange(order).sortWithinPartitions(order)
    at, of, start = (free_name(records, n) for n in ("__at", "__of", "__start"))
    table = written(ranged.withColumn(at, F.monotonically_increasing_id()), records.sparkSession)
    part, place = F.floor(F.col(at) / PLACES), F.col(at) % PLACES
    sized = table.groupBy(part.alias(of)).agg(F.count("*").alias("n"))
    starts = sized.select(of, (F.sum("n").over(W.orderBy(of)) - F.col("n")).alias(start))
    return table.join(F.broadcast(starts), part == F.col(of)).withColumn(name, F.col(start) + place).drop(at, of, start)


def select_records(records: DataFrame, n: int, seed: int, method: str) -> DataFrame:
    """n records by a seeded draw of row numbers; ``ord`` becomes the new order.

    'random_sample' keeps the order of the draw (and all rows where n covers them), 'sorted_index_sample' that of the
    input. The draw is made on the driver, as its generator is what fixes the result; its size is n.
    """
    total = records.count()
    if method not in ("random_sample", "sorted_index_sample"):
        raise ValueError(f"unknown selection method {method!r}")
    if method == "random_sample" and n >= total:
        return records
    drawn = Random(seed).sample(range(total), min(n, total))
    if method == "sorted_index_sample":
        drawn.sort()
    spark = records.sparkSession
    place, rank, own = (free_name(records, n) for n in ("__place", "__rank", "__own"))
    chosen = spark.createDataFrame(list(enumerate(drawn)), f"`{place}` bigint, `{rank}` bigint")
    joined = with_rank(records, name=own).join(chosen, F.col(own) == F.col(rank))
    return joined.withColumn("ord", F.col(place)).drop(own, rank, place)


def select_by_manifest(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records whose id the manifest (ord, id) lists; the result must repeat it exactly, order and repeats included."""
    kept = records.join(manifest.select("id").distinct(), "id", "left_semi")
    absent = manifest.select("id").distinct().join(records.select("id"), "id", "left_anti").count()
    mine, theirs = with_rank(kept).select("rank", F.col("id").alias("mine")), with_rank(manifest).select("rank", F.col("id").alias("theirs"))
    differ = mine.join(theirs, "rank", "full").where(~F.col("mine").eqNullSafe(F.col("theirs"))).limit(1).count()
    if absent or differ:
        detail = f"{absent} listed ids are absent" if absent else "order or repeats differ"
        raise DataError(f"records do not match the manifest ({detail}; {kept.count()} vs {manifest.count()} rows)")
    return kept


def media_reasons(records: DataFrame, probes: DataFrame, video_root: str | None = None, max_duration: float | None = None, min_duration: float | None = None, min_frames: int | None = None, drop_suffixes: tuple[str, ...] = (".unknown_video",)) -> DataFrame:
    """The records with frames, fps, duration, and reason: null for those that stay, else the first bound they break.

    probes: path, frames, fps, error. A path without a probe counts as not found. Bounds are inclusive.
    """
    from functools import reduce

    suffix = reduce(lambda a, b: a | b, (F.col("video").endswith(s) for s in drop_suffixes), F.lit(False))
    found = probes.select(F.col("path").alias("__path"), "frames", "fps", "error", F.lit(True).alias("__probed"))
    joined = records.join(found, resolve_video(F.col("video"), video_root) == F.col("__path"), "left")
    error = F.when(F.col("__probed").isNull(), F.lit("file not found")).otherwise(probe_error())
    duration = F.when(error.isNull() & (F.col("frames") > 0) & (F.col("fps") > 0), F.col("frames") / F.col("fps"))
    bounds = [F.lit(None if x is None else float(x)).cast("double") for x in (max_duration, min_duration, min_frames)]
    d, frames = F.col("duration"), F.col("frames")
    reason = (
        F.when(suffix, "suffix")
        .when(F.col("error").isNotNull(), "unreadable")
        .when(d > bounds[0], "too_long")
        .when(d < bounds[1], "too_short")
        .when(frames < bounds[2], "too_few_frames")
    )
    return joined.withColumn("error", error).withColumn("duration", duration).withColumn("reason", reason).drop("__path", "__probed")


def probe_error():
    """A probe's error; counts that aren't positive are one."""
    fine = (F.col("fps") > 0) & (F.col("frames") > 0)
    said = F.concat(F.lit("invalid fps="), F.coalesce(F.col("fps").cast("string"), F.lit("none")), F.lit(" or frame_count="), F.coalesce(F.col("frames").cast("string"), F.lit("none")))
    return F.coalesce(F.col("error"), F.when(~F.coalesce(fine, F.lit(False)), said))


def filter_by_media(records: DataFrame, probes: DataFrame, on_unreadable: str = "error", **bounds) -> tuple[DataFrame, DataFrame]:
    """(kept records, dropped records with their reason). Unreadable videos are dropped or an error."""
    if on_unreadable not in ("drop", "error"):
        raise ValueError("on_unreadable is 'drop' or 'error'")
    judged = media_reasons(records, probes, **bounds)
    if on_unreadable == "error":
        bad = judged.where("reason = 'unreadable'").orderBy("ord").limit(1).collect()
        if bad:
            raise DataError(f"cannot read {bad[0].video}: {bad[0].error}")
    return judged.where("reason is null").select(*records.columns), judged.where("reason is not null")


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def probe_media(records: DataFrame, probe: Callable[[str], tuple[int | None, float | None, str | None]], video_root: str | None = None, cache: DataFrame | None = None, drop_suffixes: tuple[str, ...] = (".unknown_video",)) -> DataFrame:
    """path, key, frames, fps and error of every distinct video, probed by the workers unless the cache has it.

    The key joins path, size and whole seconds of modification; a file that isn't there has none and isn't cached.
    """
    schemes = {"file", *(video_root.split("://")[:1] if video_root and "://" in video_root else [])}

    def key(address: str) -> str | None:
        if "://" in address and address.split("://")[0] not in schemes:
            return None  # a web address isn't looked up
        store, path = located(address)
        info = store.get_file_info(path)
        return f"{address}|{info.size}|{int(info.mtime.timestamp())}" if info.is_file else None

    def stat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "key": [key(p) for p in b["path"]]})

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [probe(p) if isinstance(k, str) else (None, None, "file not found") for p, k in zip(b["path"], b["key"])]
            yield pd.DataFrame({"path": b["path"], "key": b["key"], **{c: pd.array([f[i] for f in found], dtype=t) for i, (c, t) in enumerate((("frames", "Int64"), ("fps", "Float64"), ("error", "string")))}})

    wanted = records
    for s in drop_suffixes:
        wanted = wanted.where(~F.col("video").endswith(s))
    keyed = wanted.select(resolve_video(F.col("video"), video_root).alias("path")).distinct().mapInPandas(stat, "path string, key string")
    schema = "path string, key string, frames bigint, fps double, error string"
    if cache is None:
        return keyed.mapInPandas(look, schema)
    known = keyed.join(cache.select("key", "frames", "fps", "error"), "key").select("path", "key", "frames", "fps", "error")
    fresh = keyed.join(cache.select("key"), "key", "left_anti").select("path", "key").mapInPandas(look, schema)
    return known.unionByName(fresh)


def probe_kept(records: DataFrame, probe: Callable[[str], tuple[int | None, float | None, str | None]], table: VersionedTable, video_root: str | None = None, drop_suffixes: tuple[str, ...] = (".unknown_video",)) -> DataFrame:
    """``probe_media`` with a table of probes by key that runs share: what it has isn't probed, and what is probed goes into it."""
    spark = records.sparkSession
    cache = table.read(spark)
    found = written(probe_media(records, probe, video_root, cache, drop_suffixes), spark)
    fresh = found.where("key is not null")
    fresh = fresh if cache is None else fresh.join(cache.select("key"), "key", "left_anti").select(*found.columns)
    if not fresh.isEmpty():
        table.merge(fresh, spark)
    return found


def probe_video(path: str) -> tuple[int | None, float | None, str | None]:
    """Frames, frames a second and error of a video, for ``probe_media``: MP4 files by their boxes, in any store; others by whichever decoder is installed."""
    if is_mp4(path):
        return tuple(read_mp4(path))
    try:
        import av
    except ImportError:
        return _probe_opencv(path)
    try:
        with av.open(path) as container:
            stream = container.streams.video[0]
            frames = stream.frames or sum(1 for _ in container.decode(stream))
            return frames, float(stream.average_rate), None
    except Exception as e:  # whatever the decoder raises is the video's error
        return None, None, f"{type(e).__name__}: {e}"


def _probe_opencv(path: str) -> tuple[int | None, float | None, str | None]:
    try:
        import cv2
    except ImportError as e:
        raise RuntimeError("probing needs the package av or cv2") from e
    video = cv2.VideoCapture(path)
    try:
        if not video.isOpened():
            return None, None, "cannot open"
        return int(video.get(cv2.CAP_PROP_FRAME_COUNT)), float(video.get(cv2.CAP_PROP_FPS)), None
    finally:
        video.release()


def remaining(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Inputs whose id hasn't been written; ids that were written but aren't inputs are an error."""
    strange = done.select("id").join(inputs.select("id"), "id", "left_anti").distinct().orderBy("id").limit(5).collect()
    if strange:
        raise DataError(f"written ids that are not in the input, e.g. {[r.id for r in strange]}")
    return inputs.join(done.select("id").distinct(), "id", "left_anti")
