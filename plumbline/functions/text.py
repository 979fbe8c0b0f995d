"""Scalar text functions: Unicode strip, paths, prompts, targets, list-file codes."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.taxonomy import Taxonomy

#: What Python's str.strip and \s take for white space, as a Java class.
SPACE = r"[\s\x1c-\x1f]"
CODES = ("B1", "B2", "B3", "B4", "B5", "B6")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def resolve_video(video: Column, root: str | None) -> Column:
    """Path under the root, unless it is a URL or absolute; ``//`` and ``./`` collapse as in path objects."""
    if not root:
        return video
    joined = F.concat_ws("/", F.lit(root.rstrip("/") or ""), video)
    clean = F.regexp_replace(F.regexp_replace(joined, r"/(\./)+", "/"), r"(?<!^)/+", "/")
    clean = F.regexp_replace(F.regexp_replace(clean, r"(/\.)+$", ""), r"(?<=.)/$", "")
    return F.when(video.contains("://") | video.startswith("/"), video).otherwise(clean)


def video_path(video: Column, prefix: str | None) -> Column:
    if not prefix:
        return video
    return F.concat(F.lit(prefix.rstrip("/") + "/"), F.regexp_replace(video, r"^/+", ""))


def strip_prefix(path: Column, prefix: str | None) -> Column:
    """The path below a required prefix; a path that isn't below it is an error."""
    if not prefix:
        return path
    start = prefix.rstrip("/") + "/"
    fault = F.raise_error(F.concat(F.lit(f"path without prefix {start}: "), path)).cast("string")
    return F.when(path.startswith(start), F.substring(path, len(start) + 1, 1 << 30)).when(path.isNull(), None).otherwise(fault)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def with_video_token(prompt: str, placement: str = "post", token: str = "<video>") -> str:
    if token in prompt:
        raise ValueError(f"the prompt holds {token!r} already")
    if placement not in ("post", "pre"):
        raise ValueError("placement is 'post' or 'pre'")
    parts = (prompt.strip(), token)
    return " ".join(parts if placement == "post" else parts[::-1])


def sft_target(labels: Column, taxonomy: Taxonomy, style: str, block_name: str | None = None) -> Column:
    """Target text for an array of ids: ``BLOCK: C2, C3``, or ``BLOCK:`` and an indented JSON object of decisions."""
    head = F.lit(f"{block_name or taxonomy.block_name}: ")
    if style == "simple":
        present = F.filter(F.array(*map(F.lit, taxonomy.ids)), lambda x: F.array_contains(labels, x))
        return F.concat(head, F.array_join(present, ", "))
    if style == "json":
        keys = {i: json.dumps(taxonomy.output_key(i), ensure_ascii=False) for i in taxonomy.ids}
        lines = [F.concat(F.lit(f"    {keys[i]}: "), F.array_contains(labels, i).cast("string")) for i in taxonomy.ids]
        return F.concat(head, F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
    raise ValueError("style is 'simple' or 'json'")


def list_codes(label_part: Column) -> Column:
    """``B1-G-0`` to [B1, B3]: G means B3, anything but B1 to B6 is dropped, order is that of the codes."""
    codes = F.transform(F.split(label_part, "-"), strip)
    meant = F.transform(codes, lambda c: F.when(c == "G", F.lit("B3")).otherwise(c))
    return F.array_sort(F.filter(meant, lambda c: c.isin(*CODES)))


def folder_category(path: Column) -> Column:
    """[C<digit>] of the first path component of that form, or []."""
    parts = F.filter(F.split(path, "/"), lambda p: p.rlike(r"(?U)^C\d$"))
    return F.slice(parts, 1, 1)


def path_subcategory(path: Column) -> Column:
    """[name] of the first component ``<name>_benchmark``, or []."""
    parts = F.slice(F.filter(F.split(path, "/"), lambda p: p.endswith("_benchmark")), 1, 1)
    return F.transform(parts, lambda p: F.replace(p, F.lit("_benchmark"), F.lit("")))


def without_first(parts: Column, name: str) -> Column:
    """An array without the first element that equals ``name``."""
    at = F.array_position(parts, name).cast("int")
    rest = F.concat(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(parts, F.greatest(at + 1, F.lit(1)), F.greatest(F.size(parts) - at, F.lit(0))))
    return F.when(at > 0, rest).otherwise(parts)
