"""Free-text responses to tri-state decisions.

A null decision is a missing one; null labels mean that nothing could be read, [] that all was denied. Whole responses are
parsed by an Arrow function with compiled patterns, which sees each response once; parts of them are plain Column
expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from plumbline.functions.labels import literal_array
from plumbline.functions.text import SPACE, strip
from plumbline.taxonomy import Taxonomy

FORMATS = ("think_answer", "triple_newline", "plain")
STYLES = ("json", "simple")
SCOPES = ("answer_only", "full_response", "answer_or_full")
GAP = "\n\n\n"


def _known(value: str, among: tuple[str, ...]) -> None:
    if value not in among:
        raise ValueError(f"{value!r} is none of {', '.join(among)}")


def _between(text: Column, tag: str) -> Column:
    """Stripped content of the first element of a tag, in any case; null where there is none."""
    pattern = rf"(?is)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def format_ok(response: Column, response_format: str) -> Column:
    _known(response_format, FORMATS)
    text = F.coalesce(response, F.lit(""))
    if response_format == "think_answer":
        return strip(text).rlike(rf"(?sU)\A<think>.*?</think>{SPACE}*<answer>.*?</answer>\z")
    if response_format == "triple_newline":
        return text.contains("\n\n\n")
    return F.lit(None).cast("boolean")


def extract_answer(response: Column, response_format: str) -> Column:
    """The answer section; null where the format has one and the response hasn't."""
    _known(response_format, FORMATS)
    text = F.coalesce(response, F.lit(""))
    if response_format == "think_answer":
        return _between(text, "answer")
    if response_format == "triple_newline":
        return F.when(text.contains("\n\n\n"), strip(F.element_at(F.split(text, GAP, 2), 2)))
    return text


def extract_explanation(response: Column, response_format: str) -> Column:
    _known(response_format, FORMATS)
    text = F.coalesce(response, F.lit(""))
    if response_format == "think_answer":
        return _between(text, "think")
    if response_format == "triple_newline":
        return F.when(text.contains("\n\n\n"), strip(F.element_at(F.split(text, GAP, 2), 1)))
    return F.lit(None).cast("string")


#: What ``parse_response`` returns.
PARSED = TY.StructType(
    [
        TY.StructField("status", TY.StringType()),
        TY.StructField("decisions", TY.MapType(TY.StringType(), TY.BooleanType())),
        TY.StructField("labels", TY.ArrayType(TY.StringType())),
        TY.StructField("historical_labels", TY.ArrayType(TY.StringType())),
        TY.StructField("source", TY.StringType()),
        TY.StructField("answer_found", TY.BooleanType()),
        TY.StructField("format_ok", TY.BooleanType()),
        TY.StructField("error", TY.StringType()),
        TY.StructField("explanation", TY.StringType()),
    ]
)
WHOLE = re.compile(r"<think>.*?</think>\s*<answer>.*?</answer>", re.S)
SECTIONS = {tag: re.compile(rf"<{tag}>(.*?)</{tag}>", re.S | re.I) for tag in ("answer", "think")}


class Pairs:
    """The first boolean after each of some keys, found by one pattern in one pass."""

    def __init__(self, lead: str, keys: Sequence[str], tail: str) -> None:
        self.keys = [re.compile(re.escape(k), re.I) for k in keys]
        same = any(p.fullmatch(k) for i, p in enumerate(self.keys) for k in keys[i + 1 :])
        # keys that differ in case only are looked for one by one
        groups = [[k] for k in range(len(keys))] if same else [list(range(len(keys)))]
        self.patterns = [(g, re.compile(f"{lead}({'|'.join(re.escape(keys[k]) for k in g)}){tail}:\\s*(true|false)", re.I)) for g in groups]
        self.places = {k.lower(): n for n, k in enumerate(keys)}

    def _place(self, key: str) -> int:
        found = self.places.get(key.lower())
        return next(n for n, p in enumerate(self.keys) if p.fullmatch(key)) if found is None else found

    def __call__(self, text: str) -> list[bool | None]:
        found: list[bool | None] = [None] * len(self.keys)
        for keys, pattern in self.patterns:
            for key, value in pattern.findall(text):
                k = keys[0] if len(keys) == 1 else self._place(key)
                if found[k] is None:
                    found[k] = value.lower() == "true"
        return found


class Parser:
    """Reads responses of one format and style under one label space."""

    def __init__(self, taxonomy: Taxonomy, response_format: str, output_style: str, scope: str, require_block_prefix: bool) -> None:
        self.ids, self.format, self.scope, self.simple = taxonomy.ids, response_format, scope, output_style == "simple"
        self.sectioned = response_format != "plain"
        if self.simple:
            # an id that ends in a dot or hyphen has its boundary where a letter or digit follows
            self.alone = [re.compile(rf"\b{re.escape(i)}\b", re.I) for i in self.ids]
            self.prefix = re.compile(rf"{re.escape(taxonomy.block_name)}\s*:", re.I) if require_block_prefix else None
            self.why = f"'{taxonomy.block_name}:' prefix not found"
        else:
            # quoted full keys; where none is found quoted ids; where none either, bullets
            keys = [taxonomy.output_key(i) for i in self.ids]
            self.steps = Pairs('"', keys, '"'), Pairs('"', self.ids, '"'), Pairs(r"\*\s*", keys, "")
            self.why = "no category decisions found"

    def sections(self, text: str) -> tuple[str | None, str | None]:
        """Answer and explanation, null where the format has them and the response hasn't."""
        if self.format == "think_answer":
            found = (SECTIONS[tag].search(text) for tag in ("answer", "think"))
            return tuple(m[1].strip() if m else None for m in found)
        if self.format == "triple_newline" and GAP in text:
            before, after = text.split(GAP, 1)
            return after.strip(), before.strip()
        return None, None

    def well_formed(self, text: str) -> bool | None:
        if self.format == "think_answer":
            return WHOLE.fullmatch(text.strip()) is not None
        return GAP in text if self.format == "triple_newline" else None

    def decisions(self, text: str) -> list[bool | None]:
        if self.simple:
            return [p.search(text) is not None for p in self.alone]
        flags: list[bool | None] = []
        for step in self.steps:
            flags = step(text)
            if any(f is not None for f in flags):
                break
        return flags

    def __call__(self, response: str | None) -> tuple:
        """Values of PARSED, with the decisions as a list."""
        text = response or ""
        answer, explanation = self.sections(text)
        if self.scope == "answer_only" and self.sectioned:
            target, source = answer, "answer" if answer is not None else None
        elif self.scope == "answer_or_full" and answer is not None:
            target, source = answer, "answer"
        else:
            target, source = text, "full_response"
        said = answer is not None if self.sectioned else None
        if target is None:
            return "invalid", [None] * len(self.ids), None, [], source, said, self.well_formed(text), "answer section not found", explanation
        flags = self.decisions(target)
        positive = [i for i, f in zip(self.ids, flags) if f]
        readable = self.prefix is None or self.prefix.search(target) is not None if self.simple else any(f is not None for f in flags)
        status = "invalid" if not readable else "partial" if None in flags else "ok"
        if not readable:
            flags = [None] * len(self.ids)
        return status, flags, positive if readable else None, positive, source, said, self.well_formed(text), None if readable else self.why, explanation


def parse_response(response: Column, taxonomy: Taxonomy, response_format: str = "think_answer", output_style: str = "json", scope: str = "answer_only", require_block_prefix: bool = True) -> Column:
    """status, decisions, labels, historical_labels, source, answer_found, format_ok, error and explanation.

    The function counts as nondeterministic, so the optimizer never repeats it for a filter or another column.
    """
    _known(response_format, FORMATS)
    _known(output_style, STYLES)
    _known(scope, SCOPES)
    parser = Parser(taxonomy, response_format, output_style, scope, require_block_prefix)
    ids = taxonomy.ids

    def parse(texts: pa.Array) -> pa.Array:
        columns = list(zip(*map(parser, texts.to_pylist()))) or [()] * len(PARSED)
        flags, n = [f for row in columns[1] for f in row], len(texts)
        decisions = pa.MapArray.from_arrays(pa.array(range(0, n * len(ids) + 1, len(ids)), pa.int32()), pa.array(ids * n, pa.string()), pa.array(flags, pa.bool_()))
        text, flag, names = pa.string(), pa.bool_(), pa.list_(pa.string())
        kinds = (text, None, names, names, text, flag, flag, text, text)
        return pa.StructArray.from_arrays([decisions if k is None else pa.array(c, k) for c, k in zip(columns, kinds)], names=PARSED.names)

    return F.arrow_udf(parse, PARSED).asNondeterministic()(response)


def missing_categories(decisions: Column, taxonomy: Taxonomy) -> Column:
    return F.filter(literal_array(taxonomy.ids), lambda x: decisions[x].isNull())
