"""Inputs of the registered queries, as SQL over the benchmark tables that Spark and DuckDB both read.

One sample is an order; category k is line number k. Truth and prediction come from its lines, and a response
text of one of eleven kinds is written out from the prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.labels import from_flags
from plumbline.taxonomy import load_taxonomy

TAXONOMY = load_taxonomy("safewatch")
IDS = TAXONOMY.ids
KEYS = [TAXONOMY.output_key(i) for i in IDS]
K = range(1, len(IDS) + 1)

_FLAGS = ",\n".join(
    f"max(CASE WHEN l_linenumber = {k} AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS t{k},\n"
    f"max(CASE WHEN l_linenumber = {k} AND ((l_returnflag = 'R' AND l_partkey % 4 <> 0) OR (l_returnflag <> 'R' AND l_partkey % 16 = 0)) THEN 1 ELSE 0 END) AS p{k}"
    for k in K
)
#: sid, batch_id, kind, t1.. and p1.. of every order.
SAMPLES = f"""SELECT o_orderkey AS sid, CAST(floor(o_orderkey / 512.0) AS BIGINT) AS batch_id, CAST(o_orderkey % 13 AS INT) AS kind,
{_FLAGS}
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""


def _value(k: int, upper: bool = False, flip: bool = False) -> str:
    yes, no = ("'True'", "'False'") if upper else ("'true'", "'false'")
    return f"CASE WHEN p{k} = {0 if flip else 1} THEN {yes} ELSE {no} END"


def _block(keys: list[str], upper: bool = False, flip: bool = False) -> str:
    lines = " || ',' || chr(10) || ".join(f"'\"{key}\": ' || {_value(k, upper, flip)}" for k, key in enumerate(keys, 1))
    return f"'GUARDRAIL: ' || chr(123) || chr(10) || {lines} || chr(10) || chr(125)"


def _response() -> str:
    think = "'<think>The video shows a person walking.</think>' || chr(10)"
    answer = lambda body: f"{think} || '<answer>' || {body} || '</answer>'"
    bullets = " || chr(10) || ".join(f"'* {key}: ' || {_value(k)}" for k, key in enumerate(KEYS, 1))
    leak = f"'<think>The video shows a person walking. Draft: ' || {_block(KEYS, flip=True)} || '</think>' || chr(10) || '<answer>' || {_block(KEYS)} || '</answer>'"
    kinds = {
        3: answer(_block(KEYS, upper=True)),
        4: answer(_block(IDS)),
        5: answer(bullets),
        6: answer(_block(KEYS[:3])),
        7: leak,
        8: f"{think} || {_block(KEYS)}",
        9: answer("'No decision.'"),
        10: answer(_block(KEYS)) + " || chr(10) || 'Thanks!'",
        11: "'I cannot determine the content of this video.'",
        12: "''",
    }
    whens = "\n".join(f"WHEN {k} THEN {x}" for k, x in kinds.items())
    return f"CASE kind {whens}\nELSE {answer(_block(KEYS))} END"


#: The samples and their response texts.
RESPONSES = f"SELECT x.*, {_response()} AS response FROM ({SAMPLES}) x"


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = ("orders", "lineitem")
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    for n in names:
        sql = sql.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return spark.sql(sql, **frames)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples with gt and pred as arrays of ids."""
    return _with_sets(_run(spark, sf_dir, SAMPLES))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_sets(_run(spark, sf_dir, RESPONSES))


def _with_sets(df: DataFrame) -> DataFrame:
    sets = [from_flags([F.col(f"{x}{k}") == 1 for k in K], TAXONOMY).alias(name) for x, name in (("t", "gt"), ("p", "pred"))]
    return df.select("*", *sets)


def reward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, sid, response and ground_truth (1-based places of the categories, as text)."""
    slots = F.array(*(F.when(F.col(f"t{k}") == 1, F.lit(str(k))) for k in reversed(K)))
    return responses(spark, sf_dir).select("batch_id", "sid", "response", F.filter(slots, lambda x: x.isNotNull()).alias("ground_truth"))


def mp4_bytes(frames: int, scale: int, ticks: int, big: bool = False, kind: bytes = b"vide") -> bytes:
    """A small MP4 file: a sound track, and a track of so many frames of three bytes, each of ``ticks`` units of 1 / ``scale`` seconds."""
    u4 = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    box = lambda name, *parts: (u4(8 + len(b"".join(parts))) if not big else u4(1)) + name + ((16 + len(b"".join(parts))).to_bytes(8, "big") if big else b"") + b"".join(parts)
    head = box(b"ftyp", b"isom", u4(0))

    def track(handler: bytes, n: int, place: int) -> bytes:
        tables = [box(b"stts", u4(0, 2, n // 2, ticks, n - n // 2, ticks)), box(b"stsz", u4(0, 0, n, *[3] * n)), box(b"stco", u4(0, 1, place))]
        return box(b"trak", box(b"tkhd", u4(0)), box(b"mdia", box(b"mdhd", u4(0, 0, 0, scale, n * ticks, 0)), box(b"hdlr", u4(0, 0), handler, u4(0, 0, 0)), box(b"minf", box(b"stbl", *tables))))

    data = box(b"mdat", b"abc" * frames)
    return head + data + box(b"moov", track(b"soun", 1, len(head) + 8), track(kind, frames, len(head) + 8))
