"""DuckDB SQL for the registered queries, written from the semantics and apart from the operators."""

from __future__ import annotations

import math
import re

from plumbline.plans import file_queries, run_queries
from plumbline.plans import fixtures as X
from plumbline.plans.queries import CONTROLLER, SUMMARIES

IDS, KEYS, K = X.IDS, X.KEYS, X.K
R6 = "round({}, 6)".format


def add(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0e0 END)"


def names(prefix: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {prefix}{k} = 1 THEN '{i}' END" for k, i in enumerate(IDS, 1)) + ")"


def pattern(lead: str) -> str:
    return "(?i)" + lead + r":\s*(true|false)"


def found(text: str, lead: str) -> str:
    return f"nullif(lower(regexp_extract({text}, '{pattern(lead)}', 1)), '')"


# samples and their counts
TP = add(f"t{k} * p{k}" for k in K)
FP = add(f"(1 - t{k}) * p{k}" for k in K)
FN = add(f"t{k} * (1 - p{k})" for k in K)
COUNTED = f"WITH s AS ({X.SAMPLES}), c AS (SELECT *, {TP} AS tp, {FP} AS fp, {FN} AS fn FROM s)"


def category_rows(source: str = "c", group: str = "") -> str:
    """category and integer counts, one SELECT a category."""
    one = (
        f"SELECT {group}{k} AS pos, '{i}' AS category, CAST(sum(t{k} * p{k}) AS BIGINT) AS tp, CAST(sum((1 - t{k}) * p{k}) AS BIGINT) AS fp, "
        f"CAST(sum(t{k} * (1 - p{k})) AS BIGINT) AS fn, CAST(sum((1 - t{k}) * (1 - p{k})) AS BIGINT) AS tn, count(*) AS n FROM {source}" + (f" GROUP BY {group.rstrip(', ')}" if group else "")
        for k, i in enumerate(IDS, 1)
    )
    return " UNION ALL ".join(one)


CATEGORY = f"""{COUNTED}, k AS ({category_rows()}), m AS (SELECT *, {div('tp + tn', 'n')} AS accuracy, {div('tp', 'tp + fp')} AS "precision", {div('tp', 'tp + fn')} AS recall,
{div('2 * tp', '2 * tp + fp + fn')} AS f1_score, {div('tn', 'tn + fp')} AS specificity, {div('fp', 'fp + tn')} AS false_positive_rate,
({div('tp', 'tp + fn')} + {div('tn', 'tn + fp')}) / 2 AS balanced_accuracy FROM k)"""

VALUES = {
    "num_samples": "count(*)",
    "jaccard_similarity": f"avg(CASE WHEN tp + fp + fn = 0 THEN 1e0 ELSE CAST(tp AS DOUBLE) / (tp + fp + fn) END)",
    "exact_match_ratio": "avg(CASE WHEN fp + fn = 0 THEN 1e0 ELSE 0e0 END)",
    "hamming_accuracy": f"1 - sum(fp + fn) / (count(*) * {len(IDS)}e0)",
    "micro_accuracy": f"1 - sum(fp + fn) / (count(*) * {len(IDS)}e0)",
    "micro_precision": div("sum(tp)", "sum(tp + fp)"),
    "micro_recall": div("sum(tp)", "sum(tp + fn)"),
    "micro_f1": div("2 * sum(tp)", "sum(2 * tp + fp + fn)"),
    "sample_precision": f"avg({div('tp', 'tp + fp')})",
    "sample_recall": f"avg({div('tp', 'tp + fn')})",
    "sample_f1": f"avg({div('2 * tp', '2 * tp + fp + fn')})",
    "binary_accuracy": "avg(CASE WHEN (tp + fn > 0) = (tp + fp > 0) THEN 1e0 ELSE 0e0 END)",
    "binary_precision": div("count(*) FILTER (tp + fn > 0 AND tp + fp > 0)", "count(*) FILTER (tp + fp > 0)"),
    "binary_recall": div("count(*) FILTER (tp + fn > 0 AND tp + fp > 0)", "count(*) FILTER (tp + fn > 0)"),
    "binary_f1": div("2 * count(*) FILTER (tp + fn > 0 AND tp + fp > 0)", "count(*) FILTER (tp + fn > 0) + count(*) FILTER (tp + fp > 0)"),
    "false_refusal_rate": div("count(*) FILTER (tp + fn = 0 AND fp > 0)", "count(*) FILTER (tp + fn = 0)"),
    "violation_leakage_rate": div("count(*) FILTER (tp + fn > 0 AND tp + fp = 0)", "count(*) FILTER (tp + fn > 0)"),
    "n_benign": "count(*) FILTER (tp + fn = 0)",
    "n_unsafe": "count(*) FILTER (tp + fn > 0)",
    "n_false_refusal": "count(*) FILTER (tp + fn = 0 AND fp > 0)",
    "n_missed_violation": "count(*) FILTER (tp + fn > 0 AND tp + fp = 0)",
}
OF_CATEGORY = {"macro_f1": "f1_score", "weighted_f1": "f1_score"}


def summary_sql(columns: tuple[str, ...]) -> str:
    if columns[0] in VALUES:
        out = ", ".join(f"{VALUES[c] if c.startswith(('n_', 'num_')) else R6(VALUES[c])} AS {c}" for c in columns)
        return f"{COUNTED} SELECT {out} FROM c"
    inner = {c: OF_CATEGORY.get(c, c.split("_", 1)[1]) for c in columns}
    if columns[0].startswith("weighted"):
        out = ", ".join(f"{R6(div(f'sum((tp + fn) * {chr(34)}{m}{chr(34)})', 'sum(tp + fn)'))} AS {c}" for c, m in inner.items())
    else:
        out = ", ".join(f'{R6(f"avg({chr(34)}{m}{chr(34)})")} AS {c}' for c, m in inner.items())
    return f"{CATEGORY} SELECT {out} FROM m"


# responses: kinds whose decisions can be read from the answer, or from the whole text
ANSWER = r"CASE WHEN regexp_matches(response, '(?is)<answer>(.*?)</answer>') THEN trim(regexp_extract(response, '(?is)<answer>(.*?)</answer>', 1), chr(10) || ' ') END"
RESP = f"WITH r AS ({X.RESPONSES}), a AS (SELECT *, {ANSWER} AS answer FROM r)"


def decisions(text: str) -> str:
    """Columns d1.. of a cascade over a text column."""
    esc = lambda s: re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", s)
    steps = ([found(text, f'"{esc(k)}"') for k in KEYS], [found(text, f'"{i}"') for i in IDS], [found(text, r"\*\s*" + esc(k)) for k in KEYS])
    some = ["coalesce(" + ", ".join(s) + ") IS NOT NULL" for s in steps]
    return ", ".join(f"CASE WHEN {some[0]} THEN {steps[0][n]} WHEN {some[1]} THEN {steps[1][n]} ELSE {steps[2][n]} END = 'true' AS d{n + 1}" for n in range(len(IDS)))


ANY = "(" + " OR ".join(f"d{k} IS NOT NULL" for k in K) + ")"
ALL = "(" + " AND ".join(f"d{k} IS NOT NULL" for k in K) + ")"
LABELS = "concat_ws(',', " + ", ".join(f"CASE WHEN d{k} THEN '{i}' END" for k, i in enumerate(IDS, 1)) + ")"
PARSED = f"""{RESP}, d AS (SELECT *, {decisions('answer')} FROM a),
p AS (SELECT *, CASE WHEN answer IS NULL OR NOT {ANY} THEN 'invalid' WHEN {ALL} THEN 'ok' ELSE 'partial' END AS status,
CASE WHEN answer IS NULL THEN 'answer section not found' WHEN NOT {ANY} THEN 'no category decisions found' END AS error FROM d)"""
D = ", ".join(f"d{k}" for k in K)
FORMAT = r"regexp_full_match(trim(response, chr(10) || ' '), '(?s)<think>.*?</think>\s*<answer>.*?</answer>')"

# rewards: counts of what was read; the flag ok marks rows with a reading
READ = f"""{PARSED}, q AS (SELECT sid, batch_id, response, status <> 'invalid' AS ok, {", ".join(f"t{k}" for k in K)},
{", ".join(f"CASE WHEN status <> 'invalid' AND d{k} THEN 1 ELSE 0 END AS p{k}" for k in K)} FROM p),
c AS (SELECT *, {TP} AS tp, {FP} AS fp, {FN} AS fn, CASE WHEN {FORMAT} THEN 1e0 ELSE 0e0 END AS fmt FROM q)"""


def tversky(a: str, b: str) -> str:
    return f"CASE WHEN NOT ok THEN 0e0 WHEN tp + fp + fn = 0 THEN 1e0 WHEN tp + {a} * fp + {b} * fn > 0 THEN tp / (tp + {a} * fp + {b} * fn) ELSE 1e0 END"


def reward_sql(accuracy: str, weight: float = 0.1, source: str = "c", head: str = READ) -> str:
    return f"{head} SELECT sid, {R6(f'({1 - weight!r}e0 * ({accuracy}) + {weight!r}e0 * fmt)')} AS overall, fmt AS format, {R6(accuracy)} AS accuracy FROM {source}"


EXACT = "CASE WHEN ok AND fp + fn = 0 THEN 1e0 ELSE 0e0 END"
JACCARD = "CASE WHEN NOT ok THEN 0e0 WHEN tp + fp + fn = 0 THEN 1e0 ELSE CAST(tp AS DOUBLE) / (tp + fp + fn) END"


def controller_sql(mode: str, update: bool = True) -> str:
    """Batch rates, and a recursion over batches in order: states after each, with those before it as a0, b0."""
    c, eps, n = CONTROLLER, 1e-8, len(IDS)
    cats = ["global"] if mode == "global" else IDS
    rate = (lambda x, k: f"avg({x})") if mode == "global" else (lambda x, k: f"avg({'(1 - t%d) * p%d' % (k, k) if x == 'fp' else 't%d * (1 - p%d)' % (k, k)})")
    rates = " UNION ALL ".join(f"SELECT batch_id, '{cat}' AS category, {rate('fp', k)} AS x, {rate('fn', k)} AS y FROM c GROUP BY batch_id" for k, cat in enumerate(cats, 1))
    fp, fn = (f"CASE WHEN f.i = 0 THEN b.{v} ELSE {1 - c['rho']!r}e0 * f.{e} + {c['rho']!r}e0 * b.{v} END" for v, e in (("x", "fp_ema"), ("y", "fn_ema")))
    share = "(CASE WHEN u >= 0 THEN 1 / (1 + exp(-u)) ELSE exp(u) / (1 + exp(u)) END)"
    clip = f"least(greatest({share}, {c['beta_clip']!r}e0), {1 - c['beta_clip']!r}e0)"
    if not update:
        return f"{READ}, b AS ({rates}) SELECT batch_id, category, 0e0 AS fp_ema, 0e0 AS fn_ema, 0e0 AS logit_u, {c['scale'] / 2!r}e0 AS alpha, {c['scale'] / 2!r}e0 AS beta FROM b"
    return f"""{READ.replace('WITH r AS', 'WITH RECURSIVE r AS', 1)}, b0 AS ({rates}),
b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY batch_id) AS i FROM b0),
f AS (SELECT category, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS batch_id, 0e0 AS fp_ema, 0e0 AS fn_ema, 0e0 AS u FROM (SELECT DISTINCT category FROM b)
UNION ALL SELECT g.category, g.i, g.batch_id, g.fp_ema, g.fn_ema,
{1 - c['logit_leakage']!r}e0 * g.u + {c['eta']!r}e0 * (ln((g.fn_ema + {eps}) / (g.fp_ema + {eps}) + {eps}) - {math.log(c['target_ratio'] + eps)!r}e0)
FROM (SELECT f.category, b.i, b.batch_id, {fp} AS fp_ema, {fn} AS fn_ema, f.u FROM f JOIN b ON b.category = f.category AND b.i = f.i + 1) g),
z AS (SELECT *, {c['scale']!r}e0 * (1 - {clip}) AS alpha, {c['scale']!r}e0 * {clip} AS beta FROM f WHERE i > 0)"""


Z = "SELECT batch_id, category, round(fp_ema, 6) AS fp_ema, round(fn_ema, 6) AS fn_ema, round(u, 6) AS logit_u, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM z"
HALF = f"{CONTROLLER['scale'] / 2!r}e0"
ADAPTIVE_GLOBAL = f"""{controller_sql('global')}, y AS (SELECT c.*, coalesce(w.alpha, {HALF}) AS al, coalesce(w.beta, {HALF}) AS be FROM c JOIN b ON b.batch_id = c.batch_id LEFT JOIN z w ON w.i = b.i - 1)"""
WEIGHTED = {x: add(f"{w}{k} * {e}" for k, e in ((k, f"(1 - t{k}) * p{k}" if x == "fp" else f"t{k} * (1 - p{k})") for k in K)) for x, w in (("fp", "al"), ("fn", "be"))}
ADAPTIVE_CATEGORY = f"""{controller_sql('category')}, n AS (SELECT DISTINCT batch_id, i FROM b),
w AS (SELECT n.batch_id, {", ".join(f"coalesce(max(z.alpha) FILTER (z.category = '{i}'), {HALF}) AS al{k}, coalesce(max(z.beta) FILTER (z.category = '{i}'), {HALF}) AS be{k}" for k, i in enumerate(IDS, 1))}
FROM n LEFT JOIN z ON z.i = n.i - 1 GROUP BY n.batch_id),
y AS (SELECT c.*, {WEIGHTED['fp']} AS wfp, {WEIGHTED['fn']} AS wfn FROM c JOIN w ON w.batch_id = c.batch_id)"""
ACC_CATEGORY = "CASE WHEN NOT ok THEN 0e0 WHEN tp + fp + fn = 0 THEN 1e0 WHEN tp + wfp + wfn > 0 THEN tp / (tp + wfp + wfn) ELSE 1e0 END"

# predictions against truth, with missing and extra ones
JOINED = f"""{PARSED}, made AS (SELECT CAST(CASE WHEN sid % 101 = 0 THEN sid + 1000000 ELSE sid END AS VARCHAR) AS id,
CASE WHEN status = 'invalid' THEN 'parse_error' ELSE status END AS status, {D} FROM p WHERE sid % 17 <> 0),
j AS (SELECT CAST(p.sid AS VARCHAR) AS id, coalesce(made.status, 'missing') AS st, {", ".join(f"p.t{k}, CASE WHEN made.status IN ('ok', 'partial') AND made.d{k} THEN 1 ELSE 0 END AS p{k}" for k in K)}
FROM p LEFT JOIN made ON CAST(p.sid AS VARCHAR) = made.id)"""


def coverage_sql(where: str) -> str:
    macro = add(f"{div(f'2 * sum(t{k} * p{k})', f'sum(t{k} + p{k})')}" for k in K)
    out = ", ".join(f"{VALUES[c] if c == 'num_samples' else R6(VALUES[c])} AS {c}" for c in ("num_samples", "jaccard_similarity", "exact_match_ratio", "micro_f1"))
    return f"{JOINED}, c AS (SELECT *, {TP} AS tp, {FP} AS fp, {FN} AS fn FROM j WHERE {where}) SELECT {out}, {R6(f'{macro} / {len(IDS)}')} AS macro_f1 FROM c"


RECORDS = f"WITH s AS ({X.SAMPLES}), v AS (SELECT sid AS ord, CAST(sid AS VARCHAR) AS id, 'v/' || (sid % 1000) || '.mp4' AS video, * FROM s)"
INDEXES = "concat_ws(',', " + ", ".join(f"CASE WHEN t{k} = 1 THEN '{k}' END" for k in K) + ")"
JSON_TARGET = "'GUARDRAIL: ' || chr(123) || chr(10) || " + " || ',' || chr(10) || ".join(f"'    \"{key}\": ' || CASE WHEN p{k} = 1 THEN 'true' ELSE 'false' END" for k, key in enumerate(KEYS, 1)) + " || chr(10) || chr(125)"
JUDGED = """WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem),
v AS (SELECT *, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || CAST(l_quantity AS BIGINT) || CASE WHEN l_partkey % 50 = 0 THEN '.unknown_video' ELSE '.mp4' END AS id,
CASE WHEN l_partkey % 40 <> 1 THEN CAST(l_quantity AS BIGINT) END AS frames, CASE WHEN l_partkey % 40 <> 1 THEN CAST(l_linenumber % 5 AS DOUBLE) END AS fps FROM i),
d AS (SELECT *, CASE WHEN fps > 0 AND frames > 0 THEN frames / fps END AS duration FROM v),
j AS (SELECT *, CASE WHEN l_partkey % 50 = 0 THEN 'suffix' WHEN duration IS NULL THEN 'unreadable' WHEN duration > 20 THEN 'too_long' WHEN duration < 2 THEN 'too_short'
WHEN frames < 5 THEN 'too_few_frames' END AS reason FROM d)"""
CODES = "list_transform(string_split('B' || (p_size % 8) || CASE WHEN p_size % 3 = 0 THEN '-G' ELSE '-A' END || '-B' || (p_partkey % 7), '-'), lambda c: CASE WHEN c = 'G' THEN 'B3' ELSE c END)"

# select_sampled has no SQL: its draw is Python's generator
OVERSAMPLE = f"""{RECORDS}, w AS (SELECT ord, CASE WHEN ord % 11 = 0 THEN (CAST(floor(ord / 11) AS BIGINT) * 11 + 1) || '__aug_cls2_1' ELSE id END AS id, {INDEXES} AS response, t2 FROM v),
h AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM w WHERE t2 = 1),
taken AS (SELECT DISTINCT id FROM w)
SELECT ord, id, response FROM w UNION ALL
SELECT (SELECT max(ord) FROM w) + n, h.id || '__aug_cls2_' || CASE WHEN t.id IS NULL THEN 1 ELSE 2 END, response FROM h LEFT JOIN taken t ON t.id = h.id || '__aug_cls2_1'"""

ORACLE_SQL: dict[str, str] = {
    "eval_confusion": f"{CATEGORY} SELECT category, tp, fp, fn, tn, tp + fn AS n_positive_gt, tp + fp AS n_positive_pred FROM m",
    "eval_per_category": CATEGORY + " SELECT category, " + ", ".join(f'round("{m}", 6) AS "{m}"' for m in ("accuracy", "precision", "recall", "f1_score", "specificity", "false_positive_rate", "balanced_accuracy")) + " FROM m",
    **{k: summary_sql(v) for k, v in SUMMARIES.items()},
    "eval_coverage_negative": coverage_sql("true"),
    "eval_coverage_exclude": coverage_sql("st IN ('ok', 'partial')"),
    "eval_historical": coverage_sql("true"),
    "eval_status_counts": f"{JOINED} SELECT st AS status, count(*) AS n FROM j GROUP BY st",
    "eval_coverage_report": f"{JOINED} SELECT count(*) AS ground_truth_samples, count(*) FILTER (st = 'missing') AS missing, CAST(0 AS BIGINT) AS invalid, count(*) FILTER (st = 'partial') AS partial, count(*) FILTER (st = 'parse_error') AS parse_errors_scored FROM j",
    "eval_extra_ids": f"{JOINED} SELECT id FROM made WHERE id NOT IN (SELECT id FROM j)",
    "parse_json": f"{RESP} SELECT sid, {decisions('response')} FROM a",
    "parse_answer_only": f"{PARSED} SELECT sid, status, CASE WHEN status <> 'invalid' THEN {LABELS} END AS labels, CASE WHEN answer IS NOT NULL THEN 'answer' END AS source, error, {D} FROM p",
    "parse_simple": f"WITH s AS ({X.SAMPLES}) SELECT sid, 'ok' AS status, {names('p')} AS labels FROM s",
    "parse_format_ok": f"WITH r AS ({X.RESPONSES}) SELECT sid, {FORMAT} AS format_ok, contains(response, chr(10) || chr(10) || chr(10)) AS triple_ok FROM r",
    "parse_answer": f"{RESP} SELECT sid, answer FROM a",
    "parse_explanation": rf"WITH r AS ({X.RESPONSES}) SELECT sid, CASE WHEN contains(response, '</think>') THEN regexp_extract(response, '(?s)<think>(.*?)</think>', 1) END AS explanation FROM r",
    "parse_status_counts": f"{PARSED} SELECT kind, status, count(*) AS n FROM p GROUP BY kind, status",
    "parse_conversations": "SELECT 'invalid' AS status, 'no category decisions found' AS error, count(*) AS n FROM conversations WHERE role = 'assistant' HAVING count(*) > 0",
    "prediction_rows": f"""{PARSED}, b AS (SELECT *, sid % 29 = 0 AS bad, status <> 'invalid' AND sid % 29 <> 0 AS good FROM p)
SELECT CAST(sid AS VARCHAR) AS id, CASE WHEN bad THEN 'video_error' WHEN status = 'invalid' THEN 'parse_error' ELSE status END AS status, CASE WHEN good THEN {LABELS} END AS labels,
CASE WHEN good THEN concat_ws(';', {", ".join(f"CASE WHEN d{k} THEN '{n}' END" for k, n in enumerate(X.TAXONOMY.names, 1))}) END AS label_names,
CASE WHEN NOT good THEN NULL WHEN {" OR ".join(f"coalesce(d{k}, false)" for k in K)} THEN true WHEN status = 'ok' THEN false END AS unsafe,
CASE WHEN good THEN concat_ws(',', {", ".join(f"CASE WHEN d{k} IS NULL THEN '{i}' END" for k, i in enumerate(IDS, 1))}) ELSE '' END AS missing,
CASE WHEN bad THEN 'unreadable' ELSE error END AS error FROM b""",
    "reward_pairs": f"{COUNTED} SELECT sid, CASE WHEN fp + fn = 0 THEN 1e0 ELSE 0e0 END AS exact, {R6(JACCARD.replace('NOT ok', 'false'))} AS jaccard, {R6(tversky('0.3e0', '0.7e0').replace('NOT ok', 'false'))} AS tversky FROM c",
    "reward_exact": reward_sql(EXACT),
    "reward_jaccard": reward_sql(JACCARD),
    "reward_tversky": reward_sql(tversky("0.3e0", "0.7e0")),
    "reward_overall": reward_sql(JACCARD, 0.25),
    "reward_adaptive_global": reward_sql(tversky("al", "be"), source="y", head=ADAPTIVE_GLOBAL),
    "reward_adaptive_category": reward_sql(ACC_CATEGORY, source="y", head=ADAPTIVE_CATEGORY),
    "batch_stats_global": f"""{READ} SELECT batch_id, {R6('avg(CASE WHEN ok THEN 0e0 ELSE 1e0 END)')} AS invalid_rate, CAST(count(*) FILTER (ok) AS DOUBLE) AS counted_samples,
{", ".join(f"{R6(f'avg({x}) FILTER (ok)')} AS batch_{x}" for x in ("tp", "fp", "fn"))}, {R6('(avg(fn) FILTER (ok) + 1e-8) / (avg(fp) FILTER (ok) + 1e-8)')} AS batch_fn_fp_ratio FROM c GROUP BY batch_id""",
    "batch_stats_category": f"{READ} SELECT batch_id, " + ", ".join(f"{R6(f'avg((1 - t{k}) * p{k})')} AS batch_fp_{i.lower()}, {R6(f'avg(t{k} * (1 - p{k}))')} AS batch_fn_{i.lower()}" for k, i in enumerate(IDS, 1)) + " FROM c GROUP BY batch_id",
    "batch_classification": f"""{READ}, k AS ({category_rows('c', 'batch_id, ')}), m AS (SELECT *, {div('tp', 'tp + fp')} AS p, {div('tp', 'tp + fn')} AS r FROM k),
u AS (SELECT batch_id, avg(p) AS mp, avg(r) AS mr, avg({div('2 * p * r', 'p + r')}) AS mf, {div('sum(tp)', 'sum(tp + fp)')} AS p, {div('sum(tp)', 'sum(tp + fn)')} AS r FROM m GROUP BY batch_id)
SELECT batch_id, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, {R6(div('2 * p * r', 'p + r'))} AS micro_f1 FROM u""",
    "controller_global": f"{controller_sql('global')} {Z}",
    "controller_category": f"{controller_sql('category')} {Z}",
    "controller_frozen": controller_sql("global", False),
    "validate_repeats": "SELECT md5(text) AS video, count(*) AS rows, min(doc_id) AS first_ord FROM documents GROUP BY 1 HAVING count(*) > 1",
    "validate_label_counts": f"{RECORDS} " + " UNION ALL ".join(f"SELECT '{i}' AS category, CAST(sum(t{k}) AS BIGINT) AS n FROM v" for k, i in enumerate(IDS, 1)),
    "validate_cardinality": f"{RECORDS} SELECT CAST({add(f't{k}' for k in K)} AS INTEGER) AS n_labels, count(*) AS n FROM v GROUP BY 1",
    "split_overlap": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS video, doc_id % 3 AS s FROM documents), x AS (SELECT DISTINCT s, 'id' AS kind, id AS value FROM d UNION ALL SELECT DISTINCT s, 'video', video FROM d)
SELECT ['train', 'val', 'test'][a.s + 1] AS first, ['train', 'val', 'test'][b.s + 1] AS second, a.kind, count(*) AS n, min(a.value) AS example FROM x a JOIN x b ON a.kind = b.kind AND a.value = b.value AND a.s < b.s GROUP BY 1, 2, 3""",
    "resolve_video": "SELECT video, CASE WHEN contains(video, '://') OR starts_with(video, '/') THEN video ELSE '/data/videos/' || video END AS path FROM (SELECT url AS video FROM pages UNION SELECT p_name FROM part)",
    "resolve_spellings": f"""WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_linenumber AS VARCHAR)))) AS sp FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(list_filter(sp, lambda x: x <= '6'), lambda x: 'C' || x), ',') AS ids, array_to_string(list_filter(sp, lambda x: x > '6'), ',') AS unknown,
concat_ws(',', {", ".join(f"CASE WHEN list_contains(sp, '{k}') THEN 1 ELSE 0 END" for k in K)}) AS vector FROM o""",
    "label_list_codes": f"SELECT p_partkey, array_to_string(list_sort(list_filter({CODES}, lambda c: c IN ('B1', 'B2', 'B3', 'B4', 'B5', 'B6'))), ',') AS codes FROM part",
    "media_filter": f"{JUDGED} SELECT id, frames, fps, round(duration, 6) AS duration FROM j WHERE reason IS NULL",
    "media_filter_reasons": f"{JUDGED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM j GROUP BY 1",
    "select_manifest": f"{RECORDS} SELECT id, video, {names('t')} AS labels FROM v WHERE ord % 7 = 3",
    "oversample": OVERSAMPLE,
    "build_rl_rows": f"{RECORDS} SELECT id, '/data/' || video AS video_path, 'task <video>' AS prompt, {INDEXES} AS response FROM v",
    "build_chat_rows": f"{RECORDS} SELECT id, 'task <video>' AS \"user\", 'GUARDRAIL: ' || replace({names('t')}, ',', ', ') AS assistant, '/data/' || video AS video, {names('t')} AS labels FROM v",
    "sft_target_simple": f"WITH s AS ({X.SAMPLES}) SELECT sid, 'GUARDRAIL: ' || replace({names('p')}, ',', ', ') AS target FROM s",
    "sft_target_json": f"WITH s AS ({X.SAMPLES}) SELECT sid, {JSON_TARGET} AS target FROM s",
    "predict_resume": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS video FROM orders WHERE o_orderkey % 3 = 0",
    "distinct_prompt_check": "SELECT 'task <video>' AS prompt",
}
ORACLE_SQL |= file_queries.oracle_sql()
ORACLE_SQL |= run_queries.oracle_sql()
#: SQL of what comes from no table, for a unit test; none of it is registered.
SETTINGS_SQL = {k: ORACLE_SQL.pop(k) for k in [*file_queries.SETTINGS, *run_queries.SETTINGS]}
