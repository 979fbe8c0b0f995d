import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions import parsing as P
from plumbline.functions import similarity as S
from plumbline.functions import text as T
from plumbline.plans.prompts import apply_format_template, render_task_prompt
from plumbline.taxonomy import Taxonomy, TaxonomyError, UnknownLabelError, load_taxonomy
from tests.responses import TAX, read, response

CUSTOM = Taxonomy.from_dict({"name": "custom", "categories": [{"id": "K1", "name": "Knife misuse", "aliases": ["knife", 1]}, {"id": "K2", "name": "Fire"}, {"id": "K3", "name": "Fall"}]})


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_bundled_label_spaces():
    assert TAX.ids == [f"C{k}" for k in range(1, 7)] and TAX.block_name == "GUARDRAIL"
    assert load_taxonomy("xdviolence").output_key("B6") == "B6(Car accident)"
    assert TAX.resolve_labels([2, "C1", "2", 3.0]) == ["C1", "C2", "C3"]
    assert TAX.to_vector(["C2", "C6"]) == [0, 1, 0, 0, 0, 1]
    assert len(TAX.fingerprint()) == 64 and load_taxonomy(TAX.to_dict()).fingerprint() == TAX.fingerprint()


@pytest.mark.parametrize("label", [True, 1.5, "C9", None, [1]])
def test_what_is_no_label(label):
    with pytest.raises(UnknownLabelError):
        TAX.resolve_label(label)


@pytest.mark.parametrize("change", [{"name": ""}, {"categories": []}, {"block_name": "1x"}, {"key_template": "{other}"}, {"key_template": "same"}, {"more": 1}, {"categories": [{"id": "1", "name": "x"}]}, {"categories": [{"id": "A", "name": ""}]}, {"categories": [{"id": "A", "name": "x", "aliases": ["B"]}, {"id": "B", "name": "y"}]}, {"categories": "A"}])
def test_definitions_that_do_not_hold(change):
    with pytest.raises(TaxonomyError):
        Taxonomy.from_dict(CUSTOM.to_dict() | change)


def test_label_columns(spark):
    spelled = F.array(F.lit(" knife"), F.lit("K3"), F.lit("1"), F.lit("no"))
    row = one(spark, L.resolve_labels(spelled, CUSTOM, strict=False), L.unknown_labels(spelled, CUSTOM), L.index_of(F.lit("K2"), CUSTOM), L.names_for(F.array(F.lit("K2")), CUSTOM), L.resolve_labels(F.lit(None).cast("array<string>"), CUSTOM))
    assert list(row) == [["K1", "K3"], ["no"], 1, ["Fire"], None]
    with pytest.raises(Exception, match="unknown label"):
        one(spark, L.resolve_labels(spelled, CUSTOM))


@pytest.mark.parametrize("fmt", ["think_answer", "triple_newline"])
@pytest.mark.parametrize("scope", P.SCOPES)
def test_parsing_equals_the_plain_way(spark, fmt, scope):
    rng = random.Random(f"{fmt}{scope}")
    texts = [response(rng, fmt, set(rng.sample(TAX.ids, rng.randint(0, 3))))[0] for _ in range(300)]
    texts += ["<ANSWER>\x1c \"C1\": TRUE</answer>", "\n\n\n", "<answer></answer>", "<think></think><answer>x</answer>"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", P.parse_response(F.col("t"), TAX, fmt, scope=scope).alias("p"))
    for r in df.orderBy("n").collect():
        assert (r.p.status, r.p.decisions, r.p.labels) == read(texts[r.n], fmt, scope), texts[r.n]


def test_parse_details(spark):
    text = "<think> why </think>\n<answer> GUARDRAIL: C2, c5 </answer>"
    p = one(spark, P.parse_response(F.lit(text), TAX, output_style="simple").alias("p")).p
    assert (p.status, p.labels, p.format_ok, p.explanation, p.source) == ("ok", ["C2", "C5"], True, "why", "answer")
    p = one(spark, P.parse_response(F.lit("C2 but xC3"), TAX, "plain", "simple", "full_response").alias("p")).p
    assert (p.status, p.labels, p.historical_labels, p.answer_found) == ("invalid", None, ["C2"], None)
    p = one(spark, P.parse_response(F.lit(None).cast("string"), TAX).alias("p")).p
    assert (p.status, p.error, p.historical_labels) == ("invalid", "answer section not found", [])


def test_prompt_and_target_round_trip(spark):
    prompt = render_task_prompt(CUSTOM)
    assert '"K1(Knife misuse)": boolean' in prompt and 'beginning with "RESULT:"' in prompt
    assert apply_format_template(prompt + " <video>", "think_answer").endswith("<answer> </answer> tags.")
    target = T.sft_target(F.array(F.lit("K2")), CUSTOM, "json")
    p = one(spark, P.parse_response(target, CUSTOM, "plain", scope="full_response").alias("p")).p
    assert p.status == "ok" and p.labels == ["K2"]
    assert one(spark, T.sft_target(F.array().cast("array<string>"), CUSTOM, "simple"))[0] == "RESULT: "
    with pytest.raises(ValueError):
        T.with_video_token("a <video>")


def test_similarities(spark):
    cases = [(None, [], 0, 0, 0), ([], [], 1, 1, 1), (["C1"], [], 0, 0, 0), (["C1", "C2"], ["C2", "C3"], 0, 1 / 3, 1 / (1 + 0.3 + 0.7)), (["C2"], ["C2"], 1, 1, 1)]
    df = spark.createDataFrame([(n, p, g) for n, (p, g, *_) in enumerate(cases)], "n int, p array<string>, g array<string>")
    vec = lambda c: F.when(F.col(c).isNotNull(), L.to_vector(F.col(c), TAX))
    w = lambda x: [F.lit(x)] * 6
    out = df.select("n", S.exact_match(F.col("p"), F.col("g")).alias("e"), S.jaccard(F.col("p"), F.col("g")).alias("j"), S.tversky(F.col("p"), F.col("g"), 0.3, 0.7).alias("t"), S.category_tversky(vec("p"), vec("g"), w(0.3), w(0.7)).alias("c"), S.tversky(F.col("p"), F.col("g"), 0, 0).alias("z"))
    for r in out.orderBy("n").collect():
        assert (r.e, r.j, r.t, r.c) == pytest.approx((*cases[r.n][2:], cases[r.n][4]))
    assert out.where("n = 2").first().z == 1.0


def test_paths_and_codes(spark):
    row = one(spark, T.list_codes(F.lit("B2-G-0-A-B1")), T.folder_category(F.lit("x/C12/C4/v")), T.path_subcategory(F.lit("a/tax_benchmark/b")), F.array_join(T.without_first(F.split(F.lit("a/videos/b/videos"), "/"), "videos"), "/"), T.video_path(F.lit("/a.mp4"), "p/"), T.resolve_video(F.lit("./a//b.mp4"), "/r"), T.resolve_video(F.lit("s3://a//b"), "/r"))
    assert list(row) == [["B1", "B2", "B3"], ["C4"], ["tax"], "a/b/videos", "p/a.mp4", "/r/a/b.mp4", "s3://a//b"]
