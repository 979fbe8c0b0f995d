import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import controller as C
from plumbline.operators import rewards as R
from tests.responses import TAX, response

BASE = {"mode": "category", "target_ratio": 2.0, "rho": 0.3, "eta": 0.5, "scale": 2.0, "invalid_prediction_policy": "as_empty"}
IDS = ["a", "b", "c"]


def test_starts_balanced_and_follows_errors():
    c = C.Controller(BASE, IDS)
    assert c.state.alpha == c.state.beta == (1.0,) * 3
    c.update([0.1] * 3, [0.1, 0.9, 0.2])
    assert c.state.beta[1] > 1 > c.state.beta[0]
    assert all(a + b == pytest.approx(2) for a, b in zip(c.state.alpha, c.state.beta))


@pytest.mark.parametrize("change", [{"rho": 0}, {"rho": 1.1}, {"eta": -1}, {"epsilon": 0}, {"scale": 0}, {"c": 3}, {"logit_leakage": 2}, {"beta_clip": 0.5}, {"mode": "x"}, {"invalid_prediction_policy": None}, {"target_ratio": [1, 2]}, {"target_ratio": 0}, {"target_ratio": {"a": 1}}, {"target_ratio": "1"}, {"rho": True}, {"other": 1}, {"init_fp_ema": -1}, {"mode": "global", "target_ratio": [1, 1, 1]}])
def test_bad_configurations(change):
    with pytest.raises(C.ControllerError):
        C.resolve_config(BASE | change, IDS)


def test_state_is_exact_and_guarded():
    rng = random.Random(1)
    batches = [([rng.random() for _ in IDS], [rng.random() for _ in IDS]) for _ in range(16)]
    whole, first, second = (C.Controller(BASE | {"init_fn_ema": 0.2, "beta_clip": 0.1, "logit_leakage": 0.1}, IDS) for _ in range(3))
    for b in batches:
        whole.update(*b)
    for b in batches[:7]:
        first.update(*b)
    second.load_state_dict(json.loads(json.dumps(first.state_dict())))
    for b in batches[7:]:
        second.update(*b)
    assert second.state == whole.state
    other = C.Controller(BASE | {"scale": 1.0}, IDS)
    with pytest.raises(C.ControllerError):
        other.load_state_dict(whole.state_dict())
    other.load_state_dict(whole.state_dict(), allow_config_change=True)
    assert other.state.alpha[0] + other.state.beta[0] == pytest.approx(1.0)


@pytest.mark.parametrize("more", [{}, {"init_fp_ema": 0.3}, {"init_logit_u": [0.1, -2.0, 3.0], "beta_clip": 0.2, "logit_leakage": 0.3}])
def test_fold_equals_steps(spark, more):
    config, rng = C.resolve_config(BASE | more, IDS), random.Random(2)
    rows = [(k, float(k % 4 > 0), [rng.random() for _ in IDS], [rng.random() for _ in IDS]) for k in range(12)]
    found = C.fold_batches(spark.createDataFrame(rows, "batch_id bigint, counted double, fp array<double>, fn array<double>"), config)
    state = C.initial_state(config)
    for (k, counted, fp, fn), r in zip(rows, found.orderBy("batch_id").collect()):
        assert r.before.alpha == pytest.approx(state.alpha, abs=1e-12)
        if counted:
            state = C.step(config, state, fp, fn)
        assert r.after.u == pytest.approx(state.logit_u, abs=1e-9) and r.after.updates == state.num_updates


@pytest.mark.parametrize("more", [{}, {"init_fn_ema": 0.3, "logit_leakage": 0.05}, {"init_logit_u": [0.1, -2.0, 3.0], "beta_clip": 0.2}])
def test_ranges_side_by_side_equal_steps(spark, more):
    config, rng = C.resolve_config(BASE | more, IDS), random.Random(6)
    rows = [(k, 0.0 if k < 30 or k % 5 == 0 else 8.0, [rng.random() for _ in IDS], [rng.random() for _ in IDS]) for k in range(400)]
    stats = spark.createDataFrame(rows, "batch_id bigint, counted double, fp array<double>, fn array<double>").repartition(3)
    begun = C.step(config, C.initial_state(config), [0.1] * 3, [0.4] * 3)
    for start in (None, begun):
        found = C.fold_batches(stats, config, state=start, ranges=16).orderBy("batch_id").collect()
        state = start or C.initial_state(config)
        assert len(found) == len(rows)
        for (k, counted, fp, fn), r in zip(rows, found):
            for old, name in ((r.before, "before"), (r.after, "after")):
                if name == "after" and counted:
                    state = C.step(config, state, fp, fn)
                assert (old.started, old.updates) == (state.initialized, state.num_updates)
                for mine, theirs in zip(("fp", "fn", "u", "alpha", "beta"), C.VECTORS):
                    assert old[mine] == pytest.approx(getattr(state, theirs), abs=1e-9)


def test_hundred_thousand_batches(spark):
    config = C.resolve_config({"mode": "global", "rho": 0.05, "eta": 0.01, "logit_leakage": 0.01, "invalid_prediction_policy": "exclude"}, IDS)
    rate = lambda seed: F.array(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000.0)
    stats = spark.range(100_000).select(F.col("id").alias("batch_id"), F.lit(1.0).alias("counted"), rate(1).alias("fp"), rate(2).alias("fn"))
    found = C.fold_batches(stats, config, ranges=8)
    last = found.where("batch_id in (99999, 50000)").orderBy("batch_id").collect()
    state, wanted = C.initial_state(config), []
    for r in stats.orderBy("batch_id").collect():
        state = C.step(config, state, r.fp, r.fn)
        if r.batch_id in (50_000, 99_999):
            wanted.append(state)
    for r, s in zip(last, wanted):
        assert r.after.u == pytest.approx(s.logit_u, abs=1e-9) and r.after.fp == pytest.approx(s.fp_ema, abs=1e-12) and r.after.updates == s.num_updates
    partitions = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert partitions > 1


def test_bad_rates_in_any_range(spark):
    config = C.resolve_config(BASE, IDS)
    rows = [(k, 1.0, [0.1] * 3, [0.1 if k != 3 else -1.0] * 3) for k in range(40)]
    stats = spark.createDataFrame(rows, "batch_id bigint, counted double, fp array<double>, fn array<double>")
    with pytest.raises(Exception, match="finite and not negative"):
        C.fold_batches(stats, config, ranges=4).collect()
    assert C.fold_batches(stats.where("false"), config).collect() == []
    frozen = C.fold_batches(stats, config, update=False).collect()
    assert len(frozen) == 40 and {(tuple(r.before.alpha), r.after.updates) for r in frozen} == {((1.0,) * 3, 0)}


def batches(n=4, size=16, seed=3):
    rng = random.Random(seed)
    for b in range(n):
        for k in range(size):
            truth = rng.sample(TAX.ids, rng.randint(0, 2))
            yield b, k, response(rng, "think_answer", truth)[0], [str(TAX.index(i) + 1) for i in truth]


ADAPTIVE = {"taxonomy": TAX, "reward": "adaptive", "mode": "category", "answer_only": True, "eta": 0.5, "rho": 0.3, "invalid_prediction_policy": "exclude"}


def test_session_equals_log_and_resumes(spark):
    rows = spark.createDataFrame(list(batches()), "batch_id bigint, k int, response string, ground_truth array<string>").cache()
    log = {(r.batch_id, r.k): r for r in R.score(rows, R.build_settings(ADAPTIVE)).collect()}
    session = R.RewardSession()
    session.configure(**ADAPTIVE)
    for b in range(4):
        if b == 2:
            saved = json.loads(json.dumps(session.get_state()))
            session = R.RewardSession()
            session.set_state(saved)
            session.configure(**ADAPTIVE)
        for r in session.score_batch(rows.where(F.col("batch_id") == b).drop("batch_id")).collect():
            assert r.overall == pytest.approx(log[b, r.k].overall, abs=1e-9)
    assert session.is_stateful and session.batches_scored == 4
    with pytest.raises(R.RewardError):
        session.configure(**(ADAPTIVE | {"eta": 0.1}))


def test_frozen_equals_jaccard_at_scale_two(spark):
    rows = spark.createDataFrame(list(batches(2)), "batch_id bigint, k int, response string, ground_truth array<string>")
    frozen = R.build_settings(ADAPTIVE | {"scale": 2.0, "update_controller": False})
    jaccard = R.build_settings({"taxonomy": TAX, "reward": "jaccard", "answer_only": True})
    a, b = ({(r.batch_id, r.k): r.accuracy for r in R.score(rows, s).collect()} for s in (frozen, jaccard))
    assert a == pytest.approx(b)


@pytest.mark.parametrize("given", [{}, {"taxonomy": TAX}, {"taxonomy": TAX, "reward": "x"}, {"taxonomy": TAX, "reward": "jaccard", "alpha": 1}, {"taxonomy": TAX, "reward": "jaccard", "mode": "global"}, {"taxonomy": TAX, "reward": "adaptive"}, {"taxonomy": TAX, "reward": "jaccard", "response_format": "plain"}, {"taxonomy": TAX, "reward": "jaccard", "format_weight": 2}, {"taxonomy": TAX, "reward": "jaccard", "answer_only": True, "parse_scope": "answer_only"}, {"taxonomy": TAX, "reward": "tversky", "beta": -1}, {"taxonomy": TAX, "reward": "jaccard", "what": 1}])
def test_bad_reward_settings(given):
    with pytest.raises(R.RewardError):
        R.build_settings(given)


def test_ground_truth_must_resolve(spark):
    settings = R.build_settings({"taxonomy": TAX, "reward": "jaccard"})
    for truth in (None, ["9"]):
        rows = spark.createDataFrame([(0, "x", truth)], "batch_id bigint, response string, ground_truth array<string>")
        with pytest.raises(Exception, match="ground truth|unknown label"):
            R.read_responses(rows, settings).collect()


def test_stream_equals_log(spark, tmp_path):
    from plumbline.streaming.rewards import StreamingRewards

    rows = spark.createDataFrame(list(batches(3)), "batch_id bigint, k int, response string, ground_truth array<string>")
    log = {(r.batch_id, r.k): r.overall for r in R.score(rows, R.build_settings(ADAPTIVE), diagnostics=False).collect()}
    for b in range(3):
        rows.where(F.col("batch_id") == b).drop("batch_id").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, response string, ground_truth array<string>").json(str(tmp_path / "in"))
        sink = StreamingRewards(R.build_settings(ADAPTIVE), str(tmp_path / "out"))
        query = sink.start(stream, str(tmp_path / "checkpoint"), availableNow=True)
        query.awaitTermination()
    again = sink.load()
    sink.on_batch(rows.where("batch_id = 2").drop("batch_id"), 2)  # a repeated batch changes nothing
    assert sink.load() == again and again["last_batch"] == 2
    for b in range(3):
        for r in spark.read.parquet(str(tmp_path / "out" / f"batch={b}")).collect():
            assert r.overall == pytest.approx(log[b, r.k], abs=1e-9)


def test_many_runs_on_one_stream_resume_after_a_break(spark, tmp_path):
    from plumbline.streaming import rewards as streaming

    rows = spark.createDataFrame(list(batches(9)), "batch_id bigint, k int, response string, ground_truth array<string>").withColumn("n", F.floor(F.col("batch_id") / 3))
    runs = ["a", "b", None]
    rows = rows.withColumn("run", F.element_at(F.array(*map(F.lit, runs)), (F.col("batch_id") % 3 + 1).cast("int"))).cache()
    settings = R.build_settings(ADAPTIVE)
    begun = C.step(settings.controller, C.initial_state(settings.controller), [0.2] * len(TAX.ids), [0.5] * len(TAX.ids))
    initial = spark.createDataFrame([("b", C._plain(begun))], f"run string, state {C.STATE_TYPE}")
    wanted = {}
    for place, run in enumerate(runs):
        mine = rows.where(F.col("run").eqNullSafe(F.lit(run))).withColumn("batch_id", F.col("n"))
        for r in R.score(mine, settings, begun if run == "b" else None, diagnostics=False).collect():
            wanted[place, r.batch_id, r.k] = r.overall
    broken = []

    def breaks_off(spark, uri, text):
        if not broken:
            broken.append(uri)
            raise OSError("the driver is lost before it commits")
        put(spark, uri, text)

    put = streaming.put_text
    for n in range(3):
        rows.where(F.col("n") == n).select("run", "k", "response", "ground_truth").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        for attempt in range(2 if n == 1 else 1):
            stream = spark.readStream.schema("run string, k int, response string, ground_truth array<string>").json(str(tmp_path / "in"))
            sink = streaming.KeyedStreamingRewards(settings, f"file://{tmp_path}/out", initial=initial)
            streaming.put_text = breaks_off if n == 1 and attempt == 0 else put
            try:
                query = sink.start(stream, str(tmp_path / "checkpoint"), availableNow=True)
                query.awaitTermination()
                assert attempt or n != 1
            except Exception as e:
                assert n == 1 and attempt == 0 and "lost before it commits" in str(e)
            finally:
                streaming.put_text = put
    found = sink.scores(spark).collect()
    assert {(runs.index(r.run), r.batch, r.k): pytest.approx(r.overall, abs=1e-9) for r in found} == wanted and len(found) == len(wanted)
    again = sink.last(spark)
    sink.on_batch(rows.where("n = 2").drop("batch_id", "n"), 2)
    assert sink.last(spark) == again and sink.states(spark).count() == 3
    with pytest.raises(ValueError, match="adaptive"):
        streaming.KeyedStreamingRewards(R.build_settings({"taxonomy": TAX, "reward": "jaccard"}), str(tmp_path))
