import json

import pytest
from pyspark.sql import functions as F

from gradloom import cli
from gradloom.operators import evaluators as E
from gradloom.operators import store
from gradloom.operators.store import Warehouse
from gradloom.plans import parity, reports, sweep
from gradloom.sources import datasets as D

FIXTURE = [
    {"dataset": "arc_easy", "split": "fixture", "example_id": f"arc-{i}", "payload": {"question": f"Question {i}?", "choices": ["one", "two", "three"], "answer_index": i % 3}} for i in range(6)
]


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    lines = [json.dumps(r) for r in FIXTURE]
    (root / "arc_easy.jsonl").write_text(lines[0] + "\n\n" + "\n".join(lines[1:]) + "\n   \n")
    (root / "wikitext.jsonl").write_text("\n".join(json.dumps({"dataset": "wikitext103", "split": "fixture", "example_id": f"w-{i}", "payload": {"text": "a b c " * (i + 1)}}) for i in range(3)))
    return str(root)


def offline(model, revision):
    return E.get_scorer("offline")


def test_jsonl_skips_blank_lines_and_takes_the_first(spark, data):
    load = D.get_loader("arc_easy")
    assert [r["example_id"] for r in load(spark, data, "fixture").orderBy("ord").collect()] == [f"arc-{i}" for i in range(6)]
    assert [r["example_id"] for r in load(spark, data, "fixture", 2).orderBy("ord").collect()] == ["arc-0", "arc-1"]
    assert load(spark, data, "fixture", 0).count() == 0
    with pytest.raises(KeyError, match="arc_easy"):
        D.get_loader("nothing")


def test_normalisers(spark):
    raw = spark.createDataFrame([("x", "q", (["1", "2"], ["a", "b"]), "2")], "id string, question string, choices struct<label: array<string>, text: array<string>>, answerKey string")
    got = D.normalise_arc(raw, "test").first()
    assert got["example_id"] == "arc_easy-x" and got["payload"]["answer_index"] == 1
    with pytest.raises(Exception, match="no label"):
        D.normalise_arc(raw.withColumn("answerKey", F.lit("Z")), "test").collect()
    wiki = spark.createDataFrame([(0, " = Heading = "), (1, "  "), (2, " body \n"), (3, None)], "ord bigint, text string")
    assert [(r["example_id"], r["payload"]["text"]) for r in D.normalise_wikitext(wiki, "test").collect()] == [("wikitext103-2", "body")]
    gsm = spark.createDataFrame([(0, "q", "some #### 1,234")], "ord bigint, question string, answer string")
    assert D.normalise_gsm8k(gsm, "test").first()["payload"]["answer_number"] == 1234.0
    with pytest.raises(Exception):
        D.normalise_gsm8k(gsm.withColumn("answer", F.lit("#### none")), "test").collect()
    lam = spark.createDataFrame([(0, "the last word")], "ord bigint, text string")
    assert tuple(D.normalise_lambada(lam, "test").first()["payload"]) == ("the last", "word")
    swag = spark.createDataFrame([(7, "ctx", ["a", "b"], "1")], "ind int, ctx string, endings array<string>, label string")
    assert D.normalise_hellaswag(swag, "v").first()["payload"]["answer_index"] == 1
    mmlu = spark.createDataFrame([("astronomy", "q?", ["a"], 0)], "subject string, question string, choices array<string>, answer int")
    assert D.normalise_mmlu(mmlu, "test").first()["example_id"].startswith("mmlu-astronomy-")


def test_tables_are_pooled_and_filtered_before_the_limit(spark, tmp_path):
    head = "dataset string, split string, example_id string, row_no bigint, added_at timestamp"
    texts = ["", " = Title = ", " body one ", None, "= x", "body two"]
    spark.createDataFrame([("wikitext103", "test", f"w{i}", i, None, (t,)) for i, t in enumerate(texts)], f"{head}, payload struct<text: string>").write.parquet(f"{tmp_path}/wikitext.parquet")
    got = D.get_loader("wikitext103")(spark, str(tmp_path), "test", 2).orderBy("ord").collect()
    assert [(r["ord"], r["example_id"], r["payload"]["text"]) for r in got] == [(0, "w2", "body one"), (1, "w4", "= x")]
    rows = [("mmlu", "test", f"m{i}", i, None, ("q", ["a"], 0, s)) for i, s in enumerate(["astronomy", "chess", "high_school_mathematics", "astronomy"])]
    spark.createDataFrame(rows, f"{head}, payload struct<question: string, choices: array<string>, answer_index: int, subject: string>").write.parquet(f"{tmp_path}/mmlu.parquet")
    got = D.get_loader("mmlu")(spark, str(tmp_path), "test", 2).orderBy("ord").collect()
    assert [r["example_id"] for r in got] == ["m2", "m0"]


def test_large_fixtures_are_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "arc_easy.jsonl").write_text('{"split": "fixture"}\n')
    monkeypatch.setattr(D, "FIXTURE_BYTES", 10)
    with pytest.raises(ValueError, match="fixtures have at most"):
        D.get_loader("arc_easy")(spark, str(tmp_path), "fixture")


def test_demonstrations_share_nothing_with_the_evaluation(spark, tmp_path):
    line = '{{"dataset": "arc_easy", "split": "{s}", "example_id": "{i}", "payload": {{"question": "q", "choices": ["a"], "answer_index": 0}}}}\n'
    (tmp_path / "arc_easy.jsonl").write_text("".join(line.format(s="fixture", i=f"e{k}") for k in range(3)))
    (tmp_path / "arc_easy_train.jsonl").write_text("".join(line.format(s="fixture_train", i=f"t{k}") for k in range(5)))
    load = D.get_loader("arc_easy")
    ours, train = load(spark, str(tmp_path), "fixture"), load(spark, str(tmp_path), "fixture_train")
    assert train.count() == 5 and D.shared_ids(ours, train).count() == 0
    assert [r["example_id"] for r in D.shared_ids(ours, ours.limit(1)).collect()] == ["e0"]


def test_a_run_that_fails_late_leaves_no_results(spark, data, tmp_path, monkeypatch):
    from gradloom.operators.store import Warehouse
    from gradloom.plans import sweep as S

    db = Warehouse(spark, str(tmp_path / "late"))
    save = db.save_run

    def broken(run):
        if run["status"] == "done":
            raise OSError("disk full")
        save(run)

    monkeypatch.setattr(db, "save_run", broken)
    run_id, ok = S.execute(db, data, "offline", "main", "arc_easy", "fixture", "arc_easy/mc_letter_v1", "loglik_mc", None, 0, E.offline_scorer(0))
    assert not ok and db.get_run(run_id)["status"] == "failed" and db.results(run_id).count() == 0


def test_ordinals_pool_and_slice(spark):
    rows = spark.range(100).select((99 - F.col("id")).alias("v"))
    got = D.with_ordinal(rows, [F.col("v")]).collect()
    assert all(r["v"] == r["ord"] for r in got) and len(got) == 100
    subjects = spark.createDataFrame([(1, "astronomy"), (2, "college_biology"), (3, "high_school_mathematics"), (4, "chess"), (5, "astronomy"), (6, "high_school_mathematics")], "v int, s string")
    assert [r["v"] for r in D.pooled(subjects, F.col("s"), [F.col("v")], 4).orderBy("ord").collect()] == [3, 6, 1, 5]
    a = {r["v"] for r in D.seeded_slice(rows, "v", 10).collect()}
    assert a == {r["v"] for r in D.seeded_slice(rows.repartition(7), "v", 10).collect()} and len(a) == 10


def test_sweep_runs_resumes_and_records(spark, data, tmp_path):
    db = Warehouse(spark, str(tmp_path / "db"))
    spec = sweep.Spec([("offline-a", ["main"])], [sweep.Target("arc_easy", "loglik_mc", "fixture", "arc_easy/mc_letter_v1"), sweep.Target("wikitext103", "perplexity", "fixture")], None, 0)
    assert [r["dataset"] for r in sweep.planned_runs(spark, spec).orderBy("ord").collect()] == ["arc_easy", "wikitext103"]
    first = sweep.run_sweep(db, data, spec, offline)
    assert (len(first.executed), first.failed, first.skipped) == (2, [], 0)
    again = sweep.run_sweep(db, data, spec, offline)
    assert (again.executed, again.skipped) == ([], 2)
    runs = {r["dataset"]: r.asDict() for r in db.runs().collect()}
    assert runs["arc_easy"]["status"] == "done" and set(runs["arc_easy"]["metrics"]) == {"acc", "acc_norm"} and runs["arc_easy"]["n_examples"] == 6
    config = json.loads(runs["arc_easy"]["config_json"])
    assert config["cache_misses"] == 18 and config["cache_hits"] == 0
    assert [r["example_id"] for r in db.results(runs["arc_easy"]["run_id"]).collect()] == [f"arc-{i}" for i in range(6)]
    # a warm run answers from the cache and gives the same results
    run_id, ok = sweep.execute(db, data, "offline-a", "main", "arc_easy", "fixture", "arc_easy/mc_letter_v1", "loglik_mc", None, 0, offline("", ""))
    assert ok and json.loads(db.get_run(run_id)["config_json"])["cache_hits"] == 18
    assert db.get_run(run_id)["metrics"] == runs["arc_easy"]["metrics"]
    # targeted deletion: counted first, then done
    keys = sweep.cache_keys(db, data, runs["arc_easy"])
    wrong = spark.createDataFrame([(run_id,)], "run_id string")
    assert db.invalidate(keys, wrong) == {"predictions": 18, "example_results": 6, "runs": 1}
    db.invalidate(keys, wrong, dry_run=False)
    assert db.get_run(run_id) is None and db.invalidate(keys, wrong) == {"predictions": 0, "example_results": 0, "runs": 0}


def test_failures_are_recorded_and_the_sweep_goes_on(spark, data, tmp_path):
    db = Warehouse(spark, str(tmp_path / "db"))
    spec = sweep.Spec([("nobody", ["main"]), ("offline-a", ["main"])], [sweep.Target("wikitext103", "perplexity", "fixture")])
    out = sweep.run_sweep(db, data, spec, lambda m, r: E.get_scorer("offline" if m.startswith("offline") else m))
    assert len(out.executed) == 2 and len(out.failed) == 1
    assert {r["model_id"]: r["status"] for r in db.runs().collect()} == {"nobody": "failed", "offline-a": "done"}


def test_counters_are_those_of_a_sequential_cache(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "request_hash string")
    known = spark.createDataFrame([("a", 1)], "request_hash string, answer int")
    got = store.counters(asked, known).first()
    assert (got["n_requests"], got["misses"], got["hits"]) == (4, 2, 2)
    assert sorted(r[0] for r in store.misses(asked, known).collect()) == ["b", "c"]


def test_resume_matches_null_with_null(spark):
    planned = spark.createDataFrame([(0, "m", "r", "d", "s", None, "perplexity", None, 0), (1, "m", "r", "d", "s", None, "perplexity", 5, 0), (2, "m", "r", "d", "s", None, "perplexity", 5, 0)], sweep.PLAN)
    done = planned.filter("ord = 0").drop("ord")
    assert [r["ord"] for r in sweep.todo(planned, done).collect()] == [1]


def test_cli(spark, data, tmp_path, capsys):
    db = ["--db", str(tmp_path / "db")]
    assert cli.main(["results", *db], spark) == 1
    run = ["run", *db, "--data", data, "--model", "offline", "--dataset", "arc_easy", "--split", "fixture", "--variant", "arc_easy/mc_letter_v1"]
    assert cli.main([*run, "--evaluator", "other"], spark) == 1
    assert cli.main([*run, "--evaluator", "loglik_mc"], spark) == 0
    run_id = capsys.readouterr().out.split()[0]
    assert cli.main(["results", *db], spark) == 0 and run_id in capsys.readouterr().out
    assert cli.main(["show", *db, "--run", run_id], spark) == 0
    assert cli.main(["show", *db, "--run", "run-none"], spark) == 1
    assert cli.main(["parity", *db, "--a", run_id, "--b", run_id], spark) == 0
    spec = tmp_path / "s.yaml"
    spec.write_text("models: [{model_id: offline, revisions: [main]}]\ntargets: [{dataset: arc_easy, variant: arc_easy/mc_letter_v1, evaluator: loglik_mc, split: fixture}]\nseed: 0\n")
    assert cli.main(["sweep", *db, "--data", data, "--spec", str(spec)], spark) == 0


def test_parity_categories(spark):
    d = lambda **k: json.dumps(k)
    a = [("same", True, d()), ("only", True, d()), ("gold", True, d(answer_index=1)), ("prompt", True, d(prompt="x")), ("extract", True, d(generation="g", extracted_number=1)),
         ("norm", True, d(logliks=[1.0], logliks_norm=[1.0])), ("tokens", True, d(logliks=[1.0])), ("why", True, d(logliks=[1.0]))]
    b = [("same", True, d()), ("gold", False, d(answer_index=2)), ("prompt", False, d(prompt="y")), ("extract", False, d(generation="g", extracted_number=2)),
         ("norm", False, d(logliks=[1.0], logliks_norm=[2.0])), ("tokens", False, d(logliks=[2.0])), ("why", False, d(logliks=[1.0]))]
    frame = lambda rows: spark.createDataFrame(rows, "example_id string, correct boolean, detail_json string")
    got = parity.parity(frame(a), frame(b))
    assert {r["example_id"]: r["category"] for r in got.collect()} == {
        "same": None, "only": "DATA_MISMATCH", "gold": "DATA_MISMATCH", "prompt": "PROMPT_FORMAT", "extract": "ANSWER_EXTRACTION",
        "norm": "NORMALIZATION", "tokens": "TOKENIZATION_BOUNDARY", "why": "UNEXPLAINED",
    }
    assert parity.agreement(got).first()["unexplained"] == 1


def runs(spark, rows):
    full = [(f"r{i}", *r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "run_id string, model_id string, revision string, dataset string, prompt_variant_id string, evaluator string, status string, metrics map<string,double>, seq int")


def test_reports(spark):
    r = runs(spark, [
        ("pythia-70m", "main", "arc_easy", "arc_easy/mc_letter_v1", "loglik_mc", "done", {"acc": 0.1}), ("pythia-70m", "main", "arc_easy", "arc_easy/mc_option_text_v1", "loglik_mc", "done", {"acc": 0.2, "acc_norm": 0.3}),
        ("pythia-1b", "step1000", "arc_easy", None, "loglik_mc", "done", {"acc": 0.4}), ("other", "main", "arc_easy", None, "loglik_mc", "done", {"acc": 0.9}),
        ("pythia-1b", "main", "wikitext103", None, "perplexity", "done", {"bpb": 1.0, "ppl": float("inf")}), ("pythia-1b", "main", "arc_easy", None, "loglik_mc", "failed", {"acc": 0.0}),
    ])
    grid = {(x["model_id"], x["dataset"], x["revision"]): x["value"] for x in reports.accuracy_grid(r).collect()}
    assert grid == {("pythia-70m", "arc_easy", "main"): 0.2, ("pythia-1b", "arc_easy", "step1000"): 0.4, ("pythia-1b", "wikitext103", "main"): 1.0}
    assert sorted(x["y"] for x in reports.scaling_points(r, "acc").collect()) == [0.1, 0.2]
    assert [x["points"][0]["y"] for x in reports.scaling_series(r, "acc").collect()] == [0.1]
    assert {x["axis"] for x in reports.headline_points(r).collect()} == {"acc", "bpb"}
    assert sorted(x["variant"] for x in reports.sensitivity_points(r).collect()) == ["arc_easy/mc_letter_v1", "arc_easy/mc_option_text_v1", "arc_easy/mc_option_text_v1 (acc_norm)"]
    assert sorted(x["x"] for x in reports.trajectory_points(r, "acc").collect()) == [1000, 143000, 143000, 143000]
    assert [x["model_id"] for x in reports.model_order(r).orderBy("rank").collect()] == ["pythia-70m", "pythia-1b", "other"]


def test_streaming_snapshot(spark, tmp_path):
    from gradloom.streaming import current_runs

    log = spark.sql("select 'r1' run_id, 'running' status, timestamp'2024-01-01 00:00:00' recorded_at union all select 'r1', 'done', timestamp'2024-01-02 00:00:00' union all select 'r2', 'failed', timestamp'2024-01-01 00:00:00'")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    current_runs.keep_current(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r["run_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"r1": "done", "r2": "failed"}


def test_harness_results_are_imported(spark, tmp_path):
    row = {"doc_id": "1", "example_id": "arc-1", "prompt": "p", "target": 2, "resps": [-1.0, -2.0], "resps_norm": None, "acc": 1.0, "generation": None, "extracted": None}
    (tmp_path / "h.jsonl").write_text(json.dumps(row) + "\n" + json.dumps(row | {"example_id": None, "acc": 0.0}) + "\n")
    got = {r["example_id"]: r for r in parity.import_harness(spark, str(tmp_path / "h.jsonl"), "run-h").collect()}
    assert got["arc-1"]["correct"] is True and json.loads(got["arc-1"]["detail_json"])["answer_index"] == 2
    assert got["1"]["correct"] is False and got["1"]["framework"] == "lm_eval_harness"


def test_an_imported_run_is_recorded_and_reported(spark, tmp_path):
    db = str(tmp_path / "db")
    lines = [{"doc_id": f"e{i}", "prompt": "p", "target": 0, "resps": [-1.0, -2.0], "resps_norm": [-0.5, -1.0], "acc": float(i % 2)} for i in range(6)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    lines[1]["acc"], lines[1]["prompt"] = 0.0, "other"
    lines[3]["acc"] = 0.0
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, lines[:5])))
    for name, more in (("a", []), ("b", ["--framework", "other_harness", "--model", "pythia-70m", "--dataset", "arc_easy", "--split", "test"])):
        assert cli.main(["import", "--db", db, "--file", str(tmp_path / f"{name}.jsonl"), "--run", name, *more], spark) == 0
    run = Warehouse(spark, db).get_run("b")
    assert (run["framework"], run["model_id"], run["status"], run["n_examples"], run["metrics"]) == ("other_harness", "pythia-70m", "done", 5, {"acc": 0.0})
    assert Warehouse(spark, db).get_run("a")["framework"] == "lm_eval_harness"
    assert cli.main(["show", "--db", db, "--run", "a"], spark) == 0
    report = tmp_path / "report.md"
    assert cli.main(["parity", "--db", db, "--a", "a", "--b", "b", "--report", str(report)], spark) == 1  # one difference is unexplained
    text = report.read_text()
    assert "3 of 6 examples agree" in text and "| PROMPT_FORMAT | 1 |" in text and "## DATA_MISMATCH\n\n- e5" in text and "| UNEXPLAINED | 1 |" in text and "fails" in text
    assert cli.main(["parity", "--db", db, "--a", "a", "--b", "nobody"], spark) == 1


def test_an_answer_written_later_wins(spark, tmp_path):
    db = Warehouse(spark, str(tmp_path / "cache"))
    asked = spark.createDataFrame([("h", "q")], "request_hash string, prompt string")
    for value in (-1.0, -2.0):
        row = spark.createDataFrame([("h", (value, 1, True, None, None, None), int(-value), "m", "r")], store._CACHE)
        row.write.mode("append").partitionBy("model_id", "revision").parquet(f"{db.root}/predictions")
    cache = store.PredictionCache(db)
    got = cache.scorer(lambda rows: rows, "m", "r")(asked).first()
    assert got["answer"]["loglik"] == -2.0 and (cache.hits, cache.misses) == (1, 0)
