"""Queries of the evaluation engine over the given tables; their SQL is in :mod:`.oracle`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import evaluators as E
from .operators import metrics as M
from .operators import render, store, table_diff
from .operators.windows import window_spans
from .plans import parity, reports, sweep
from .session import spread, table, work_dir
from .sources import datasets as D

MODEL, REVISION = "offline-7", "main"
WINDOW, STRIDE = 64, 32
POOL_LIMIT, LOAD_LIMIT = 300, 50
_SCORE = E.offline_scorer(0)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "lang", "text"))


def _doc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood, tokens and bytes of each document, those without words included. Documents are read once; language and bytes travel with the windows."""
    requests = E.window_requests(_documents(spark, sf_dir), "doc_id", "text", MODEL, REVISION, WINDOW, STRIDE, ("lang",), empty=True)
    totals = E.offline_totals(requests.drop("request_hash"), carry=("lang",))
    return totals.select(F.col("example_id").alias("doc_id"), "lang", "units", F.col("tokens").alias("n_tok"), F.col("raw_bytes").alias("n_bytes"))


def _nats(units):
    return units / 10_000.0


def ppl_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed perplexity and bits per byte by language, micro-averaged."""
    by = _doc_totals(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("units").alias("units"), F.sum("n_tok").alias("n_tok"), F.sum("n_bytes").alias("n_bytes"))
    nll = _nats(F.col("units"))
    return by.select("lang", "n_docs", "n_tok", "n_bytes", F.round(M.perplexity_of(nll, F.col("n_tok")), 6).alias("ppl"), F.round(M.bits_per_byte(nll, F.col("n_bytes")), 6).alias("bpb"))


def doc_bpb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per byte of each document."""
    rows = _doc_totals(spark, sf_dir)
    return rows.select("doc_id", "n_tok", "n_bytes", F.round(M.bits_per_byte(_nats(F.col("units")), F.col("n_bytes")), 6).alias("bpb"))


def ppl_micro_vs_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per byte by language, of all bytes together and as a mean over documents."""
    rows = _doc_totals(spark, sf_dir).withColumn("one", M.bits_per_byte(_nats(F.col("units")), F.col("n_bytes")))
    by = rows.groupBy("lang").agg(F.sum("units").alias("units"), F.sum("n_bytes").alias("n_bytes"), F.avg("one").alias("macro"))
    return by.select("lang", F.round(M.bits_per_byte(_nats(F.col("units")), F.col("n_bytes")), 6).alias("micro_bpb"), F.round("macro", 6).alias("macro_bpb"))


def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of each document."""
    sized = _documents(spark, sf_dir).select("doc_id", F.size(X.words(F.col("text"))).alias("n")).filter("n > 0")
    return window_spans(sized, "n", WINDOW, STRIDE).select("doc_id", "k", "start", "context_words", "scored_words")


def heading_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows that are neither blank nor headings, stripped."""
    rows = table(spark, sf_dir, "wikitext").select("row_no", F.col("payload.text").alias("text")).filter(D.is_body_line(F.col("text")))
    return rows.select("row_no", X.strip(F.col("text")).alias("text"))


def seeded_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed slice of 200 documents by seeded hash order."""
    return D.seeded_slice(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "ord")


def pooled_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's subjects one after the other, under one limit."""
    rows = table(spark, sf_dir, "mmlu").select("row_no", F.col("payload.subject").alias("subject"))
    return D.pooled(rows, F.col("subject"), [F.col("row_no")], POOL_LIMIT).select("ord", "row_no", "subject")


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made from the raw question."""
    return table(spark, sf_dir, "mmlu").select("row_no", D.mmlu_id(F.col("payload.subject"), F.col("payload.question")).alias("content_id"))


def _cloze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as cloze items: their last word is the target."""
    rows = table(spark, sf_dir, "wikitext").filter(D.is_body_line(F.col("payload.text")))
    context, target = X.last_word_split(F.col("payload.text"))
    return rows.select(F.col("row_no").alias("example_id"), F.struct(context.alias("context"), target.alias("target")).alias("payload"))


def cloze_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context and last word."""
    return _cloze(spark, sf_dir).select(F.col("example_id").alias("row_no"), "payload.context", "payload.target")


def _cloze_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cloze_results(_SCORE(E.cloze_requests(_cloze(spark, sf_dir), render.load_variant("lambada/cloze_v1"), MODEL, REVISION)))


def cloze_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of cloze items."""
    rows = _cloze_results(spark, sf_dir)
    return rows.select(F.col("example_id").alias("row_no"), "correct", F.round("detail.target_nll", 6).alias("target_nll"), F.round("detail.target_ppl", 4).alias("target_ppl"), "detail.generation", F.col("detail.nonstandard_generated_word_acc").alias("word_match"))


def cloze_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloze metrics over all items."""
    m = M.for_evaluator("cloze", None)
    return _cloze_results(spark, sf_dir).agg(*[F.round(v, 4).alias(k) for k, v in m.items()])


def _mc(spark: SparkSession, sf_dir: str, name: str = "arc_easy") -> DataFrame:
    rows = table(spark, sf_dir, name).filter("payload.question is not null and payload.choices is not null and payload.answer_index is not null")
    return rows.select(F.col("row_no").alias("example_id"), "split", "payload")


def _rendered(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    rows = render.render(_mc(spark, sf_dir), render.load_variant(variant))
    return rows.select(F.col("example_id").alias("row_no"), "prompt", F.array_join("continuations", "|").alias("continuations"))


def mc_render_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts scored by letter."""
    return _rendered(spark, sf_dir, "arc_easy/mc_letter_instr_v1")


def mc_render_option_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts scored by the options' texts."""
    return _rendered(spark, sf_dir, "arc_easy/mc_option_text_v1")


def fewshot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts after three demonstrations, the first train rows."""
    rows = _mc(spark, sf_dir)
    first = rows.filter("split = 'train'").orderBy("example_id").limit(3).collect()
    shown = render.render(rows.filter("split <> 'train'"), render.load_variant("arc_easy/mc_letter_v1"), [r["payload"].asDict() for r in first])
    return shown.select(F.col("example_id").alias("row_no"), "prompt")


def _mc_results(spark: SparkSession, sf_dir: str, variant: str, name: str) -> DataFrame:
    return E.mc_results(_SCORE(E.mc_requests(_mc(spark, sf_dir, name), render.load_variant(variant), MODEL, REVISION)))


def mc_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice results by letter."""
    rows = _mc_results(spark, sf_dir, "arc_easy/mc_letter_v1", "arc_easy")
    return rows.select(F.col("example_id").alias("row_no"), "correct", "detail.answer_index", "detail.chosen_index", "detail.chosen_index_norm", "detail.correct_norm")


def mc_acc_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and normalised accuracy by prompt variant."""
    out = None
    for variant in ("arc_easy/mc_letter_v1", "arc_easy/mc_option_text_v1", "mmlu/mc_letter_v1", "mmlu/mc_option_text_v1"):
        m = M.for_evaluator("loglik_mc", None)
        one = _mc_results(spark, sf_dir, variant, variant.split("/")[0]).agg(F.count("*").alias("n_examples"), *[F.round(v, 6).alias(k) for k, v in m.items()])
        one = one.select(F.lit(variant).alias("variant"), "n_examples", "acc", "acc_norm")
        out = one if out is None else out.unionByName(one)
    return out


def acc_null_is_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each run over its current results; a missing verdict is wrong."""
    rows = store.latest(table(spark, sf_dir, "example_results").select(F.struct("run_id", "example_id").alias("k"), "correct", "recorded_at", F.struct("recorded_at", "correct", "score").alias("v")), "k", "v")
    return rows.groupBy("k.run_id").agg(F.count("*").alias("n_examples"), F.round(M.acc(F.col("correct") == 1), 6).alias("acc"))


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from_json = F.from_json("payload_json", "generation string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = table(spark, sf_dir, "predictions").select("request_hash", from_json.alias("p")).filter("p._bad is null and p.generation is not null")
    return rows.select("request_hash", F.col("p.generation").alias("generation")).distinct()


def extract_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that each generation answers with."""
    return _generations(spark, sf_dir).select("request_hash", "generation", X.extract_number(F.col("generation")).alias("number"))


def stop_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations cut at the earliest stop."""
    rows = _generations(spark, sf_dir).select("request_hash", "generation", X.truncate_at(F.col("generation"), ["\n", ". ", "Answer"]).alias("cut"))
    return rows


def generative_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generative results of the number problems."""
    rows = table(spark, sf_dir, "gsm8k").filter("payload.question is not null and payload.answer_number is not null").select(F.col("row_no").alias("example_id"), "payload")
    scored = E.generative_results(_SCORE(E.generative_requests(rows, render.load_variant("gsm8k/gen_v1"), MODEL, REVISION)))
    return scored.select(F.col("example_id").alias("row_no"), "correct", "detail.generation", "detail.extracted_number")


def _mc_keys(spark: SparkSession, sf_dir: str, split: str | None) -> DataFrame:
    rows = _mc(spark, sf_dir)
    rows = rows.filter("split = 'train'") if split == "train" else rows
    asked = E.mc_requests(rows, render.load_variant("arc_easy/mc_letter_v1"), MODEL, REVISION)
    return asked.join(rows.select("example_id", "split"), "example_id").select("split", "request_hash")


def cache_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hits and misses by split, the train split's answers being known."""
    return store.counters(_mc_keys(spark, sf_dir, None), _mc_keys(spark, sf_dir, "train"), "split")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct requests without an answer, by split of their first use."""
    new = store.misses(_mc_keys(spark, sf_dir, None), _mc_keys(spark, sf_dir, "train").distinct())
    return new.agg(F.count("*").alias("n_missing"))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that the cache answers, by split."""
    known = _mc_keys(spark, sf_dir, "train").select("request_hash").distinct().withColumn("answer", F.lit(True))
    return store.hits(_mc_keys(spark, sf_dir, None), known).groupBy("split").agg(F.count("*").alias("n_hits"))


def sweep_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned runs of every specification."""
    return sweep.expand_sweeps(table(spark, sf_dir, "sweep_specs"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.latest(table(spark, sf_dir, "runs"), "run_id", "recorded_at")
    return rows.withColumn("metrics", reports.parse_metrics(F.col("metrics_json"))).withColumn("seq", F.struct("recorded_at", "run_id"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current version of each run."""
    return store.latest(table(spark, sf_dir, "runs"), "run_id", "recorded_at").select("run_id", "model_id", "revision", "status", "n_examples", "started_at", "finished_at")


def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned runs of all specifications that no finished run covers."""
    plan = sweep.expand_sweeps(table(spark, sf_dir, "sweep_specs")).withColumn("ord", F.col("sweep_id") * 10_000 + F.col("ord"))
    return sweep.todo(plan, sweep.done_keys(_runs(spark, sf_dir)))


def grid_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy grid."""
    return reports.accuracy_grid(_runs(spark, sf_dir)).withColumn("value", F.round("value", 6))


def scaling_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy against size, with the chance rate."""
    points = reports.scaling_points(_runs(spark, sf_dir), "acc").join(F.broadcast(reports.chance_rates(spark)), "dataset", "left")
    return points.select("dataset", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "chance")


def headline_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline figure's points."""
    return reports.headline_points(_runs(spark, sf_dir)).select("axis", "dataset", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def sensitivity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by prompt variant."""
    return reports.sensitivity_points(_runs(spark, sf_dir)).select("dataset", "variant", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def trajectory_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy against the training step."""
    return reports.trajectory_points(_runs(spark, sf_dir), "acc").select("model_id", "dataset", "x", F.round("y", 6).alias("y"))


def model_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by size."""
    return reports.model_order(table(spark, sf_dir, "runs"))


def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current runs by status."""
    return _runs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n_runs"))


def invalidate_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What dropping the number problems' runs and predictions would remove."""
    wrong = _runs(spark, sf_dir).filter("dataset = 'gsm8k' and status = 'done'").select("run_id")
    results = table(spark, sf_dir, "example_results").join(wrong, "run_id", "left_semi").agg(F.count("*").alias("n_results"))
    keys = table(spark, sf_dir, "predictions").filter("prompt_variant_id = 'gsm8k/gen_v1'").agg(F.count_distinct("request_hash").alias("n_predictions"))
    # Each side is one row of counts.
    return wrong.agg(F.count("*").alias("n_runs")).join(results, F.lit(True)).join(keys, F.lit(True))


def _parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parity join of every harness run with the run it repeats, adds ``harness``. Other runs' results are left out before they are grouped."""
    pairs = table_diff.parity_pairs(table(spark, sf_dir, "runs"))
    asked = pairs.select(F.col("base").alias("run_id")).unionByName(pairs.select(F.col("harness").alias("run_id"))).distinct()
    wanted = table(spark, sf_dir, "example_results").join(asked, "run_id", "left_semi")
    rows = wanted.groupBy("run_id", "example_id").agg(F.max_by(F.struct("correct", "detail_json"), F.struct("recorded_at", "correct", "detail_json")).alias("v"))
    flat = rows.select("run_id", "example_id", (F.col("v.correct") == 1).alias("correct"), F.col("v.detail_json").alias("detail_json"))

    def side(column: str) -> DataFrame:
        own = pairs.select(F.col("harness").alias("h"), F.col(column).alias("run_id"))
        return flat.join(own, "run_id").select(F.concat_ws("|", "h", "example_id").alias("example_id"), "correct", "detail_json")

    return parity.parity(side("base"), side("harness")).withColumn("harness", F.substring_index("example_id", "|", 1))


def parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of each harness run with the run it repeats."""
    by = _parity(spark, sf_dir).groupBy("harness")
    return by.agg(F.count("*").alias("n"), F.sum(F.col("agree").cast("int")).alias("n_agree"), F.sum(F.when(F.col("category") == "DATA_MISMATCH", 1).otherwise(0)).alias("n_data_mismatch"))


def parity_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disagreements of each harness run by category."""
    return _parity(spark, sf_dir).filter("category is not null").groupBy("harness", "category").agg(F.count("*").alias("n"))


def _loaded(spark: SparkSession, sf_dir: str, dataset: str, *fields: str) -> DataFrame:
    rows = D.get_loader(dataset)(spark, sf_dir, "test", LOAD_LIMIT)
    return rows.select("ord", "dataset", "split", "example_id", *[F.col(f"payload.{f}").alias(f) for f in fields])


def load_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first test examples, re-delivered rows being one."""
    return _loaded(spark, sf_dir, "arc_easy", "question", "answer_index")


def load_mmlu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first test examples of the pooled subjects."""
    return _loaded(spark, sf_dir, "mmlu", "subject", "question", "answer_index")


def load_wikitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first test texts that are neither blank nor headings."""
    return _loaded(spark, sf_dir, "wikitext103", "text")


def load_gsm8k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first test problems."""
    return _loaded(spark, sf_dir, "gsm8k", "question", "answer_number")


def shared_split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that the train split shares with the test split."""
    rows = table(spark, sf_dir, "arc_easy")
    return D.shared_ids(rows.filter("split = 'train'"), rows.filter("split = 'test'"))


def normalised_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw multiple-choice rows, with labels instead of an answer's number, made examples."""
    rows = _mc(spark, sf_dir).filter("answer_index between 0 and size(payload.choices) - 1".replace("answer_index", "payload.answer_index"))
    label = F.transform("payload.choices", lambda x, i: F.char(i + 65))
    raw = rows.select(F.col("example_id").cast("string").alias("id"), "payload.question", F.struct(label.alias("label"), F.col("payload.choices").alias("text")).alias("choices"), F.element_at(label, F.col("payload.answer_index") + 1).alias("answerKey"))
    return D.normalise_arc(raw, "test").select("example_id", "payload.question", F.size("payload.choices").alias("n_choices"), "payload.answer_index")


def rendered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw endings of a context made examples and rendered: the context is the prompt, the endings' texts are scored."""
    raw = _mc(spark, sf_dir).select(F.col("example_id").alias("ind"), F.col("payload.question").alias("ctx"), F.col("payload.choices").alias("endings"), F.col("payload.answer_index").cast("string").alias("label"))
    shown = render.render(D.normalise_hellaswag(raw, "test"), render.load_variant("hellaswag/mc_context_v1"))
    return shown.select("example_id", "prompt", F.array_join("continuations", "|").alias("continuations"), "payload.answer_index")


def gold_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers that end in a number with thousands marks, made examples."""
    raw = table(spark, sf_dir, "gsm8k").filter("payload.question is not null and payload.answer_number is not null").select(
        F.col("row_no").alias("ord"), "payload.question", F.concat(F.lit("so far 12\n#### "), F.format_number(F.col("payload.answer_number").cast("bigint"), 0)).alias("answer")
    )
    return D.normalise_gsm8k(raw, "test").select("ord", "payload.answer_number")


def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaling curve of each dataset as one ordered series, in millionths, with the chance rate."""
    rows = reports.scaling_series(_runs(spark, sf_dir), "acc")
    text = F.array_join(F.transform("points", lambda p: F.concat_ws(":", F.round(p["x"] * 1_000_000).cast("bigint").cast("string"), F.round(p["y"] * 1_000_000).cast("bigint").cast("string"))), " ")
    return rows.select("dataset", F.size("points").cast("bigint").alias("n_points"), text.alias("points"), "chance")


def seeded_demonstrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts after the five demonstrations that the variant's seed draws from the train split."""
    variant = render.load_variant("arc_easy/mc_letter_5shot_v1")
    pool = D.get_loader("arc_easy")(spark, sf_dir, "train").filter("payload.question is not null and payload.choices is not null and payload.answer_index is not null")
    demos = render.sample_demos(D.with_ordinal(pool.drop("ord"), [F.col("row_no")]), variant)
    shown = render.render(_mc(spark, sf_dir).filter("split = 'test'"), variant, demos)
    return shown.select(F.col("example_id").alias("row_no"), "prompt")


def cached_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a multiple-choice run and of a cloze run, each cold and once more, with a cache that is written and read."""
    warehouse = store.Warehouse(spark, work_dir(spark))
    out = []
    for name, asked in (
        ("loglik_mc", E.mc_requests(_mc(spark, sf_dir), render.load_variant("arc_easy/mc_letter_v1"), MODEL, REVISION)),
        ("cloze", E.cloze_requests(_cloze(spark, sf_dir), render.load_variant("lambada/cloze_v1"), MODEL, REVISION)),
    ):
        for attempt in (1, 2):
            cache = store.PredictionCache(warehouse)
            unanswered = cache.scorer(_SCORE, MODEL, REVISION)(asked).filter("answer is null").count()
            out.append((name, attempt, cache.hits, cache.misses, unanswered))
    return spark.createDataFrame(out, "evaluator string, attempt int, hits bigint, misses bigint, unanswered bigint")


def sweep_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small sweep run into a fresh warehouse and started again, by run: what was recorded, how many results it has, and how many runs the second start left out."""
    spec = sweep.Spec(
        [(MODEL, [REVISION, "step1000"])],
        [sweep.Target("arc_easy", "loglik_mc", "test", "arc_easy/mc_letter_v1"), sweep.Target("gsm8k", "generative", "test", "gsm8k/gen_v1"), sweep.Target("wikitext103", "perplexity", "test")],
        limit=20,
    )
    warehouse = store.Warehouse(spark, work_dir(spark))
    first = sweep.run_sweep(warehouse, sf_dir, spec, lambda model, revision: _SCORE)
    again = sweep.run_sweep(warehouse, sf_dir, spec, lambda model, revision: _SCORE)
    results = spark.read.parquet(f"{warehouse.root}/example_results").groupBy("run_id").agg(F.count("*").alias("n_results"))
    runs = warehouse.runs().filter(F.col("run_id").isin(first.executed)).join(results, "run_id", "left")
    return runs.select("model_id", "revision", "dataset", "evaluator", "status", F.col("n_examples").cast("bigint").alias("n_examples"), "n_results", F.lit(again.skipped).cast("bigint").alias("n_skipped"))


def json_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of JSON text."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def token_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored words of each document over its windows, and whether each word was scored once."""
    plan = window_plan(spark, sf_dir).groupBy("doc_id").agg(F.sum("scored_words").alias("scored"), F.count("*").alias("n_windows"))
    sized = _documents(spark, sf_dir).select("doc_id", F.size(X.words(F.col("text"))).alias("n_words"))
    return sized.join(plan, "doc_id").select("doc_id", "n_words", "scored", "n_windows")


QUERIES = {
    f.__name__: f
    for f in (
        ppl_by_lang, doc_bpb, window_plan, ppl_micro_vs_macro, token_contiguity, heading_filter, seeded_slice, pooled_limit, content_ids, cloze_split, cloze_scored, cloze_metrics,
        mc_render_letter, mc_render_option_text, fewshot_prompts, mc_results, mc_acc_by_variant, acc_null_is_wrong, extract_number, stop_truncate, generative_results,
        cache_counters, cache_misses, cache_hits, sweep_plan, resume_todo, latest_run, failed_runs, grid_last_write, scaling_series, headline_series, sensitivity_series, trajectory_series,
        model_order, invalidate_dry_run, parity_diff, parity_categories, json_detail,
        load_arc, load_mmlu, load_wikitext, load_gsm8k, shared_split_ids, normalised_arc, rendered_context, gold_numbers, series_points, seeded_demonstrations, cached_rerun, sweep_executed,
    )
}
