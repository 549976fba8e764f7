import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradloom.operators import evaluators as E
from gradloom.operators import metrics as M
from gradloom.operators import render
from gradloom.operators.windows import window_spans

PANGRAM = "the quick brown fox jumps over the lazy dog"


def loop_windows(n, window, stride):
    """The windows as a loop over the text finds them."""
    out, covered, start = [], 0, 0
    while start < n:
        end = min(start + window, n)
        context = max(0, covered - start)
        if end > max(covered, start):
            out.append((start, context, end - start - context))
        covered = max(covered, end)
        if end == n:
            break
        start += stride
    return out


@pytest.mark.parametrize(("window", "stride"), [(4, 2), (4, 4), (4, 6), (1, 1), (7, 3), (1024, 512)])
def test_windows_equal_the_loop(spark, window, stride):
    sizes = spark.createDataFrame([(n,) for n in range(1, 60)], "n int")
    got = {}
    for r in window_spans(sizes, "n", window, stride).orderBy("n", "k").collect():
        got.setdefault(r["n"], []).append((r["start"], r["context_words"], r["scored_words"]))
    assert got == {n: loop_windows(n, window, stride) for n in range(1, 60)}


def texts(spark, rows):
    return spark.createDataFrame(rows, "example_id string, text string")


def ppl(spark, rows, window, stride, model="dummy"):
    t = texts(spark, rows)
    return E.perplexity_results(E.offline_scorer(0)(E.window_requests(t, "example_id", "text", model, "main", window, stride)), t, "example_id", "text")


def test_windowed_perplexity_golden(spark):
    rows = ppl(spark, [("d", PANGRAM)], 4, 2)
    detail = rows.first()["detail"]
    assert detail["window_nlls"] == pytest.approx([2.5368, 0.5216, 3.6888, 1.39, 3.1928, 2.6388, 2.266, 1.0036, 1.4304])
    m = rows.agg(*[v.alias(k) for k, v in M.for_evaluator("perplexity", rows).items()]).first()
    assert m["ppl"] == pytest.approx(7.959061660899256, rel=1e-12)
    assert m["bpb"] == pytest.approx(0.6263577948685553, rel=1e-12)
    assert (m["n_tokens"], m["n_bytes"]) == (9, 43)


def test_totals_equal_the_scored_windows(spark):
    t = texts(spark, [("a", PANGRAM * 3), ("b", "one"), ("c", ""), ("d", "x  y\nz")])
    asked = E.window_requests(t, "example_id", "text", "m", "main", 4, 2)
    nlls = F.aggregate("answer.token_nlls", F.lit(0.0), lambda a, x: a + x)
    scored = E.offline_scorer(0)(asked).groupBy("example_id").agg(F.round(F.sum(nlls) * 10_000).cast("bigint").alias("units"), F.sum(F.size("answer.token_nlls")).alias("tokens"))
    want = scored.collect()
    got = E.offline_totals(asked).select("example_id", "units", "tokens").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3
    every = E.window_requests(t.withColumn("lang", F.lit("en")), "example_id", "text", "m", "main", 4, 2, ("lang",), empty=True)
    rows = {r["example_id"]: (r["lang"], r["units"], r["tokens"]) for r in E.offline_totals(every, carry=("lang",)).collect()}
    assert rows["c"] == ("en", 0, 0) and {k: v[1:] for k, v in rows.items() if k != "c"} == {r["example_id"]: (r["units"], r["tokens"]) for r in got}


def test_texts_without_words_score_nothing(spark):
    rows = {r["example_id"]: r for r in ppl(spark, [("e", ""), ("s", " \n"), ("w", "a")], 4, 2).collect()}
    assert rows["e"]["score"] == rows["s"]["score"] == 0.0
    assert rows["s"]["detail"]["n_bytes"] == 2 and rows["e"]["detail"]["window_nlls"] == []
    assert len(rows["w"]["detail"]["window_nlls"]) == 1 and rows["w"]["correct"] is None


def results(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_perplexity_is_micro_averaged(spark):
    rows = results(spark, [([1.0, 1.0], 5), ([3.0], 3)], "nlls array<double>, b bigint")
    m = rows.agg(*[v.alias(k) for k, v in M.perplexity(F.col("nlls"), F.col("b")).items()]).first()
    assert m["ppl"] == pytest.approx(5.29449005047003) and m["bpb"] == pytest.approx(0.9016844005556022)
    empty = rows.filter("false").agg(*[v.alias(k) for k, v in M.perplexity(F.col("nlls"), F.col("b")).items()]).first()
    assert empty["ppl"] == math.inf and empty["bpb"] == 0.0 and empty["n_tokens"] == 0


def test_accuracy_counts_null_as_wrong(spark):
    rows = results(spark, [(True,), (None,), (False,)], "c boolean")
    assert rows.agg(M.acc(F.col("c"))).first()[0] == pytest.approx(1 / 3)
    assert rows.filter("false").agg(M.acc(F.col("c"))).first()[0] == 0.0


def test_cloze_means(spark):
    rows = results(spark, [(2.0, math.exp(2), True), (4.0, math.exp(4), False)], "nll double, ppl double, m boolean")
    m = rows.agg(*[v.alias(k) for k, v in M.cloze(F.col("nll"), F.col("ppl"), F.col("m")).items()]).first()
    assert (m["target_nll_mean"], m["nonstandard_generated_word_acc"]) == (3.0, 0.5)
    assert m["target_ppl_mean"] == pytest.approx((math.exp(2) + math.exp(4)) / 2)


MC = "example_id string, payload struct<question: string, choices: array<string>, answer_index: int>"


def test_render_letters_and_braces(spark):
    rows = spark.createDataFrame([("a", ("What {choices} is it?", ["x", "y {question}"], 1))], MC)
    got = render.render(rows, render.load_variant("arc_easy/mc_letter_v1")).first()
    assert got["prompt"] == "Question: What {choices} is it?\nA. x\nB. y {question}\nAnswer:\n"
    assert got["continuations"] == [" A", " B"] and got["kind"] == "loglik" and got["gen_params"] is None
    got = render.render(rows, render.load_variant("arc_easy/mc_option_text_v1")).first()
    assert got["continuations"] == [" x", " y {question}"]


def test_render_other_families(spark):
    cloze = spark.createDataFrame([("a", ("some context", "word"))], "example_id string, payload struct<context: string, target: string>")
    got = render.render(cloze, render.load_variant("lambada/cloze_v1")).first()
    assert got["prompt"] == "some context" and got["kind"] == "generate" and got["gen_params"] is None
    number = spark.createDataFrame([("a", ("How many?", 3.0))], "example_id string, payload struct<question: string, answer_number: double>")
    got = render.render(number, render.load_variant("gsm8k/gen_v1")).first()
    assert got["prompt"].startswith("Question: How many?\nSolve") and got["gen_params"]["max_new_tokens"] == 256 and got["gen_params"]["stop"] == ["Question:"]
    with pytest.raises(NotImplementedError):
        render.render(cloze, render.Variant("x", "other", ""))
    with pytest.raises(KeyError):
        render.load_variant("none/such")


def test_fewshot_order_and_prefix(spark):
    rows = [(i, ("q%d" % i, ["a", "b"], i % 2)) for i in range(5)]
    pool = spark.createDataFrame(rows, "ord int, payload struct<question: string, choices: array<string>, answer_index: int>")
    variant = render.load_variant("arc_easy/mc_letter_5shot_v1")
    demos = render.sample_demos(pool, variant)
    assert [d["question"] for d in demos] == ["q3", "q4", "q0", "q1", "q2"]
    prefix = render.fewshot_prefix(variant, demos[:1])
    assert prefix == "Question: q3\nA. a\nB. b\nAnswer:\n B\n\n"
    with pytest.raises(ValueError):
        render.sample_demos(pool.filter("ord < 3"), variant)


def rigged(values):
    """A scorer that knows each continuation's log-likelihood."""
    def score(requests):
        table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        null = lambda t: F.lit(None).cast(t)
        answer = F.struct(table[F.col("continuation")].alias("loglik"), F.lit(1).alias("n_tokens"), F.lit(True).alias("is_greedy_match"), null("array<double>").alias("token_nlls"), null("bigint").alias("n_bytes"), null("string").alias("generation"))
        return requests.withColumn("answer", answer)
    return score


def test_choice_raw_and_by_bytes(spark):
    rows = spark.createDataFrame([("a", ("q", ["long answer text", "no"], 0))], MC)
    scored = rigged({" long answer text": -4.0, " no": -3.0})(E.mc_requests(rows, render.load_variant("arc_easy/mc_option_text_v1"), "m", "main"))
    got = E.mc_results(scored).first()
    assert got["detail"]["chosen_index"] == 1 and got["detail"]["chosen_index_norm"] == 0
    assert got["correct"] is False and got["detail"]["correct_norm"] is True and got["score"] == 0.0


def test_cloze_budget_is_four_a_word(spark):
    rows = spark.createDataFrame([("a", ("context", "three word target"))], "example_id string, payload struct<context: string, target: string>")
    asked = E.cloze_requests(rows, render.load_variant("lambada/cloze_v1"), "m", "main")
    got = {r["kind"]: r for r in asked.collect()}
    assert got["generate"]["max_new_tokens"] == 12 and got["generate"]["stop"] == ["\n"] and got["loglik"]["continuation"] == " three word target"


def test_generative_needs_the_exact_number(spark):
    rows = spark.createDataFrame([("a", 5.0, ("Final answer: 5",)), ("b", 5.0, ("none",)), ("c", 5.0, (None,))], "example_id string, answer_number double, answer struct<generation: string>")
    assert {r["example_id"]: r["correct"] for r in E.generative_results(rows).collect()} == {"a": True, "b": False, "c": False}


def test_unknown_names():
    with pytest.raises(KeyError):
        E.get_scorer("nobody")


def test_model_backed_scorer(spark):
    def load():
        def model(requests: pd.DataFrame) -> pd.DataFrame:
            n = len(requests)
            return pd.DataFrame({"loglik": [-float(len(c)) for c in requests["continuation"]], "n_tokens": [1] * n, "is_greedy_match": [True] * n, "token_nlls": [None] * n, "n_bytes": [None] * n, "generation": [None] * n})

        return model, lambda: None

    rows = spark.createDataFrame([("a", ("q", ["longer", "no"], 1))], MC)
    got = E.mc_results(E.batch_scorer(load)(E.mc_requests(rows, render.load_variant("arc_easy/mc_option_text_v1"), "m", "main"))).first()
    assert got["correct"] is True and list(got["detail"]["logliks"]) == [-7.0, -3.0]
