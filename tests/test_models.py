import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradloom.operators import evaluators as E
from gradloom.operators import models, render


class Letters:
    """A model of single characters that expects the next letter of the alphabet."""

    def encode(self, text):
        return [ord(c) % 128 for c in text]

    passes = 0

    def logprobs(self, sequences):
        self.passes += 1
        out = []
        for ids in sequences:
            rows = np.full((len(ids), 128), -5.0)
            rows[np.arange(len(ids)), [(i + 1) % 128 for i in ids]] = -0.5
            out.append(rows)
        return out

    def generate(self, text, max_new_tokens, temperature):
        return ("xyz\nmore" * 50 if temperature == 0 else "drawn")[:max_new_tokens]

    def unload(self):
        self.passes = -1


def test_continuations_are_tokenized_with_their_prompt():
    assert models.continuation_score(Letters(), "ab", "cd") == (-1.0, 2, True)
    assert models.continuation_score(Letters(), "ab", "cx") == (-5.5, 2, False)
    assert models.continuation_score(Letters(), "ab", "") == (0.0, 0, False)


def test_windows_have_one_space_and_no_first_token_alone():
    assert models.window_nlls(Letters(), "", "abc") == [0.5, 0.5]
    assert models.window_nlls(Letters(), "a", "b") == [5.0, 5.0]
    assert models.window_nlls(Letters(), "", "") == []


def test_a_batch_is_passed_together_and_equal_sequences_once():
    model = Letters()
    none = dict(context=None, max_new_tokens=None, stop=None, temperature=0.0)
    asked = pd.DataFrame([dict(kind="loglik", prompt="ab", continuation=c, **none) for c in ("cd", "cx", "cd", "")] + [dict(kind="nll", prompt="abc", continuation=None, **none)])
    got = models.answers(model, asked)
    assert got["loglik"].tolist()[:4] == [-1.0, -5.5, -1.0, 0.0] and got["n_tokens"].tolist()[:4] == [2, 2, 2, 0]
    assert got["token_nlls"][4] == [0.5, 0.5] and got["n_bytes"][4] == 3 and model.passes == 2
    drawn = models.answers(model, pd.DataFrame([dict(kind="generate", prompt="a", continuation=None, context=None, max_new_tokens=9, stop=None, temperature=0.7)]))
    assert drawn["generation"][0] == "drawn"
    assert sorted(i for b in models.in_batches([[0] * n for n in (9000, 3, 8000, 5)]) for i in b) == [0, 1, 2, 3]


def test_models_by_name_reach_the_hub(spark, tmp_path, monkeypatch):
    """``run --model pythia-70m`` loads that model, on more than one task; one that can't be loaded fails its run only."""
    import sys

    from pyspark import cloudpickle

    from gradloom import cli

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    asked = []
    monkeypatch.setattr(models, "hub_scorer", lambda repository, revision: asked.append((repository, revision)) or models.model_scorer(Letters))
    spark.createDataFrame(
        [("arc_easy", "test", f"e{i}", (f"question {i}", ["a", "b"], 0), i, None) for i in range(40)],
        "dataset string, split string, example_id string, payload struct<question: string, choices: array<string>, answer_index: int>, row_no bigint, added_at timestamp",
    ).write.parquet(f"{tmp_path}/arc_easy.parquet")
    args = ["run", "--db", f"{tmp_path}/db", "--data", str(tmp_path), "--dataset", "arc_easy", "--evaluator", "loglik_mc", "--variant", "arc_easy/mc_letter_v1", "--revision", "step1000"]
    assert cli.main([*args, "--model", "pythia-70m"], spark) == 0
    assert asked == [("EleutherAI/pythia-70m", "step1000")]
    assert cli.main([*args, "--model", "unheard-of"], spark) == 1
    rows = spark.range(64).select(F.lit("m").alias("model_id"), F.lit("main").alias("revision"), F.concat(F.lit("p"), "id").alias("prompt"), F.lit("loglik").alias("kind"), F.lit(" x").alias("continuation"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("int").alias("max_new_tokens"), F.lit(None).cast("array<string>").alias("stop"), F.lit(0.0).alias("temperature"))
    scored = models.model_scorer(Letters)(rows)
    assert scored.select(F.spark_partition_id()).distinct().count() > 1  # one model, one revision, and yet several tasks


def test_model_scores_a_run(spark):
    rows = spark.createDataFrame([("a", ("see ab", "cd"))], "example_id string, payload struct<context: string, target: string>")
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests
    scored = models.model_scorer(Letters)(E.cloze_requests(rows, render.load_variant("lambada/cloze_v1"), "m", "main"))
    got = E.cloze_results(scored).first()
    assert got["detail"]["generation"] == "xyz" and got["correct"] is False and got["detail"]["target_nll"] > 0


def test_hub_needs_its_libraries():
    try:
        import transformers  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="torch"):
            models.hub_backend("none", "main")


def test_figures_need_matplotlib(spark):
    from gradloom.figures import draw_all

    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="matplotlib"):
            draw_all(spark.range(1), "/tmp/none")
