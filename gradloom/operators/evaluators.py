"""Evaluators: examples to requests, requests to scores, scores to example results.

Each evaluator has three parts. ``*_requests`` gives one row for each call of a model with a ``request_hash``;
a scorer fills in the answers; ``*_results`` puts an example's answers together again. The cache sits between, as a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import offline
from ..functions import text as X
from . import metrics
from .render import Variant, render
from .windows import window_count_sql, window_span

#: Budget of a cloze item's generation, in tokens for each word of its target.
CLOZE_TOKENS_PER_WORD = 4
CLOZE_STOP = ["\n"]
DEFAULT_MAX_NEW_TOKENS = 32


def request_hash(model_id: Column, revision: Column, kind: Column, prompt: Column, continuations: Column, gen_params: Column) -> Column:
    """Content hash of a call: SHA-256 of its canonical JSON, keys in alphabetical order, null fields kept."""
    call = F.struct(
        continuations.alias("continuations"), gen_params.alias("gen_params"), kind.alias("kind"), model_id.alias("model_id"), prompt.alias("prompt"), revision.alias("revision")
    )
    return F.sha2(F.to_json(call, {"ignoreNullFields": "false"}), 256)


def _with_hash(rows: DataFrame, model_id: str, revision: str, kind: str, prompt: Column, continuations: Column, params: Column) -> DataFrame:
    return rows.withColumns({"model_id": F.lit(model_id), "revision": F.lit(revision), "kind": F.lit(kind)}).withColumn(
        "request_hash", request_hash(F.col("model_id"), F.col("revision"), F.col("kind"), prompt, continuations, params)
    )


_PARAMS = "struct<context:string,max_new_tokens:int,stop:array<string>,temperature:double>"


def _params(context: Column | None = None, max_new_tokens: Column | None = None, stop: Column | None = None, temperature: float = 0.0) -> Column:
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        (null("string") if context is None else context).alias("context"),
        (null("int") if max_new_tokens is None else max_new_tokens.cast("int")).alias("max_new_tokens"),
        (null("array<string>") if stop is None else stop).alias("stop"),
        (null("double") if max_new_tokens is None else F.lit(temperature)).alias("temperature"),
    ).cast(_PARAMS)


# Scorers: a function of requests that adds the answer's columns.

Scorer = Callable[[DataFrame], DataFrame]
_SCORERS: dict[str, Callable[..., Scorer]] = {}


def register_scorer(name: str) -> Callable:
    """Decorator that makes a scorer's factory known by a model's name."""

    def add(factory: Callable[..., Scorer]) -> Callable[..., Scorer]:
        _SCORERS[name] = factory
        return factory

    return add


def get_scorer(name: str, **options: object) -> Scorer:
    """A model's scorer; an unknown name raises KeyError and lists the known ones."""
    if name not in _SCORERS:
        raise KeyError(f"unknown model {name!r}; known: {', '.join(sorted(_SCORERS))}")
    return _SCORERS[name](**options)


@register_scorer("offline")
def offline_scorer(seed: int = 0) -> Scorer:
    """The deterministic scorer; all of it runs inside the JVM.

    Adds ``answer``: ``loglik, n_tokens, is_greedy_match, token_nlls, n_bytes, generation``.
    """

    def score(requests: DataFrame) -> DataFrame:
        model, revision = F.col("model_id"), F.col("revision")
        args = (F.lit(str(seed)), model, revision)
        one = offline.loglik(*args, F.col("prompt"), F.col("continuation"))
        token = F.transform(
            X.words(F.col("prompt")), lambda w, i: offline.token_nll_units(*args, F.coalesce(F.col("context"), F.lit("")), F.col("prompt"), w, i).cast("bigint") / 10_000.0
        )
        text = F.concat(F.lit("The answer is "), F.floor(offline.draw(offline.key(*args, F.col("prompt"))) / 10).cast("int").cast("string"), F.lit("."))
        text = F.aggregate(F.coalesce("stop", F.array().cast("array<string>")), text, lambda t, s: F.call_function("substring_index", t, s, F.lit(1)))
        is_kind = lambda k: F.col("kind") == k
        return requests.withColumn(
            "answer",
            F.struct(
                F.when(is_kind("loglik"), one["loglik"]).alias("loglik"),
                F.when(is_kind("loglik"), one["n_tokens"]).alias("n_tokens"),
                F.when(is_kind("loglik"), one["is_greedy_match"]).alias("is_greedy_match"),
                F.when(is_kind("nll"), token).alias("token_nlls"),
                F.when(is_kind("nll"), F.octet_length("prompt").cast("bigint")).alias("n_bytes"),
                F.when(is_kind("generate"), text).alias("generation"),
            ),
        )

    return score


#: ``token_nlls`` are nats.
ANSWER = "struct<loglik:double,n_tokens:int,is_greedy_match:boolean,token_nlls:array<double>,n_bytes:bigint,generation:string>"


def batch_scorer(load: Callable[[], tuple[Callable[[pd.DataFrame], pd.DataFrame], Callable[[], None]]]) -> Scorer:
    """A scorer backed by a model: ``load`` runs once in each task and gives a function of Arrow batches, and one that frees the model.

    The function gets ``kind, prompt, continuation, context, max_new_tokens, stop, temperature`` and returns the answer's fields in the same order.
    Requests are spread by their prompts over a fixed number of tasks, since few bytes may be much work; those of one prompt meet in a batch. A
    run asks one model, so a worker loads one.
    """

    def score(requests: DataFrame) -> DataFrame:
        fields = ["kind", "prompt", "continuation", "context", "max_new_tokens", "stop", "temperature"]

        def work(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            model, unload = load()
            try:
                for columns in batches:
                    yield model(pd.DataFrame(dict(zip(fields, columns))))
            finally:
                unload()

        udf = F.pandas_udf(work, ANSWER)
        spark = requests.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spread_out = requests.repartition(tasks, "model_id", "revision", "prompt").sortWithinPartitions("kind", "prompt")
        return spread_out.withColumn("answer", udf(*fields))

    return score


# Multiple choice.


def _request_columns(rows: DataFrame, continuation: Column, context: Column, max_new: Column, stop: Column, temperature: float = 0.0) -> DataFrame:
    return rows.withColumns({"continuation": continuation, "context": context, "max_new_tokens": max_new.cast("int"), "stop": stop, "temperature": F.lit(temperature)})




def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def mc_requests(examples: DataFrame, variant: Variant, model_id: str, revision: str, demos: list[dict] | None = None) -> DataFrame:
    """One row for each option of each example; options are asked for and cached one by one."""
    rendered = render(examples, variant, demos)
    options = rendered.select("example_id", F.col("payload.answer_index").alias("answer_index"), "prompt", F.posexplode("continuations").alias("option", "continuation"))
    rows = _request_columns(options, F.col("continuation"), _null("string"), _null("int"), _null("array<string>"))
    return _with_hash(rows, model_id, revision, "loglik", F.col("prompt"), F.array("continuation"), _null(_PARAMS))


def mc_results(scored: DataFrame) -> DataFrame:
    """``example_id, correct, score, detail`` of scored options: the best log-likelihood wins, the first one on ties; so by bytes for ``correct_norm``."""
    entry = F.struct("option", F.col("answer.loglik").alias("loglik"), (F.col("answer.loglik") / F.octet_length("continuation")).alias("norm"))
    by = scored.groupBy("example_id", "answer_index").agg(F.array_sort(F.collect_list(entry)).alias("o"))
    logliks, norms = F.col("o.loglik"), F.col("o.norm")
    chosen, chosen_norm = X.argmax_first(logliks), X.argmax_first(norms)
    correct = chosen == F.col("answer_index")
    detail = F.struct(
        "answer_index", chosen.alias("chosen_index"), chosen_norm.alias("chosen_index_norm"), (chosen_norm == F.col("answer_index")).alias("correct_norm"),
        logliks.alias("logliks"), norms.alias("logliks_norm"),
    )
    return by.select("example_id", correct.alias("correct"), correct.cast("double").alias("score"), detail.alias("detail"))


# Perplexity.


def window_requests(texts: DataFrame, key: str, text: str, model_id: str, revision: str, window: int, stride: int, carry: tuple[str, ...] = (), empty: bool = False) -> DataFrame:
    """One row for each window of each text: the newly scored words as ``prompt``, the words before as ``context``.

    Only the words of a window travel with it, not the whole text, and the columns to ``carry``. With ``empty`` a text without words has a request too, without
    words to score, so that sums over requests hold every text.
    """
    base = texts.select(F.col(key).alias("example_id"), *carry, F.octet_length(text).cast("bigint").alias("raw_bytes"), X.words(F.col(text)).alias("w"))
    sized = base.withColumn("n", F.size("w"))  # a text without words has one window that scores nothing and falls out below

    def cut(k: Column) -> Column:
        start, context, scored = window_span(k, F.col("n"), window, stride)
        part = lambda a, n: F.array_join(F.slice("w", a, F.greatest(n, F.lit(0))), " ")
        return F.struct(k.alias("k"), part(start + context + 1, scored).alias("prompt"), part(start + 1, context).alias("context"), (scored > 0).alias("any"))

    # The windows are cut while the words are one array: exploding first would copy all words for each window.
    cuts = F.transform(F.expr(f"sequence(0, {window_count_sql('n', window, stride)} - 1)"), cut)
    exploded = sized.select("example_id", *carry, "raw_bytes", F.explode(cuts).alias("c")).filter("c.any or c.k = 0" if empty else "c.any")
    rows = exploded.select("example_id", *carry, "raw_bytes", "c.k", "c.prompt", "c.context")
    rows = _request_columns(rows, _null("string"), F.col("context"), _null("int"), _null("array<string>"))
    return _with_hash(rows, model_id, revision, "nll", F.col("prompt"), _null("array<string>"), _params(context=F.col("context")))


def offline_totals(requests: DataFrame, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """``example_id, raw_bytes, units, tokens`` of the offline scorer, likelihood in ten-thousandths, without keeping tokens: one row a token, so hashing stays in generated code. Requests without words add nothing."""
    prefix = offline.key(F.lit(str(seed)), F.col("model_id"), F.col("revision"), F.col("context"), F.col("prompt"))
    tokens = requests.select("example_id", *carry, "raw_bytes", prefix.alias("p"), F.posexplode_outer(X.words(F.col("prompt"))).alias("i", "tok"))
    units = (5_000 + 4 * offline.draw(F.concat_ws("|", "p", "tok", F.col("i").cast("string")))).cast("bigint")
    scored = F.when(F.col("tok").isNotNull(), units).otherwise(F.lit(0).cast("bigint"))
    return tokens.groupBy("example_id", *carry, "raw_bytes").agg(F.sum(scored).alias("units"), F.count("tok").cast("bigint").alias("tokens"))


def perplexity_results(scored: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """``example_id, correct, score, detail`` of scored windows: ``correct`` is null, the score bits per byte; a text without words scores 0."""
    entry = F.struct("k", F.col("answer.token_nlls").alias("nlls"))
    by = scored.groupBy("example_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    nlls = F.coalesce(F.flatten("e.nlls"), F.array().cast("array<double>"))
    whole = texts.select(F.col(key).alias("example_id"), F.octet_length(text).cast("bigint").alias("raw_bytes")).join(by, "example_id", "left")
    bpb = metrics.bits_per_byte(X.array_total(nlls), F.col("raw_bytes"))
    return whole.select("example_id", _null("boolean").alias("correct"), bpb.alias("score"), F.struct(nlls.alias("window_nlls"), F.col("raw_bytes").alias("n_bytes")).alias("detail"))


# Cloze.


def cloze_requests(examples: DataFrame, variant: Variant, model_id: str, revision: str) -> DataFrame:
    """Two rows for each item: the target's log-likelihood, and a generation for the diagnostic match."""
    rendered = render(examples, variant).select("example_id", "prompt", F.col("payload.target").alias("target"))
    budget = F.greatest(F.size(X.words(F.col("target"))), F.lit(1)) * CLOZE_TOKENS_PER_WORD
    stop = F.array(*map(F.lit, CLOZE_STOP))
    target = F.concat(F.lit(" "), "target")
    likely = _request_columns(rendered, target, _null("string"), _null("int"), _null("array<string>"))
    likely = _with_hash(likely, model_id, revision, "loglik", F.col("prompt"), F.array("continuation"), _null(_PARAMS))
    spoken = _request_columns(rendered, _null("string"), _null("string"), budget, stop)
    spoken = _with_hash(spoken, model_id, revision, "generate", F.col("prompt"), _null("array<string>"), _params(max_new_tokens=budget, stop=stop))
    return likely.unionByName(spoken)


def cloze_results(scored: DataFrame) -> DataFrame:
    """``example_id, correct, score, detail``: correct if the target is what greedy decoding gives.

    A target without tokens has infinite perplexity. The count of tokens is cached with the answer, so a warm run equals a cold one.
    """
    pick = lambda kind, field: F.max(F.when(F.col("kind") == kind, F.col(f"answer.{field}")))
    by = scored.groupBy("example_id", "target").agg(
        pick("loglik", "loglik").alias("ll"), pick("loglik", "n_tokens").alias("n"), pick("loglik", "is_greedy_match").alias("greedy"), pick("generate", "generation").alias("generation")
    )
    ppl = F.when(F.col("n") > 0, F.exp(-F.col("ll") / F.col("n"))).otherwise(F.lit(float("inf")))
    match = X.strip_punctuation(X.first_word(F.col("generation"))) == X.strip_punctuation(X.strip(F.col("target")))
    detail = F.struct("target", "generation", F.col("ll").alias("target_logprob"), (-F.col("ll")).alias("target_nll"), ppl.alias("target_ppl"), match.alias("nonstandard_generated_word_acc"))
    return by.select("example_id", F.col("greedy").alias("correct"), F.col("greedy").cast("double").alias("score"), detail.alias("detail"))


# Generative.


def generative_requests(examples: DataFrame, variant: Variant, model_id: str, revision: str) -> DataFrame:
    """One generation for each example."""
    rendered = render(examples, variant).select("example_id", "prompt", F.col("payload.answer_number").alias("answer_number"))
    stop = F.array(*map(F.lit, variant.stop)).cast("array<string>")
    budget = F.lit(variant.max_new_tokens or DEFAULT_MAX_NEW_TOKENS)
    rows = _request_columns(rendered, _null("string"), _null("string"), budget, stop, variant.temperature)
    params = _params(max_new_tokens=budget, stop=stop, temperature=variant.temperature)
    return _with_hash(rows, model_id, revision, "generate", F.col("prompt"), _null("array<string>"), params)


def generative_results(scored: DataFrame) -> DataFrame:
    """``example_id, correct, score, detail``: correct if the extracted number equals the gold one exactly; none extracted is wrong."""
    number = X.extract_number(F.col("answer.generation"))
    correct = F.coalesce(number == F.col("answer_number"), F.lit(False))
    detail = F.struct("answer_number", F.col("answer.generation").alias("generation"), number.alias("extracted_number"))
    return scored.select("example_id", correct.alias("correct"), correct.cast("double").alias("score"), detail.alias("detail"))


def requests_of(examples: DataFrame, evaluator: str, variant: Variant | None, model_id: str, revision: str, demos: list[dict] | None = None, window: int = 1024) -> DataFrame:
    """All requests that a run makes, so the cache's keys can be told without running it."""
    if evaluator == "loglik_mc":
        return mc_requests(examples, variant, model_id, revision, demos)
    if evaluator == "cloze":
        return cloze_requests(examples, variant, model_id, revision)
    if evaluator == "generative":
        return generative_requests(examples, variant, model_id, revision)
    texts = examples.select("example_id", F.col("payload.text").alias("text"))
    return window_requests(texts, "example_id", "text", model_id, revision, window, window // 2)


EVALUATORS = ("loglik_mc", "perplexity", "cloze", "generative")


def evaluate(
    examples: DataFrame,
    evaluator: str,
    variant: Variant | None,
    scorer: Callable[[DataFrame], DataFrame],
    model_id: str,
    revision: str,
    demos: list[dict] | None = None,
    window: int = 1024,
    stride: int | None = None,
) -> DataFrame:
    """``example_id, correct, score, detail`` of one run. ``scorer`` adds ``answer`` to requests; :class:`..operators.store.PredictionCache` makes one that caches."""
    if evaluator == "loglik_mc":
        return mc_results(scorer(mc_requests(examples, variant, model_id, revision, demos)))
    if evaluator == "cloze":
        return cloze_results(scorer(cloze_requests(examples, variant, model_id, revision)))
    if evaluator == "generative":
        return generative_results(scorer(generative_requests(examples, variant, model_id, revision)))
    if evaluator == "perplexity":
        texts = examples.select("example_id", F.col("payload.text").alias("text"))
        requests = window_requests(texts, "example_id", "text", model_id, revision, window, stride or window // 2)
        return perplexity_results(scorer(requests), texts, "example_id", "text")
    raise KeyError(f"unknown evaluator {evaluator!r}; known: {', '.join(EVALUATORS)}")
