"""Metrics of example results, as aggregate Columns to be used in one ``agg``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

LN2 = 0.6931471805599453


def share(flag: Column) -> Column:
    """Share of rows whose flag is true; null counts as false, and no rows give 0."""
    return F.coalesce(F.sum(F.when(flag, 1).otherwise(0)) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))


def acc(correct: Column) -> Column:
    """Accuracy: a missing verdict is a wrong one."""
    return share(correct)


def cloze(target_nll: Column, target_ppl: Column, word_match: Column) -> dict[str, Column]:
    """Means over examples; an infinite perplexity makes the mean infinite."""
    zero = F.lit(0.0)
    return {
        "target_nll_mean": F.coalesce(F.avg(target_nll), zero),
        "target_ppl_mean": F.coalesce(F.avg(target_ppl), zero),
        "nonstandard_generated_word_acc": share(word_match),
    }


def perplexity_of(nll: Column, tokens: Column) -> Column:
    """``exp(nll / tokens)``; infinite without tokens."""
    return F.when(tokens > 0, F.exp(nll / tokens)).otherwise(F.lit(float("inf")))


def bits_per_byte(nll: Column, n_bytes: Column) -> Column:
    """``nll / ln 2 / bytes``; 0 without bytes."""
    return F.when(n_bytes > 0, nll / LN2 / n_bytes).otherwise(F.lit(0.0))


def perplexity(window_nlls: Column, n_bytes: Column) -> dict[str, Column]:
    """Micro-averages: likelihoods, tokens and bytes are summed first."""
    nll, tokens = F.coalesce(F.sum(X.array_total(window_nlls)), F.lit(0.0)), F.coalesce(F.sum(F.size(window_nlls)), F.lit(0))
    size = F.coalesce(F.sum(n_bytes), F.lit(0))
    return {"ppl": perplexity_of(nll, tokens), "bpb": bits_per_byte(nll, size), "n_tokens": tokens.cast("double"), "n_bytes": size.cast("double")}


def for_evaluator(evaluator: str, results) -> dict[str, Column]:
    """The metrics of an evaluator, over results with its detail columns (:mod:`.evaluators`)."""
    c = F.col
    if evaluator == "perplexity":
        return perplexity(c("detail.window_nlls"), c("detail.n_bytes"))
    out = {"acc": acc(c("correct"))}
    if evaluator == "loglik_mc":
        out["acc_norm"] = share(c("detail.correct_norm"))
    if evaluator == "cloze":
        out |= cloze(c("detail.target_nll"), c("detail.target_ppl"), c("detail.nonstandard_generated_word_acc"))
    return out
