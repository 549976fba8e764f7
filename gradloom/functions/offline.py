"""The deterministic offline scorer as Column expressions.

A draw is a number below 10,000 taken from SHA-256 of seed, model, revision and the request's parts. Scores are
kept in ten-thousandths as integers as long as they are summed, so the order of summation is of no account.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X


def draw(key: Column) -> Column:
    """``key``'s draw, an integer from 0 to 9,999: the first 16 hex digits of its SHA-256 modulo 10,000.

    The modulus is taken of two halves of eight digits, each of which fits a bigint.
    """
    digest = F.sha2(key, 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return ((high % 10_000) * (2**32 % 10_000) + low % 10_000) % 10_000


def key(seed: int | Column, model_id: str | Column, revision: str | Column, *parts: Column) -> Column:
    """Parts joined by a bar."""
    head = [x if isinstance(x, Column) else F.lit(str(x)) for x in (seed, model_id, revision)]
    return F.concat_ws("|", *head, *parts)


def loglik(seed, model_id, revision, prompt: Column, continuation: Column) -> Column:
    """``loglik, n_tokens, is_greedy_match`` of a continuation."""
    n = F.greatest(F.size(X.words(continuation)), F.lit(1))
    u = draw(key(seed, model_id, revision, prompt, continuation))
    greedy = draw(key(seed, model_id, revision, prompt, continuation, F.lit("greedy_match"))) < 5_000
    return F.struct((-((10_000 + 4 * u) * n) / 10_000.0).alias("loglik"), n.alias("n_tokens"), greedy.alias("is_greedy_match"))


def generation(seed, model_id, revision, prompt: Column, stops: list[str] | None = None) -> Column:
    """The generated sentence, cut at the earliest stop."""
    number = F.floor(draw(key(seed, model_id, revision, prompt)) / 10).cast("int")
    return X.truncate_at(F.concat(F.lit("The answer is "), number.cast("string"), F.lit(".")), stops)


def token_nll_units(seed, model_id, revision, context: Column, scored: Column, token: Column, index: Column) -> Column:
    """A token's negative log-likelihood in ten-thousandths."""
    return 5_000 + 4 * draw(key(seed, model_id, revision, context, scored, token, index.cast("string")))
