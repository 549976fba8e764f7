"""Repetition inside a single document (problem 1)."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

#: Words in a row that count as repeated, the share from which a document fails, and the
#: longest string and fewest copies of a chain.
REPEAT_WORDS = 4
REPEAT_SHARE = 0.35
CHAIN_UNIT = 16
CHAIN_COPIES = 5
#: Characters of texts that are looked through for chains at once.
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"\S+")
_STRIP = re.compile(r"[\W\d_]+")
_CHAIN = re.compile(r"(\S.{0,%d}?)\1{%d,}" % (CHAIN_UNIT - 1, CHAIN_COPIES - 1), re.S)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[^\w\s]+|_+")
_NUMBER = re.compile(r"(?<!\S)\d+(?!\S)")
_DIGITS = re.compile(r"\d+")
#: Stands for a number, of which only that it is one counts.
_ANY = "#"


def with_chains(texts: list[str]) -> np.ndarray:
    """Which texts may hold a chain: some stretch of four units equals the text one unit further on. All texts are one array, so no text costs a call of its own."""
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in texts])
    out = np.zeros(len(texts), bool)
    for size in range(1, CHAIN_UNIT + 1):
        run = (CHAIN_COPIES - 1) * size
        if len(codes) < run + size:
            break
        differ = np.zeros(len(codes) - size + 1, np.int32)
        np.cumsum(codes[size:] != codes[:-size], out=differ[1:])
        out[np.searchsorted(ends, np.flatnonzero(differ[run:] == differ[:-run]), "right")] = True
    return out


def repeated_share(text: str | None, chains: bool | None = None) -> float | None:
    """Share of a text's characters, white space aside, in repeated matter.

    Repeated are words of a stretch of four or more that already occurred earlier in the text, and
    chains of one short string written at least five times without a break. Words are compared
    without letter case, punctuation and digits; a number equals any number. Null gives null, a text without
    characters 0. ``chains``: whether the text may hold a chain, if that is known.
    """
    if text is None:
        return None
    # Most texts hold no repeat, which is told without a look at single words.
    plain = _DIGITS.sub("", _NUMBER.sub(_ANY, _PUNCTUATION.sub("", text.lower()))).split()
    chains = _CHAIN.search(text) is not None if chains is None else chains
    if not chains and len(grams := list(zip(plain, plain[1:], plain[2:], plain[3:]))) == len(set(grams)):
        return 0.0
    spans, words = [], []
    for m in _WORD.finditer(text):
        word = _STRIP.sub("", m.group().lower())
        if word or any(c.isdigit() for c in m.group()):
            spans.append(m.span())
            words.append(word)
    total = len(_SPACE.sub("", text))
    if not total:
        return 0.0
    marked: list[tuple[int, int]] = []
    seen: set[tuple] = set()
    for i in range(len(words) - REPEAT_WORDS + 1):
        gram = tuple(words[i : i + REPEAT_WORDS])
        if gram in seen:
            marked.append((spans[i][0], spans[i + REPEAT_WORDS - 1][1]))
        else:
            seen.add(gram)
    if chains:
        marked += [m.span() for m in _CHAIN.finditer(text)]
    marked.sort()
    inside, end = 0, 0
    for a, b in marked:
        a = max(a, end)
        if b > a:
            inside += len(_SPACE.sub("", text[a:b]))
            end = b
    return inside / total


@F.pandas_udf(T.DoubleType())
def repeated_share_udf(texts: pd.Series) -> pd.Series:
    out: list[float | None] = []
    block: list[str | None] = []
    size = 0

    def measure() -> None:
        chains = with_chains([t or "" for t in block])
        out.extend(repeated_share(t, bool(c)) for t, c in zip(block, chains))

    for t in texts:
        block.append(t)
        size += len(t or "")
        if size > BLOCK_CHARS:
            measure()
            block, size = [], 0
    if block:
        measure()
    return pd.Series(out, dtype="float64")


def repeated_parts(text: Column, between: str) -> Column:
    """Share of a text's letters that stand in parts, parted by the pattern ``between``, that the text has said before. Null gives null, a text without letters 0.

    Parts are compared by their letters and the spaces between, without letter case.
    """
    parts = F.filter(F.transform(F.split(F.lower(text), between), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}]+", " "))), lambda x: x != "")
    letters = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    total = letters(parts)
    return F.when(text.isNotNull(), F.when(total > 0, 1 - letters(F.array_distinct(parts)) / total).otherwise(0.0))


#: What parts sentences and paragraphs.
SENTENCE_ENDS, PARAGRAPH_ENDS = r"[.!?\n]+", r"\n+"
#: The document rules by name: each is a column of :func:`measured` that tells whether the document fails.
RULES = {"words": "fails", "sentences": "fails_sentences", "paragraphs": "fails_paragraphs"}


def measured(docs: DataFrame, text: str, rules: Iterable[str] = RULES) -> DataFrame:
    """Adds for each rule the document's share, ``repeated...``, and whether it reaches the limit, ``fails...``. Null texts give nulls."""
    share = {
        "words": lambda: repeated_share_udf(F.col(text)),
        "sentences": lambda: repeated_parts(F.col(text), SENTENCE_ENDS),
        "paragraphs": lambda: repeated_parts(F.col(text), PARAGRAPH_ENDS),
    }
    shares = docs.withColumns({RULES[r].replace("fails", "repeated"): share[r]() for r in rules})
    return shares.withColumns({RULES[r]: F.col(RULES[r].replace("fails", "repeated")) >= REPEAT_SHARE for r in rules})


def measured_once(docs: DataFrame, doc_id: str, text: str, host: str, rules: Iterable[str] = RULES) -> DataFrame:
    """``doc_id, host`` and the columns of :func:`measured`, one row for each document, host and text.

    Measured where the texts lie; only digests and shares are shuffled to drop repeated rows. Written once, since shares are used for hosts and for documents.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("_text")).withColumn("_digest", F.unhex(F.md5("_text")))
    return materialise(measured(own, "_text", rules).drop("_text").dropDuplicates(["doc_id", "host", "_digest"]).drop("_digest"), "repetition-shares")


def host_verdicts(docs: DataFrame, host: str, rule: str = "words") -> DataFrame:
    """Rates of failing a document rule by host, shrunk: ``host, n_docs, n_failed, rate, bad_host``.

    The prior is a beta distribution fitted by moments to the hosts' raw rates, so a host of few
    documents is judged mostly by what is usual. A host is bad if its shrunk rate is over twice the overall
    rate. Rows aggregate partially before the shuffle; a null host is a host. Documents without text don't count.
    """
    fails = F.col(RULES[rule])
    by = docs.filter(fails.isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(fails.cast("long")).alias("n_failed"))
    raw = by.withColumn("p", F.col("n_failed") / F.col("n_docs"))
    prior = raw.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.coalesce(F.sum(F.col("n_docs") * F.pow(F.col("p") - F.lit(0), 2)) / F.sum("n_docs"), F.lit(0.0)).alias("square"),
        (F.count("*") / F.sum(1 / F.col("n_docs"))).alias("typical_n"),
    )
    # Variance between hosts is what is left of the variance of rates beyond binomial noise.
    spread = F.greatest(
        F.col("square") - F.pow("mean", F.lit(2)) - F.col("mean") * (1 - F.col("mean")) / F.col("typical_n"), F.lit(1e-6)
    )
    weight = F.greatest(F.col("mean") * (1 - F.col("mean")) / spread - 1, F.lit(1.0))
    fitted = prior.select("mean", weight.alias("weight"))
    rate = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    # fitted is a single row, so the join has one row on that side whatever the data's size.
    return raw.join(F.broadcast(fitted), F.lit(True)).select(
        "host", "n_docs", "n_failed", F.round(rate, 6).alias("rate"), (F.round(rate, 6) > F.round(2 * F.col("mean"), 6)).alias("bad_host")
    )


def repetition(docs: DataFrame, doc_id: str, text: str, host: str, rules: Iterable[str] = RULES) -> DataFrame:
    """Documents with their host's verdict joined back: ``doc_id, host``, the columns of :func:`measured`, ``n_failed, host_rate, bad_host``.

    Repeated rows of one document (same id and text) count once; null texts have no verdict of their own. Hosts are few against documents, so
    the verdicts are the small side; adaptive execution splits a hot host on the other.
    """
    shares = measured_once(docs, doc_id, text, host, rules)
    verdicts = host_verdicts(shares, "host").select(F.col("host").alias("_h"), "n_failed", F.col("rate").alias("host_rate"), "bad_host")
    return shares.join(verdicts, F.col("host").eqNullSafe(F.col("_h")), "left").drop("_h")


def failing(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """``doc_id``, distinct: failing documents, through the verdicts of their hosts.

    Hosts with a failure are joined to their documents; every failing document is of such a host, so none is lost.
    """
    return repetition(docs, doc_id, text, host, ["words"]).filter("n_failed > 0 and fails").select("doc_id").distinct()
