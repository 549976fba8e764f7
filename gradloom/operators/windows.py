"""Sliding text windows in closed form: every window is known from the text's length alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 1024


def window_span(k: Column, n: Column, window: int, stride: int) -> tuple[Column, Column, Column]:
    """Start, context words and scored words of window ``k`` in a text of ``n`` words; nothing is scored where a window adds nothing."""
    start = k * stride
    end = F.least(start + window, n)
    done = F.when(k == 0, 0).otherwise(F.least((k - 1) * stride + window, n))
    context = F.greatest(done - start, F.lit(0))
    return start, context, F.when(start < n, end - start - context).otherwise(0)


def window_spans(words: DataFrame, n: str, window: int = WINDOW, stride: int | None = None) -> DataFrame:
    """One row for each window: adds ``k, start, context_words, scored_words``.

    Window ``k`` starts at ``k * stride``; its first ``context_words`` words were scored by the one before and only condition
    the rest. Windows that score nothing are left out. With a stride up to the window each word is scored once; beyond it the words in the gaps
    never are.
    """
    stride = window // 2 if stride is None else stride
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be at least 1")
    exploded = words.withColumn("k", F.explode(F.expr(f"sequence(0, {window_count_sql(n, window, stride)} - 1)")))
    start, context, scored = window_span(F.col("k"), F.col(n), window, stride)
    return exploded.withColumns({"start": start, "context_words": context, "scored_words": scored}).filter("scored_words > 0")


def window_count_sql(n: str, window: int, stride: int) -> str:
    """How many windows a text of ``n`` words has, as SQL text: at least 1, so that a sequence over it ascends; a text without words falls out by its start."""
    return f"greatest(1, CASE WHEN `{n}` <= {window} THEN 1 ELSE 1 + CAST(ceil((`{n}` - {window}) / {float(stride)}D) AS INT) END)"
