"""Splitting oversized items at natural boundaries, by a hierarchy of separators (problem 7)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_LIMIT = 4000
OVERLAP = 200

#: Places to cut, strongest first: before a heading, after a blank line, after a line, after a sentence,
#: after a clause or list item, after a word. Each pattern matches up to the place of the cut.
BOUNDARIES = (
    re.compile(r"\n(?=[ \t]*(?:=+ |#+ ))"),
    re.compile(r"\n[ \t]*\n+"),
    re.compile(r"\n"),
    re.compile(r"[.!?。！？…][\"'”’»)\]]*(?:\s+|$)|[。！？]"),
    re.compile(r"[,;:}\]](?:\s+|(?=[\"{\[\d-]))"),
    re.compile(r"\s+"),
)


def cuts(text: str, start: int, end: int, limit: int, level: int = 0) -> Iterator[int]:
    """Ends of the atoms of ``text[start:end]``, each at most ``limit`` long: an atom too long is split at the next weaker boundary."""
    if end - start <= limit:
        yield end
        return
    if level == len(BOUNDARIES):
        yield from range(start + limit, end, limit)
        yield end
        return
    last = start
    for m in BOUNDARIES[level].finditer(text, start, end):
        if last < m.end() < end:
            yield from cuts(text, last, m.end(), limit, level + 1)
            last = m.end()
    yield from cuts(text, last, end, limit, level + 1)


def overlap_start(text: str, low: int, end: int, overlap: int) -> int:
    """Where the next piece begins so that it repeats about ``overlap`` characters before ``end``, at a word if there is one near."""
    begin = max(low + 1, end - overlap)
    if begin >= end:
        return end
    m = re.compile(r"\s+").search(text, begin, min(end, begin + overlap // 4))
    return m.end() if m and m.end() < end else begin


def split_text(text: str, limit: int = PIECE_LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of a text, in code points.

    Each piece is at most ``limit`` long; together they cover the text; each but the first begins about
    ``overlap`` before the end of the one before. A text within the limit is one piece, an empty one none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    atoms = list(cuts(text, 0, len(text), limit - overlap))
    pieces, begin, end = [], 0, 0
    for at in atoms:
        if at - begin > limit:
            pieces.append((begin, end))
            begin = overlap_start(text, begin, end, overlap)
        end = at
    pieces.append((begin, end))
    return pieces


def split_items(items: DataFrame, text: str, limit: int = PIECE_LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text longer than ``limit``: the other columns, ``piece_no, start, piece``.

    Shorter and null texts don't leave the JVM: the filter on the length runs before Python. Works row by row, without a shuffle.
    """
    keep = [c for c in items.columns if c != text]
    schema = items.select(*keep).schema.add("piece_no", T.IntegerType()).add("start", T.IntegerType()).add("piece", T.StringType())
    arrow = pa.schema([("piece_no", pa.int32()), ("start", pa.int32()), ("piece", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                own = row.column(len(keep))[0].as_py()
                parts = split_text(own, limit, overlap)
                # A text of many pieces leaves in batches of bounded size.
                for lo in range(0, len(parts), 256):
                    some = parts[lo : lo + 256]
                    cols = [pa.array(range(lo, lo + len(some)), pa.int32()), pa.array([a for a, _ in some], pa.int32()), pa.array([own[a:b] for a, b in some], pa.string())]
                    left = [row.column(i).take(pa.array([0] * len(some))) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(left + cols, schema=pa.schema([*[batch.schema.field(i) for i in range(len(keep))], *arrow]))

    return items.filter(F.length(text) > limit).select(*keep, text).mapInArrow(work, schema)


def oversized(wikitext: DataFrame, results: DataFrame) -> DataFrame:
    """Distinct items of both tables as ``source_table, run_id, example_id, text``; null texts fall out."""
    wiki = wikitext.select(
        F.lit("wikitext").alias("source_table"), F.lit("").alias("run_id"), "example_id", F.col("payload.text").alias("text")
    )
    rows = results.select(F.lit("example_results").alias("source_table"), "run_id", "example_id", F.col("detail_json").alias("text"))
    return wiki.unionByName(rows).filter(F.length("text") > PIECE_LIMIT).distinct()
