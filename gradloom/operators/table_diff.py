"""Differences between two copies of data, by content-defined chunks.

Both copies are cut, in key order, into chunks whose borders depend only on the content:
a row closes a chunk when the rolling hash of the last few rows meets a condition. A changed,
missing or extra row therefore moves only the borders near it. Chunks whose fingerprints occur
on the other side are equal and drop out by an anti-join; only the rows of the rest are compared,
field by field.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, partitions_for

#: Rows that the rolling hash spans, and the mean length of a chunk.
ROLL_ROWS = 4
CHUNK_ROWS = 32
TOLERANCE = 1e-6
_MASK = (1 << 64) - 1


def _canonical(value: object) -> object:
    """A value by which equal fingerprints imply equal values: numbers on a grid of 1e-6."""
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)):
        if not abs(value) < 1e15:  # beyond the grid's reach, and infinities and NaN
            return ("n", str(value) if isinstance(value, int) else repr(value))
        return ("n", math.floor(value * 1e6 + 0.5))
    if isinstance(value, list):
        return ("l", [_canonical(x) for x in value])
    if isinstance(value, dict):
        return ("o", sorted((k, _canonical(v)) for k, v in value.items() if v is not None))
    return value


def parse_detail(text: str | None) -> dict:
    """Top-level fields of a JSON object; text that does not parse is one field ``detail_json``."""
    if text is None:
        return {}
    try:
        got = json.loads(text)
    except (ValueError, RecursionError):
        return {"detail_json": text}
    return got if isinstance(got, dict) else {"detail_json": got}


def values_equal(a: object, b: object, tolerance: float = TOLERANCE) -> bool:
    """Equality after parsing: numbers within the tolerance, also inside lists; null differs from any value."""
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        if a == b or (a != a and b != b):
            return True
        return math.isfinite(a) and math.isfinite(b) and abs(a - b) <= tolerance * (1 + 1e-9)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(values_equal(x, y, tolerance) for x, y in zip(a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return all(values_equal(a.get(k), b.get(k), tolerance) for k in a.keys() | b.keys())
    return type(a) is type(b) and a == b


@F.pandas_udf(T.LongType())
def _row_print(correct: pd.Series, score: pd.Series, detail: pd.Series) -> pd.Series:
    out = []
    for c, s, d in zip(correct, score, detail):
        c = None if c is None or c != c else int(c)
        s = None if s is None else float(s)
        text = repr((c, _canonical(s), _canonical(parse_detail(d))))
        out.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63))
    return pd.Series(out, dtype="int64")


def row_fingerprint(correct: Column, score: Column, detail: Column) -> Column:
    """64-bit fingerprint of a row's values; NaN scores are told from null by a text form."""
    return _row_print(correct.cast("double"), score, detail)


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; ties fall to the greatest values, so reruns agree.

    An aggregate rather than a window: partial maxima shrink repeated rows before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in order + rest])


def content_chunks(rows: DataFrame, roll_rows: int = ROLL_ROWS, chunk_rows: int = CHUNK_ROWS, ranges: int | None = None) -> DataFrame:
    """Name each row's chunk. ``rows``: ``grp, key, side, fp``; adds ``chunk``.

    Rows of both sides are cut into ``ranges`` (usually as many as a shuffle has partitions) together by ``(grp, key)``, so a group that holds
    a third of all rows spreads over many tasks, and the borders of tasks fall on the same keys
    on both sides. Only a few rolling hashes are held at a time. A chunk is named by its first key,
    therefore one chunk never spans two tasks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list] = {}
        for batch in batches:
            grp, key, side, fp = (batch.column(i).to_pylist() for i in range(4))
            chunk = []
            for g, k, s, f in zip(grp, key, side, fp):
                own = state.get(s)
                if own is None or own[0] != g:
                    own = state[s] = [g, None, []]
                if own[1] is None:
                    own[1], own[2] = k, []
                chunk.append(own[1])
                own[2] = [*own[2][1 - roll_rows :], xxhash.xxh3_64_intdigest(k) ^ (f & _MASK)]
                rolled = 0
                for x in own[2]:
                    rolled = (rolled * 0x9E3779B97F4A7C15 + x) & _MASK
                if (rolled >> 40) % chunk_rows == 0:
                    own[1] = None
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(chunk, pa.string())], names=[*batch.schema.names, "chunk"]
            )

    typed = rows.select("grp", "key", F.col("side").cast("int").alias("side"), "fp")
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = typed.repartitionByRange(ranges, "grp", "key").sortWithinPartitions("grp", "key", "side")
    return ordered.mapInArrow(cut, "grp string, key string, side int, fp bigint, chunk string")


def differing_keys(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Keys of chunks without an equal chunk on the other side: ``grp, key``, distinct.

    The named rows, some bytes each, are written first: ranges are drawn from a sample, so chunks named in a second
    run of the stage could have other borders than those that were matched.
    """
    named = materialise(content_chunks(rows, ranges=ranges), "parity-chunks")
    chunks = named.groupBy("grp", "chunk", "side").agg(
        F.sum(F.xxhash64("key", "fp").cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64("fp", "key")).alias("mix"),
        F.count("*").alias("n"),
    )
    # A fingerprint seen on both sides is a matched chunk; the rest is anti-joined away from it.
    matched = chunks.groupBy("grp", "chunk", "total", "mix", "n").agg(F.count("*").alias("sides")).filter("sides = 2")
    return named.join(matched.select("grp", "chunk"), ["grp", "chunk"], "left_anti").select("grp", "key").distinct()


def field_differences(pairs: DataFrame) -> DataFrame:
    """Fields that differ. ``pairs``: ``grp, key, a, b``, structs of ``correct, score, detail_json`` or null.

    One row for each differing field; a row that one side lacks gives ``only_a`` or ``only_b`` and no more.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for g, k, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a is None or b is None:
                    if a is not None or b is not None:
                        out.append((g, k, "only_a" if b is None else "only_b"))
                    continue
                for name in ("correct", "score"):
                    if not values_equal(a[name], b[name]):
                        out.append((g, k, name))
                x, y = parse_detail(a["detail_json"]), parse_detail(b["detail_json"])
                out += [(g, k, f) for f in sorted(x.keys() | y.keys()) if not values_equal(x.get(f), y.get(f))]
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["grp", "key", "field"])

    return pairs.select("grp", "key", "a", "b").mapInArrow(compare, "grp string, key string, field string")


def current_runs(runs: DataFrame) -> DataFrame:
    """The current row of each run of an append-only log: the one recorded last."""
    return latest_rows(
        runs.select("run_id", "recorded_at", "framework", "status", "config_json").filter("run_id is not null"),
        ["run_id"],
        ["recorded_at"],
    )


def parity_pairs(runs: DataFrame) -> DataFrame:
    """``harness, base``: finished harness runs with the finished run that each repeats."""
    now = current_runs(runs).filter("status = 'done'")
    harness = now.filter("framework = 'lm_eval_harness'").select(
        F.col("run_id").alias("harness"), F.get_json_object("config_json", "$.parity_of").alias("base")
    )
    done = now.filter("framework = 'ladder'").select(F.col("run_id").alias("base"))
    return harness.filter("base is not null").join(done, "base", "left_semi")


def parity_differences(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Differences between each harness run and the run it repeats.

    Result: distinct ``harness, run_id`` (the run repeated), ``example_id, field``. Of several rows for
    one run and example the one recorded last holds, ties going to the greatest values. Rows
    without ``run_id`` or ``example_id`` are no example. Empty tables give no rows; further columns of the
    inputs are ignored.
    """
    pairs = materialise(parity_pairs(runs), "parity-pairs")
    sides = pairs.select(F.col("harness").alias("grp"), F.col("base").alias("run_id"), F.lit(0).alias("side")).unionByName(
        pairs.select(F.col("harness").alias("grp"), F.col("harness").alias("run_id"), F.lit(1).alias("side"))
    )
    plain = results.select("run_id", "example_id", "recorded_at", "correct", "score", "detail_json").filter(
        "run_id is not null and example_id is not null"
    )
    wanted = plain.join(sides.select("run_id").distinct(), "run_id", "left_semi")
    score = F.when(F.isnan("score"), F.lit(float("-1.5e300"))).otherwise(F.col("score"))
    prints = latest_rows(
        wanted.select("run_id", "example_id", "recorded_at", row_fingerprint(F.col("correct"), score, F.col("detail_json")).alias("fp")),
        ["run_id", "example_id"],
        ["recorded_at"],
    )
    rows = prints.join(sides, "run_id").select("grp", F.col("example_id").alias("key"), "side", "fp")
    open_keys = materialise(differing_keys(rows, partitions_for(results)), "parity-keys")
    # Only now, for the few keys left, are the values read.
    # A run may be repeated by several harness runs, so a key is open for the one pair only.
    wanted_of = sides.join(open_keys, "grp").select("run_id", F.col("key").alias("example_id"), "grp", "side")
    picked = wanted_of.select("run_id", "example_id").distinct()
    # Ties in time fall to the same row as above, the one with the greatest fingerprint.
    values = latest_rows(
        wanted.join(picked, ["run_id", "example_id"], "left_semi").withColumn("fp", row_fingerprint(F.col("correct"), score, F.col("detail_json"))),
        ["run_id", "example_id"],
        ["recorded_at", "fp"],
    )
    seen = values.join(wanted_of, ["run_id", "example_id"]).select(
        "grp", F.col("example_id").alias("key"), "side", F.struct("correct", "score", "detail_json").alias("v")
    )
    both = seen.groupBy("grp", "key").agg(
        F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b")
    )
    named = F.when(F.col("field") == "only_a", "only_ladder").when(F.col("field") == "only_b", "only_harness").otherwise(F.col("field"))
    return (
        field_differences(both)
        .join(pairs.withColumnRenamed("harness", "grp"), "grp")
        .select(F.col("grp").alias("harness"), F.col("base").alias("run_id"), F.col("key").alias("example_id"), named.alias("field"))
        .distinct()
    )
