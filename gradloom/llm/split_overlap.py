"""Same or nearly the same records across splits, by a partitioned suffix array (problem 4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, partitions_for

#: One word in so many may differ between two records.
EDIT_SHARE = 5
#: Words of a span that counts as shared, and for records of at most ``SHORT`` words, where one edit may leave no longer span.
SPAN, SHORT_SPAN, SHORT = 3, 2, 5
#: Words by which suffixes are ordered and compared. A longer common prefix is found all the same: the suffix at the next word
#: has it too, less one word, and coverage is the union over all suffixes.
ORDER_WORDS = 24


def words_of(text: Column) -> Column:
    """Words without letter case; white space and punctuation only separate them."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def edit_distance_within(a: list[str], b: list[str], most: int) -> bool:
    """Whether the words differ by at most ``most`` insertions, removals or changes; time in the band only."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    before = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                now[j] = i
                continue
            best = before.get(j - 1, far) + (x != b[j - 1])
            best = min(best, before.get(j, far) + 1, now.get(j - 1, far) + 1)
            now[j] = best
        if min(now.values()) > most:
            return False
        before = now
    return before.get(len(b), far) <= most


def edits(n: Column | int) -> Column | int:
    """Edits allowed where the longer record has ``n`` words."""
    return F.floor(n / EDIT_SHARE).cast("int") if isinstance(n, Column) else n // EDIT_SHARE


def shared_words(a: list[str], b: list[str]) -> int:
    """Words at the beginning that two suffixes have in common."""
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


#: What a range of the array says of itself: its first and last suffix, the least prefix between neighbours, and the prefixes that its last
#: (``after``) and first (``before``) suffix share with the nearest train and evaluation suffix inside, null if there is none.
_RANGE = "first struct<grp:string,suffix:string>, last struct<grp:string,suffix:string>, least int, train_after int, eval_after int, train_before int, eval_before int"
_ARRAY = f"part int, text_id string, pos int, common int, open array<int>, range struct<{_RANGE.replace(' struct', ':struct').replace(' int', ':int')}>"


def scan_range(part: int, rows: pa.Table) -> pa.Table:
    """The rows of one range, sorted, as :data:`_ARRAY`: for each suffix the words ``common`` with the nearest suffix of the other split inside the range, and ``open``,
    the words it shares with the border before and after which the nearest train or evaluation suffix lies (in this order twice), -1 where one lies inside or isn't asked for.
    Another row describes the range.

    The prefix shared with a suffix further on is the least of the prefixes between neighbours on the way, so a pass forward and one backward carry two numbers.
    """
    grp, text, train, evals = (rows.column(c).to_pylist() for c in ("grp", "suffix", "in_train", "in_eval"))
    n, suffix = len(grp), [s.split(" ") for s in text]
    link = [shared_words(suffix[i], suffix[i + 1]) if grp[i] == grp[i + 1] else 0 for i in range(n - 1)]
    common, opened = [0] * n, [[-1] * n for _ in range(4)]
    ends = []
    for backward in (False, True):
        last, seen = [ORDER_WORDS, ORDER_WORDS], [False, False]  # words shared with the last train and evaluation suffix, or with the border
        for i in range(n - 1, -1, -1) if backward else range(n):
            if 0 <= (k := i if backward else i - 1) < n - 1:
                last = [min(last[0], link[k]), min(last[1], link[k])]
            for split, asked in enumerate((evals[i], train[i])):
                if asked and seen[split]:
                    common[i] = max(common[i], last[split])
                elif asked:
                    opened[2 * backward + split][i] = last[split]
            for split, own in enumerate((train[i], evals[i])):
                if own:
                    last[split], seen[split] = ORDER_WORDS, True
        ends.append([x if s else None for x, s in zip(last, seen)])
    words = np.array([len(s) for s in suffix])
    most = np.minimum(np.maximum.reduce([np.array(common), *map(np.array, opened)]), words)
    keep = np.flatnonzero(most >= SHORT_SPAN)
    kept = rows.take(pa.array(keep))
    span = [{"grp": grp[i], "suffix": text[i]} for i in (0, n - 1)]
    about = {"first": span[0], "last": span[1], "least": min(link, default=ORDER_WORDS)}
    about |= dict(zip(("train_after", "eval_after", "train_before", "eval_before"), ends[0] + ends[1]))
    limit = lambda xs: [min(xs[i], int(words[i])) for i in keep]
    opens = list(map(list, zip(*(limit(o) for o in opened))))
    return pa.table(
        {
            "part": pa.array([part] * (len(keep) + 1), pa.int32()), "text_id": [*kept.column("text_id").to_pylist(), None], "pos": pa.array([*kept.column("pos").to_pylist(), None], pa.int32()),
            "common": pa.array([*limit(common), None], pa.int32()), "open": pa.array([*opens, None], pa.list_(pa.int32())), "range": pa.array([None] * len(keep) + [about], _ABOUT),
        }
    )


_SPAN_TYPE = pa.struct([("grp", pa.string()), ("suffix", pa.string())])
_ABOUT = pa.struct([("first", _SPAN_TYPE), ("last", _SPAN_TYPE), *((c, pa.int32()) for c in ("least", "train_after", "eval_after", "train_before", "eval_before"))])


def carried(ranges: list[tuple[int, dict]]) -> list[tuple[int, list[int]]]:
    """For each range, in order, the words that its border before shares with the nearest train and evaluation suffix before it, and so after it."""
    out = {part: [0, 0, 0, 0] for part, _ in ranges}
    for at, (suffixes, facing, order) in enumerate(((("train_after", "eval_after"), ("last", "first"), ranges), (("train_before", "eval_before"), ("first", "last"), ranges[::-1]))):
        before, state = None, [0, 0]
        for part, r in order:
            if before is not None:
                x, y = before[facing[0]], r[facing[1]]
                near = shared_words(x["suffix"].split(" "), y["suffix"].split(" ")) if x["grp"] == y["grp"] else 0
                state = [min(s, near) for s in state]
            out[part][2 * at : 2 * at + 2] = state
            state = [min(s, r["least"]) if r[c] is None else r[c] for s, c in zip(state, suffixes)]
            before = r
    return sorted(out.items())


def cross_prefixes(suffixes: DataFrame) -> DataFrame:
    """``text_id, pos, common``: the longest prefix, in words, that a suffix shares with a suffix of the other split.

    ``suffixes``: ``grp, suffix`` (words joined by spaces), ``text_id, pos, in_train, in_eval``. The array is cut into ranges that are sorted each. In sorted order the longest
    prefix is shared with the nearest suffix of the other split before or after (:func:`scan_range`). Ties are parted by text, so no suffix, however
    frequent, makes a range of its own. Ranges are joined at their borders (:func:`carried`): a row about each range goes to the driver, whatever
    the number of texts. A text of both splits may meet itself, which can only keep more. Suffixes sharing less than ``SHORT_SPAN`` fall out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(got) if (got := list(batches)) else None
        if rows is not None and rows.num_rows:
            yield from scan_range(TaskContext.get().partitionId(), rows).combine_chunks().to_batches()

    columns = ["grp", "suffix", "text_id", "pos", "in_train", "in_eval"]
    ordered = suffixes.select(columns).repartitionByRange(partitions_for(suffixes, 32), "grp", "suffix", "text_id").sortWithinPartitions("grp", "suffix", "text_id")
    array = materialise(ordered.mapInArrow(scan, _ARRAY), "overlap-array")
    ranges = sorted((r["part"], r["range"].asDict(recursive=True)) for r in array.filter("range is not null").select("part", "range").collect())
    borders = suffixes.sparkSession.createDataFrame(carried(ranges), "part int, carry array<int>")
    best = F.array_max(F.concat(F.array("common"), F.zip_with("open", "carry", lambda a, b: F.least(a, b))))
    rows = array.filter("range is null").join(F.broadcast(borders), "part")  # a row for each range
    return rows.select("text_id", "pos", best.alias("common")).filter(F.col("common") >= SHORT_SPAN)


def least_over_partners(n: Column, of: Callable[[Column], Column]) -> Column:
    """The least value over the lengths that the longer record of a pair may have, one of them having ``n`` words."""
    longest = F.floor(n * EDIT_SHARE / (EDIT_SHARE - 1)).cast("int")
    return F.array_min(F.transform(F.sequence(n, longest), of))


def covered(spans: DataFrame) -> DataFrame:
    """The texts that may have a partner. ``spans``: ``words`` and ``found``, structs of a position and the words it shares.

    A record's coverage is the union of the spans that it shares with any record of the other split. Where the longer record has ``m`` words and ``e`` edits are
    allowed, ``m - e`` words of each stand in at most ``e + 1`` common blocks, of which at most ``e`` are shorter than a span and lose ``span - 1`` words
    each: a record covered less than ``m - span * e`` for every ``m`` has no partner.
    """
    n = F.size("words")
    span = F.when(n <= SHORT, SHORT_SPAN).otherwise(SPAN)
    used = F.array_sort(F.filter("found", lambda s: s["common"] >= span))
    union = F.aggregate(
        used,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["sum"] + F.greatest(s["pos"] + s["common"] - F.greatest(a["end"], s["pos"]), F.lit(0))).alias("sum"), F.greatest(a["end"], s["pos"] + s["common"]).alias("end")
        ),
    )
    return spans.filter(union["sum"] >= least_over_partners(n, lambda m: m - span * edits(m)))


def covered_texts(texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` that may have a partner, with ``found``; see :func:`cross_prefixes` and :func:`covered`."""
    # Cut while the words are one array: exploding first would copy all words for each suffix.
    cuts = F.transform(
        F.sequence(F.lit(0), F.size("words") - SHORT_SPAN), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("words", i + 1, F.lit(ORDER_WORDS)), " ").alias("suffix"))
    )
    suffixes = texts.filter(F.size("words") >= SHORT_SPAN).select("grp", "text_id", "in_train", "in_eval", F.inline(cuts))
    found = cross_prefixes(suffixes).groupBy("text_id").agg(F.collect_list(F.struct("pos", "common")).alias("found"))
    return covered(texts.join(found, "text_id"))


def shared_spans(texts: DataFrame) -> DataFrame:
    """Pairs of a text of the evaluation splits and one of the training split that may be near: ``a, b``, distinct.

    ``texts``: ``grp, words, text_id, in_train, in_eval``, distinct texts, of which only those of one ``grp`` are compared. Coverage by shared spans leaves the texts
    that may have a partner. Two near records share ``n - SPAN + 1 - SPAN * e`` of their span starts at least, so they share one among the first of each
    in any one order of spans: only so many, the rarest first, are joined, and a frequent opening brings no pairs together by itself.
    """
    kept = materialise(covered_texts(texts), "overlap-covered")
    n = F.size("words")

    def starts(span: int) -> Column:
        """Seeds: the spans that begin where as many words are shared."""
        return F.transform(F.filter("found", lambda s: s["common"] >= span), lambda s: F.xxhash64("grp", F.lit(span), F.slice("words", s["pos"] + 1, F.lit(span))))

    least = F.greatest(least_over_partners(n, lambda m: m - SPAN + 1 - SPAN * edits(m)), F.lit(1))
    short = F.when(n <= SHORT, starts(SHORT_SPAN)).otherwise(F.array().cast("array<bigint>"))
    seeds = kept.select("text_id", "in_train", "in_eval", starts(SPAN).alias("long"), short.alias("short"), least.alias("least"))
    seeds = seeds.withColumn("first", F.greatest(F.size("long") - F.col("least") + 1, F.lit(0)))
    each = seeds.select("text_id", F.explode("long").alias("seed"))
    uses = each.groupBy("seed").agg(F.count("*").alias("uses"))
    rank = each.join(uses, "seed").groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("uses", "seed"))).alias("ranked"))
    chosen = seeds.join(rank, "text_id", "left").withColumn(
        "seed", F.explode(F.array_distinct(F.concat(F.coalesce(F.slice("ranked.seed", 1, F.col("first")), F.array().cast("array<bigint>")), "short")))
    )
    left = chosen.filter("in_eval").select("seed", F.col("text_id").alias("a"))
    right = chosen.filter("in_train").select("seed", F.col("text_id").alias("b"))
    return left.join(right, "seed").filter("a <> b").select("a", "b").distinct()


def prepared(records: DataFrame) -> DataFrame:
    """``example_id, kind`` (0 train, 1 evaluation), ``split, grp, words, text_id``; rows without question or choices fall out.

    ``grp`` is the digest of the set of choices, ``text_id`` of it and the question's words.
    """
    squeezed = F.transform("payload.choices", lambda c: F.array_join(words_of(c), ""))
    rows = records.filter(
        "example_id is not null and split in ('train', 'test', 'validation') and payload.question is not null and payload.choices is not null"
    ).filter(~F.exists("payload.choices", lambda c: c.isNull()))
    rows = rows.select(
        "example_id",
        "split",
        (F.col("split") != "train").cast("int").alias("kind"),
        F.md5(F.array_join(F.array_sort(F.array_distinct(squeezed)), "\x1f")).alias("grp"),
        words_of(F.col("payload.question")).alias("words"),
    )
    return rows.withColumn("text_id", F.md5(F.concat_ws("\x1f", "grp", F.array_join("words", " "))))


def cross_split_pairs(records: DataFrame) -> DataFrame:
    """Pairs of a train and an evaluation record that are the same or nearly so: ``train_id, eval_id, split``, distinct.

    The same set of choices, and questions that differ in at most a fifth of the longer one's words. Equal texts are one
    text in the search, however many rows carry them, and only texts whose choices occur on both sides enter it.
    Empty tables give no rows; repeated rows count once; further columns are ignored.
    """
    rows = materialise(prepared(records).distinct(), "overlap-rows")
    kinds = rows.groupBy("grp").agg(F.max("kind").alias("hi"), F.min("kind").alias("lo")).filter("hi = 1 and lo = 0").select("grp")
    texts = rows.join(kinds, "grp", "left_semi").groupBy("grp", "text_id").agg(
        F.first("words").alias("words"), (F.min("kind") == 0).alias("in_train"), (F.max("kind") == 1).alias("in_eval")
    )
    texts = materialise(texts, "overlap-texts")
    found = shared_spans(texts)
    words = texts.select("text_id", "words")
    both = found.join(words.withColumnsRenamed({"text_id": "a", "words": "x"}), "a").join(words.withColumnsRenamed({"text_id": "b", "words": "y"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            ok = [edit_distance_within(p, q, max(len(p), len(q)) // EDIT_SHARE) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, ok) if k], pa.string()) for c in (a, b)], names=["a", "b"])

    near = both.select("a", "b", "x", "y").mapInArrow(verify, "a string, b string")
    same = texts.filter("in_train and in_eval").select(F.col("text_id").alias("a"), F.col("text_id").alias("b"))
    links = near.unionByName(same)
    evals = rows.filter("kind = 1").select(F.col("text_id").alias("a"), F.col("example_id").alias("eval_id"), "split").distinct()
    trains = rows.filter("kind = 0").select(F.col("text_id").alias("b"), F.col("example_id").alias("train_id")).distinct()
    return links.join(evals, "a").join(trains, "b").select("train_id", "eval_id", "split").distinct()


def collection_of(example_id: Column) -> Column:
    """The item's source: the part of ``arc_easy-<collection>_<number>`` between the dash and the last underscore."""
    return F.regexp_extract(example_id, r"^[^-]*-(.*)_\d+$", 1)
