"""Filling containers of fixed capacity with documents, by lexical retrieval (problem 8)."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAPACITY = 2048
#: The vocabulary file, unless the session names another in ``TOKENIZER_SETTING``; a name without folders is that of a file shipped with ``addFile``.
TOKENIZER, TOKENIZER_SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.gradloom.tokenizer"
#: Splits text before byte pairs are merged; a fixed value that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a shard, at most twice as many; and buckets of routes, from which shards are made.
SHARD_CHARS, BUCKETS = 8_000_000, 65_536
#: Letters of the words that a route is chosen from.
_LONG_WORD = r"(?<!\p{L})(\p{L}{9,24})(?!\p{L})"
#: BM25's constants.
K1, B = 1.2, 0.75
#: Terms that one item in so many has are added up as whole rows of scores.
DENSE = 8
#: Neighbours put in order at a time; the next block follows as long as there is room, so no result hangs on it.
BLOCK = 64

SCHEMA = "container string, position int, doc_id bigint, part int, start_token int, n_tokens int, n_bytes bigint"
_ARROW = pa.schema(
    [("container", pa.string()), ("position", pa.int32()), ("doc_id", pa.int64()), ("part", pa.int32()), ("start_token", pa.int32()), ("n_tokens", pa.int32()), ("n_bytes", pa.int64())]
)


@cache
def vocabulary(path: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """The tokenizer of a vocabulary file, and the bytes of each token; once a process."""
    import tiktoken

    with open(path if "/" in path else SparkFiles.get(path), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        n_bytes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, n_bytes


def encoder(path: str) -> Callable[[str], list[int]]:
    """The tokenizer of a vocabulary file."""
    return vocabulary(path)[0]


class ShardIndex:
    """BM25 over a shard's items, by token. Statistics are those of all the shard's items. Where a token stands is kept in the order of the items' numbers."""

    def __init__(self, tokens: list[np.ndarray]):
        n = len(tokens)
        size = np.array([len(t) for t in tokens], np.int64)
        key, tf = np.unique(np.concatenate([t.astype(np.int64) + (np.int64(i) << 32) for i, t in enumerate(tokens)]), return_counts=True)
        item, term = key >> 32, key & 0xFFFFFFFF
        df = np.bincount(term)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(1.0, size.mean())))
        order = np.argsort(term, kind="stable")
        self.term, self.n_terms = term, len(df)
        self.own = np.searchsorted(item, np.arange(n + 1))
        # A row of scores for each term that many items have: not more rows than DENSE times the terms of an item on average.
        often = np.flatnonzero(df * DENSE > n)
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), n))
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], item[dense]] = weight[dense]
        order = order[self.row[term[order]] < 0]
        self._set((term[order] << 32) + item[order], weight[order])

    def scores(self, seed: int, below: int) -> np.ndarray:
        """The scores of the items numbered ``below``, for all the seed's terms that others share; repeated rows score as any."""
        terms = self.term[self.own[seed] : self.own[seed + 1]].astype(np.int64)
        often = self.row[terms]
        out = np.zeros(below)
        for r in often[often >= 0].tolist():
            out += self.rows[r, :below]
        terms = terms[often < 0]
        first = self.begin[terms]
        count = np.searchsorted(self.keys, (terms << 32) + below) - first
        terms, first, count = terms[count > 0], first[count > 0], count[count > 0]
        if not len(terms):
            return out
        spans = [slice(a, a + k) for a, k in zip(first.tolist(), count.tolist())]
        return out + np.bincount(np.concatenate([self.items[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), below)

    def drop(self, used: np.ndarray) -> None:
        """Forget where the used items stand; statistics stay those of all items."""
        keep = ~used[self.items]
        self.rows[:, used] = 0
        self._set(self.keys[keep], self.weights[keep])

    def _set(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.keys, self.weights, self.items = keys, weights, keys & 0xFFFFFFFF
        self.begin = np.searchsorted(keys, np.arange(self.n_terms + 1, dtype=np.int64) << 32)


def ranked(score: np.ndarray, fits: Callable[[np.ndarray], np.ndarray]) -> Iterator[int]:
    """The items of a score above 0 by falling score, ties by number, less those that no longer fit when their block begins."""
    rest, block = np.flatnonzero(score > 0), BLOCK
    while len(rest := rest[fits(rest)]):
        of = score[rest]
        least = np.partition(of, len(of) - block)[len(of) - block] if len(of) > block else 0.0
        near = rest[of >= least]  # all ties with the last one too
        yield from near[np.lexsort((near, -score[near]))].tolist()
        rest, block = rest[of < least], block * 4


def fill(sizes: list[int], scores: Callable[[int, int], np.ndarray], capacity: int, drop: Callable[[np.ndarray], None] = lambda used: None) -> list[list[int]]:
    """Containers as lists of items, none over the capacity. ``sizes`` must ascend, from 1 to ``capacity`` at most.

    The largest unused item seeds a container, and all its unused neighbours are tried in order of their score. Only items that fit are scored: by their order
    they are the first ones (``scores`` gets the seed and their number). Room is left to the largest unused items that fit only when no item with a score above 0 does.
    ``drop`` is told what is used from time to time.
    """
    free = list(range(len(sizes)))
    used = np.zeros(len(sizes), bool)
    size = np.array(sizes, np.int64)
    out, dropped = [], len(free)

    def take(i: int) -> None:
        used[i] = True
        free.pop(bisect.bisect_left(free, i))

    while free:
        seed = free[-1]
        take(seed)
        own, room = [seed], capacity - sizes[seed]
        if room and free and sizes[free[0]] <= room:
            if len(free) < 0.8 * dropped:
                drop(used)
                dropped = len(free)
            score = scores(seed, min(seed, bisect.bisect_right(sizes, room)))
            score[used[: len(score)]] = 0
            for i in ranked(score, lambda x: size[x] <= room):
                if sizes[i] <= room:
                    take(i)
                    own.append(i)
                    room -= sizes[i]
                    if not free or sizes[free[0]] > room:
                        break
            while room and free:
                at = bisect.bisect_right(free, bisect.bisect_right(sizes, room) - 1) - 1
                if at < 0:
                    break
                i = free[at]
                take(i)
                own.append(i)
                room -= sizes[i]
        out.append(own)
    return out


def pack_shard(shard: str, ids: list[int], texts: list[str], capacity: int, encode: Callable[[str], list[int]], n_bytes: np.ndarray) -> list[tuple]:
    """Rows of :data:`SCHEMA` for one shard's documents, which come in any order."""
    docs = sorted(zip(ids, texts))
    rows: list[tuple] = []
    items, tokens = [], []
    full = 0
    for doc, text in docs:
        got = np.array(encode(text), np.int32)
        start = part = 0
        while len(got) - start > capacity:
            rows.append((f"{shard}-w{full}", 0, doc, part, start, capacity, int(n_bytes[got[start : start + capacity]].sum())))
            full, part, start = full + 1, part + 1, start + capacity
        if len(got) - start:
            items.append((doc, part, start, len(got) - start, int(n_bytes[got[start:]].sum())))
            tokens.append(got[start:])
    if items:
        order = sorted(range(len(items)), key=lambda i: (items[i][3], i))
        items, index = [items[i] for i in order], ShardIndex([tokens[i] for i in order])
        for k, own in enumerate(fill([x[3] for x in items], index.scores, capacity, index.drop)):
            rows += [(f"{shard}-{k}", p, *items[i]) for p, i in enumerate(own)]
    return rows


def with_shard(rows: DataFrame) -> DataFrame:
    """Adds ``shard``. ``rows``: ``doc_id, text``.

    Documents of one subject and language tend to share their longest words, so a document's route is its longest word (9 to 24 letters, ties to the last in the alphabet; none
    is a route too), hashed to a bucket. Buckets follow each other into shards of about ``SHARD_CHARS``; a bucket larger than that is split by the documents' hash
    into as many shards as it needs. So shards are bounded whatever the routes, and neighbours mostly meet.
    """
    longest = F.array_max(F.transform(F.regexp_extract_all("text", F.lit(_LONG_WORD), 1), lambda w: F.struct(F.length(w).alias("n"), F.lower(w).alias("w"))))["w"]
    routed = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.coalesce(longest, F.lit(""))), F.lit(BUCKETS)).cast("int"))
    chars = routed.groupBy("_bucket").agg(F.sum(F.length("text").cast("bigint")).alias("n"))
    small = F.when(F.col("n") <= SHARD_CHARS, F.col("n")).otherwise(0)
    upto = F.sum(small).over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    # At most BUCKETS rows, whatever the documents' number.
    table = chars.select("_bucket", F.ceil(F.col("n") / SHARD_CHARS).cast("int").alias("_parts"), F.floor(F.coalesce(upto, F.lit(0)) / SHARD_CHARS).cast("int").alias("_at"))
    found = routed.join(F.broadcast(table), "_bucket")
    own = F.concat(F.lit("h"), F.col("_bucket").cast("string"), F.lit("-"), F.pmod(F.xxhash64("doc_id", "text"), F.col("_parts")).cast("string"))
    return found.withColumn("shard", F.when(F.col("_parts") > 1, own).otherwise(F.concat(F.lit("s"), F.col("_at").cast("string")))).drop("_bucket", "_parts", "_at")


def packed(docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Which container holds which part of each document, rows of :data:`SCHEMA`.

    A document larger than a container is cut into whole containers and a rest, which is packed as any item; no other is
    cut. Documents fall into shards by their content (:func:`with_shard`); a shard is bounded in size, so its index fits a task. One shuffle of the texts.
    Null and empty texts and null ids are not packed; repeated rows are packed each. Reruns agree.
    Neighbours are sought within the shard, by all shared terms and to the last of them.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    path = tokenizer or docs.sparkSession.conf.get(TOKENIZER_SETTING, TOKENIZER)
    rows = docs.filter(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def work(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        got = pack_shard(shard, table.column("doc_id").to_pylist(), table.column("text").to_pylist(), capacity, *vocabulary(path))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), _ARROW.types)], schema=_ARROW) if got else _ARROW.empty_table()

    return with_shard(rows).groupBy("shard").applyInArrow(work, SCHEMA)
