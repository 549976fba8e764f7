"""Evaluation texts leaking into training text: CGK embedding, bit-sampling LSH, exact edit check (problem 9).

A window of words is embedded by random walks: at each step the walk writes the word it stands on and
moves on or stays by a random bit that depends on the step and the word. Two windows a few edits apart
fall into step again, so their embeddings differ in few places (Chakraborty, Goldenberg, Koucky, 2016), and a
few sampled places are often all equal. Several walks with several samples each make a miss unlikely.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import spread

#: Words of a window, and words in a row that make a leak, of which one in EDIT_SHARE may differ.
WINDOW = 18
EDIT_SHARE = 8
#: Steps of a walk, walks, samples of each walk and places of each sample. Two windows that differ by
#: two edits meet in at least one of the tables with a probability over 0.99 (measured in the tests).
STEPS, WALKS, SAMPLES, PLACES = 40, 12, 4, 6
#: Item bigrams that a window must hold. No leak is lost by it: every leak has 18 item words with at most two edits, and an
#: edit spoils two of the 17 bigrams of the words in their place at most.
LEAST_BIGRAMS = WINDOW - 1 - 2 * (WINDOW // EDIT_SHARE)
#: Words of a part of an item. Every leak has one of fewer than twice 18 words within (of two halves, one has no more edits for its
#: length than the whole), so parts that overlap by as many lose none.
PART = 128
#: Items and characters of one index, some MB, and indexes that one pass over the documents searches; more items take more passes.
BLOCK_ITEMS, BLOCK_CHARS, PASS_BLOCKS = 4000, 2_000_000, 16
#: Insertions and omissions by which a leak may leave the shift at which it was met: one in eight of twice 18 words, and two for the place met.
DRIFT = (2 * WINDOW - 1) // EDIT_SHARE + WINDOW // EDIT_SHARE
#: Documents whose words are one array.
BATCH = 512
_SEED = 20_160_318


def normal_text(texts: pa.Array) -> pa.Array:
    """Words parted by single spaces, without letter case, punctuation and markup; a word broken at a line's end or by a hyphen is one. Null stays null."""
    t = pc.utf8_lower(texts)
    if pc.any(pc.match_substring(t, "<")).as_py():
        t = pc.replace_substring_regex(t, r"</?[a-z!][^<>]*>", "")
    if pc.any(pc.match_substring(t, "&")).as_py():
        t = pa.array([html.unescape(x) if x and "&" in x else x for x in t.to_pylist()], pa.string())
    t = pc.replace_substring_regex(t, r"([\pL\pN_])[-‐‑\x{ad}]\s*\n\s*", r"\1")
    t = pc.replace_substring_regex(t, r"[-‐‑\x{ad}'’`´\x{200b}-\x{200f}\x{2060}\x{feff}*]+", "")
    return pc.utf8_trim(pc.replace_substring_regex(t, r"[^\pL\pN]+", " "), " ")


def leak_words(text: str | None) -> list[str]:
    """The words of one text."""
    return (normal_text(pa.array([text], pa.string()))[0].as_py() or "").split()


def item_prints(ids: np.ndarray, bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of windows, one column a table. ``ids``: windows by words; ``bits``: walks by steps by words."""
    n, width = ids.shape
    padded = np.concatenate([ids, np.full((n, STEPS + 1 - width), bits.shape[2] - 1, ids.dtype)], axis=1)
    flat, row = padded.ravel(), np.arange(n, dtype=np.int64) * padded.shape[1]
    out = np.empty((n, WALKS * SAMPLES), np.uint64)
    written = np.empty((STEPS, n), ids.dtype)
    for w in range(WALKS):
        at = row.copy()
        for j in range(STEPS):
            word = flat[at]
            written[j] = word
            at += bits[w, j][word]
        for s in range(SAMPLES):
            key = np.zeros(n, np.uint64)
            for p in places[w, s]:
                key = (key + written[p].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, w * SAMPLES + s] = key
    return out


class LeakIndex:
    """What the search needs of a block of items: vocabulary, bigrams, tables. A few MB for a block, whatever the documents' number."""

    def __init__(self, items: list[tuple[int, str]]):
        words = [(i, leak_words(t)) for i, t in items]
        step = PART - 2 * WINDOW + 1
        words = [(i, w[a : a + PART]) for i, w in words if len(w) >= WINDOW for a in range(0, max(1, len(w) - PART + step), step)]
        self.vocab: dict[str, int] = {}
        for _, w in words:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        size = len(self.vocab) + 2  # 0 stands for words of no item, the last for the end of a window
        self.size = size
        self.items = [i for i, _ in words]
        self.texts = [np.array([self.vocab[x] for x in w], np.int32) for _, w in words]
        self.names = pa.array(list(self.vocab), pa.string())
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.matrix = np.full((len(words), max([WINDOW, *self.lengths])), -1, np.int32)  # items by words
        for k, t in enumerate(self.texts):
            self.matrix[k, : len(t)] = t
        rng = np.random.default_rng(_SEED)
        self.bits = np.stack([rng.integers(0, 2, (STEPS, size)).astype(np.int8) for _ in range(WALKS)])
        self.places = np.stack([[np.sort(rng.choice(STEPS, PLACES, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)])
        pairs = [t[:-1].astype(np.int64) * size + t[1:] for t in self.texts]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.slot(self.pairs)] = True
        windows = [np.lib.stride_tricks.sliding_window_view(t, WINDOW) for t in self.texts]
        self.owner = np.concatenate([np.full(len(w), k, np.int32) for k, w in enumerate(windows)]) if windows else np.zeros(0, np.int32)
        self.offset = np.concatenate([np.arange(len(w), dtype=np.int32) for w in windows]) if windows else np.zeros(0, np.int32)
        if windows:
            prints = item_prints(np.concatenate(windows), self.bits, self.places)
            self.order = np.argsort(prints, axis=0, kind="stable").astype(np.int32)
            self.keys = np.take_along_axis(prints, self.order, axis=0).T.copy()
            self.order = self.order.T.copy()

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def alike(self, ids: np.ndarray, position: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct places met at which all but three of the window's words lie within three words of their place.

        Of the 18 words of a leak with at most two edits all but two do, within two; so only chance meetings fall out, which common openings make many.
        """
        n = max(1, len(self.owner))
        position, window = np.divmod(np.unique(position * n + window), n)
        e = WINDOW // EDIT_SHARE + 1
        own = self.matrix[self.owner[window][:, None], self.offset[window][:, None] + np.arange(WINDOW)]
        near = np.zeros(own.shape, bool)
        for d in range(-e, e + 1):
            near |= ids.take(position[:, None] + np.arange(d, d + WINDOW), mode="clip") == own
        keep = near.sum(axis=1) >= WINDOW - e
        return position[keep], window[keep]

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``ids``, a run of documents' words, and the item windows that share a table's hash with them."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(ids) < WINDOW or not self.texts:
            return none
        key = ids[:-1].astype(np.int64) * self.size + ids[1:]
        hit = self.seen[self.slot(key)] & (ids[:-1] > 0)
        run = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        at = np.flatnonzero(run[WINDOW - 1 :] - run[: len(run) - WINDOW + 1] >= LEAST_BIGRAMS)
        found_at, found = [], []
        for lo in range(0, len(at), 65536):
            own = at[lo : lo + 65536]
            prints = item_prints(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[own], self.bits, self.places)
            for t in range(prints.shape[1]):
                first = np.searchsorted(self.keys[t], prints[:, t], "left")
                some = np.flatnonzero((first < self.keys.shape[1]) & (self.keys[t][np.minimum(first, self.keys.shape[1] - 1)] == prints[:, t]))
                if not len(some):
                    continue
                last = np.searchsorted(self.keys[t], prints[some, t], "right")
                count = last - first[some]
                where = np.repeat(some, count)
                within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                found_at.append(own[where])
                found.append(self.order[t][np.repeat(first[some], count) + within])
        return (np.concatenate(found_at), np.concatenate(found)) if found else none


def dense(good: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of ``good``, a row's first ``lengths`` places, with 18 places in a row or more of which at most one in eight isn't good."""
    total = np.zeros((len(good), good.shape[1] + 1), np.int32)
    np.cumsum(np.where(good, 1, 1 - EDIT_SHARE), axis=1, out=total[:, 1:])
    least = np.minimum.accumulate(total[:, : total.shape[1] - WINDOW], axis=1)
    inside = np.arange(WINDOW, total.shape[1]) <= lengths[:, None]
    return ((total[:, WINDOW:] >= least) & inside).any(axis=1)


class Words:
    """The words of a batch of texts as one array of numbers; 0 stands for a word of no item and parts the texts."""

    def __init__(self, index: LeakIndex, lists: pa.ListArray):
        found = pc.fill_null(pc.index_in(lists.flatten(), value_set=index.names), -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        n = len(lists)
        self.begin = ends + np.arange(n + 1)
        self.text = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.begin))
        self.ids = np.zeros(self.begin[-1], np.int32)
        own = np.ones(len(self.ids), bool)
        own[self.begin[1:] - 1] = False
        self.ids[own] = found
        self.text[~own] = -1

    def same(self, index: LeakIndex, text: np.ndarray, owner: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Candidates by item words: whether the word of the text that lies over the item's at the shift is the same."""
        at = shift[:, None] + np.arange(index.matrix.shape[1])
        inside = (at >= 0) & (at < len(self.ids))
        at = np.where(inside, at, len(self.ids) - 1)
        return (self.ids[at] == index.matrix[owner]) & (self.text[at] == text[:, None]) & inside


def leaks(doc: np.ndarray, item: np.ndarray) -> bool:
    """Whether ``doc`` holds some 18 words in a row or more of ``item``, at most one word in eight altered, dropped or added.

    Dynamic programming over both texts and the number of edits; each cell has the earliest word of the item from which
    an alignment ends there. Exact.
    """
    most = len(item) // EDIT_SHARE
    before = [np.zeros(len(doc) + 1, np.int32)] + [np.zeros(len(doc) + 1, np.int32)] * most
    for i in range(1, len(item) + 1):
        same = doc == item[i - 1]
        now: list[np.ndarray] = []
        for e in range(most + 1):
            row = np.full(len(doc) + 1, i, np.int32)
            row[1:][same] = np.minimum(row[1:][same], before[e][:-1][same])
            if e:
                row[1:] = np.minimum(row[1:], before[e - 1][:-1])
                row = np.minimum(row, before[e - 1])
                row[1:] = np.minimum(row[1:], now[e - 1][:-1])
            if i - row.min() >= max(WINDOW, EDIT_SHARE * e):
                return True
            now.append(row)
        before = now
    return False


def search_batch(index: LeakIndex, lists: pa.ListArray) -> list[tuple[int, int]]:
    """``(number of the text, item)`` of every leak in a batch of texts, given as lists of words.

    Places met in the tables are judged all at once: the windows met must be alike; changes alone at one shift make a leak, or else the words that any shift nearby
    lays over each other must be dense enough, which few places pass that hold none. Those are verified exactly.
    """
    words = Words(index, lists)
    position, window = index.candidates(words.ids)
    position, window = index.alike(words.ids, position, window)
    if not len(position):
        return []
    text, owner = words.text[position].astype(np.int64), index.owner[window].astype(np.int64)
    shift = position - index.offset[window]
    n, wide = len(index.texts), index.matrix.shape[1]
    span = len(words.ids) + wide
    pair, shift = np.divmod(np.unique(((text * n + owner) * span + shift + wide)[text >= 0]), span)
    (text, owner), shift = np.divmod(pair, n), shift - wide
    good = dense(words.same(index, text, owner, shift), index.lengths[owner])
    found = set(pair[good].tolist())
    rest = ~np.isin(pair, pair[good])
    text, owner, shift, pair = text[rest], owner[rest], shift[rest], pair[rest]
    if len(pair):
        near = words.same(index, text, owner, shift)
        for d in range(1, DRIFT + 1):
            near |= words.same(index, text, owner, shift - d) | words.same(index, text, owner, shift + d)
        open_ = dense(near, index.lengths[owner])
        for t, o, s, p in zip(text[open_].tolist(), owner[open_].tolist(), shift[open_].tolist(), pair[open_].tolist()):
            if p in found:
                continue
            item = index.texts[o]
            lo, hi = int(words.begin[t]), int(words.begin[t + 1]) - 1
            if leaks(words.ids[max(lo, s - DRIFT) : min(hi, s + len(item) + DRIFT)], item):
                found.add(p)
    return sorted({(p // n, index.items[p % n]) for p in found})


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``doc_id, item_id``, distinct: the documents that hold an item, whole or in part.

    The items are a stated query set. They are indexed in blocks of bounded size; a block's index is broadcast (some MB, bounded by the
    block), and one pass over the documents, whose words are told once, searches a bounded number of blocks. Documents stay where they
    are: no shuffle of texts but the spreading of a few large files. Null and empty texts hold nothing, items of fewer than 18 words are held by nothing; null ids fall out;
    a repeated document or item counts once.
    """
    spark = docs.sparkSession
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema.add(items.select(F.col(item_id).alias("item_id")).schema[0])
    wanted = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(item_id, item_text).distinct().orderBy(item_id, item_text)
    rows = docs.filter(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = spread(rows)
    id_type = to_arrow_type(schema[1].dataType)

    def over(shared: list[Broadcast]) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, BATCH):
                    part = batch.slice(lo, BATCH)
                    lists = pc.split_pattern(normal_text(part.column(1)), " ")
                    for index in shared:
                        hits = search_batch(index.value, lists)
                        ids = part.column(0).take(pa.array([d for d, _ in hits], pa.int64()))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in hits], id_type)], names=["doc_id", "item_id"])

        return rows.mapInArrow(work, schema)

    found, shared, block = None, [], []

    def passed() -> DataFrame:
        part = over(shared)
        return part if found is None else found.unionByName(part)

    chars = 0
    for row in wanted.toLocalIterator():
        block.append((row[0], row[1]))
        chars += len(row[1])
        if len(block) == BLOCK_ITEMS or chars >= BLOCK_CHARS:
            shared.append(spark.sparkContext.broadcast(LeakIndex(block)))
            block, chars = [], 0
            if len(shared) == PASS_BLOCKS:
                found, shared = passed(), []
    if block or found is None and not shared:
        shared.append(spark.sparkContext.broadcast(LeakIndex(block)))
    if shared:
        found = passed()
    return found.distinct()
