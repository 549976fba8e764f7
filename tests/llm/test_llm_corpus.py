import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.llm import leakage, ledger, packing, split_overlap, subjects

# Problem 4

ARC = "example_id string, split string, payload struct<question: string, choices: array<string>, answer_index: int>"


def overlap(spark, rows):
    frame = spark.createDataFrame(rows, ARC).withColumn("words", F.lit("clash")).withColumn("grp", F.lit(1)).withColumn("kind", F.lit(1))
    return sorted(tuple(r) for r in split_overlap.cross_split_pairs(frame).select("train_id", "eval_id").collect())


def levenshtein(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[-1] + 1))
        before = now
    return before[-1]


def test_overlap_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 15, 24]))] for _ in range(60)]
    rows = []
    for i, b in enumerate(base):
        rows.append((f"t{i:03d}", "train", (" ".join(b), ["a", "b"], 0)))
        for k in range(3):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(c) // 4))):
                op, at = rng.randint(0, 2), rng.randrange(len(c))
                if op == 0:
                    c[at] = "zz"
                elif op == 1:
                    c.insert(at, "yy")
                elif len(c) > 1:
                    del c[at]
            rows.append((f"v{i:03d}{k}", rng.choice(["test", "validation"]), (" ".join(c).upper() + " !", ["B.", "a"], 1)))
    want = sorted(
        (t, e) for t, s, p in rows if s == "train" for e, s2, q in rows
        if s2 != "train" and levenshtein(p[0].lower().split(), q[0].lower().replace("!", "").split()) * 5 <= max(len(p[0].split()), len(q[0].split()) - 1)
    )
    assert overlap(spark, rows) == want and len(want) > 60


def test_prefixes_shared_with_the_other_split(spark):
    rng = random.Random(2)
    texts = [(f"g{i % 2}", [rng.choice("abc") for _ in range(rng.randint(2, 9))], f"t{i}", *rng.choice([(True, False), (False, True)])) for i in range(60)]
    rows = [(g, " ".join(w[p:]), t, p, tr, ev) for g, w, t, tr, ev in texts for p in range(len(w) - 1)]
    frame = spark.createDataFrame(rows, "grp string, suffix string, text_id string, pos int, in_train boolean, in_eval boolean")
    got = {(r["text_id"], r["pos"]): r["common"] for r in split_overlap.cross_prefixes(frame).collect()}

    def common(a, b):
        k = 0
        for x, y in zip(a.split(), b.split()):
            if x != y:
                break
            k += 1
        return k

    exact = []
    for g, s, t, p, tr, ev in rows:
        least = max((common(s, s2) for g2, s2, t2, p2, tr2, ev2 in rows if g2 == g and (t2, p2) != (t, p) and t2 != t and (tr and ev2 or ev and tr2)), default=0)
        assert got.get((t, p), 0) >= (least if least >= split_overlap.SHORT_SPAN else 0)  # nothing shared is missed
        if tr != ev:
            exact.append(got.get((t, p), 0) == (least if least >= split_overlap.SHORT_SPAN else 0))
    assert all(exact)  # also at the borders of ranges


def test_the_suffix_array_decides_the_candidates(spark, monkeypatch):
    # evaluation questions share an opening with many train questions, and one of them is nearly the same
    opening = "which of the following"
    rng = random.Random(5)
    train = [(f"t{i}", "train", (opening + " " + " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 99)}" for _ in range(12)), ["true", "false"], 0)) for i in range(200)]
    evals = [(f"v{i}", "test", (opening + " " + " ".join(f"{rng.choice('ijklmnop')}{rng.randint(0, 99)}" for _ in range(12)), ["true", "false"], 0)) for i in range(50)]
    near = ("near", "test", (train[7][2][0] + " indeed", ["false", "true"], 0))
    frame = spark.createDataFrame([*train, *evals, near], ARC)
    rows = split_overlap.prepared(frame)
    texts = rows.select("grp", "text_id", "words", (F.col("kind") == 0).alias("in_train"), (F.col("kind") == 1).alias("in_eval"))
    assert {r["text_id"] for r in split_overlap.covered_texts(texts).collect()} == {r["text_id"] for r in rows.filter("example_id in ('t7', 'near')").collect()}
    assert split_overlap.shared_spans(texts).count() == 1  # the opening alone, in 200 by 51 pairs, brings none together
    assert sorted(tuple(r) for r in split_overlap.cross_split_pairs(frame).select("train_id", "eval_id").collect()) == [("t7", "near")]
    monkeypatch.setattr(split_overlap, "cross_prefixes", lambda x: x.selectExpr("text_id", "pos", "size(split(suffix, ' ')) as common"))
    assert split_overlap.covered_texts(texts).count() == 251


def test_overlap_edges(spark):
    q = "one two three four five six"
    rows = [
        ("t", "train", (q, ["a", "b"], 0)), ("t", "train", (q, ["a", "b"], 0)), ("v", "test", ("One, two three: four five six?", ["B", "A"], 1)), ("other", "test", (q, ["a", "c"], 0)),
        ("null", "test", (None, ["a", "b"], 0)), ("nochoice", "test", (q, None, 0)), ("hole", "test", (q, ["a", None], 0)), ("dev", "dev", (q, ["a", "b"], 0)), ("empty", "test", ("", ["a", "b"], 0)), (None, "test", (q, ["a", "b"], 0)),
    ]
    assert overlap(spark, rows) == [("t", "v")]
    assert overlap(spark, []) == []
    hot = [(f"t{i}", "train", (f"{q} number {i}", ["a", "b"], 0)) for i in range(300)] + [("v", "test", (f"{q} number 7", ["a", "b"], 0))]
    assert len(overlap(spark, hot)) == 300  # all but one differ in one word of eight


# Problem 5


def keys(frame):
    return {r["key"] for r in frame.collect()}


def pool(spark, n, start=0):
    return spark.range(start, n).select(F.lit("d").alias("set"), F.col("id").cast("string").alias("key"), F.timestamp_seconds(F.col("id") % 50 + 1000 * (F.col("id") >= 500).cast("int")).alias("arrival"))


def quota(spark, n):
    return spark.createDataFrame([("p", n, 7, "d")], "pool string, quota int, seed int, set string")


def test_sample_is_stable(spark):
    empty = spark.createDataFrame([], ledger.LEDGER)

    def grown(rows, n):
        return keys(ledger.grow(empty, rows, quota(spark, n), ["set"]))

    early = grown(pool(spark, 500), 100)
    assert len(early) == 100
    assert grown(pool(spark, 500).repartition(9), 100) == early
    assert grown(pool(spark, 1000), 100) == early  # later rows put none out
    more = grown(pool(spark, 1000), 700)
    assert early < more and len(more) == 700


def test_one_hour_with_a_time_for_each_row_is_ranked_in_many_tasks(spark):
    # a bulk load: 20,000 rows of one pool in one hour, no two at the same time
    rows = spark.range(20_000).select(F.lit("p").alias("pool"), F.col("id").cast("string").alias("key"), F.timestamp_micros(F.col("id") * 7919 % 20_000).alias("arrival"))
    got = ledger.ranked(rows, ["arrival", "key"], 8)
    assert got.filter("unix_micros(arrival) <> rank - 1").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "_part" in plan.split("Window", 1)[1].split("\n")[0]  # what is summed in a window is a row for each partition
    assert rows.rdd.getNumPartitions() > 1 and got.select(F.spark_partition_id()).distinct().count() > 1


def test_what_cannot_be_chosen_is_not_ranked(spark):
    rows = spark.range(5000).select(F.lit("d").alias("set"), F.col("id").cast("string").alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("arrival"))
    until = ledger.early_enough(rows, quota(spark, 130), ["set"]).first()["_until"]
    assert rows.filter(F.date_trunc("hour", "arrival") <= F.lit(until)).count() == 180  # three hours hold the first 130


def test_ledger_keeps_earlier_keys(spark, tmp_path):
    book = ledger.SelectionLedger(spark, str(tmp_path / "ledger"))
    assert book.current().count() == 0
    first = keys(book.advance(pool(spark, 1000, 500), quota(spark, 50), ["set"]))
    second = keys(book.advance(pool(spark, 500), quota(spark, 80), ["set"]))  # rows that arrived before, and without the first ones
    assert len(first) == 50 and first < second and len(second) == 80
    again = ledger.SelectionLedger(spark, str(tmp_path / "ledger"))  # what was chosen outlives the process
    assert keys(again.advance(pool(spark, 1000), quota(spark, 80), ["set"])) == second
    assert sorted(r["rank"] for r in again.current().collect()) == list(range(1, 81))


def test_share_grows_by_lowest_priority(spark, tmp_path):
    rows = spark.range(400).select(F.lit("d").alias("dataset"), F.lit("s").alias("split"), F.col("id").cast("string").alias("key"), F.timestamp_seconds("id").alias("arrival"))
    got = ledger.share_samples(rows, ["1970-01-01 00:01:40", "1970-01-01 01:00:00"], 10, ledger.SelectionLedger(spark, str(tmp_path / "ledger"))).collect()
    import hashlib

    def lowest(ids, n):
        return set(sorted(map(str, ids), key=lambda k: (hashlib.sha256(f"d|s|0|0|{k}".encode()).hexdigest(), k))[:n])

    first = lowest(range(101), 11)
    assert {r["example_id"] for r in got if r["version"] == 1} == first
    assert {r["example_id"] for r in got if r["version"] == 2} == lowest(set(map(str, range(400))) - first, 29)


def test_quota_edges(spark):
    empty = spark.createDataFrame([], ledger.LEDGER)

    def grown(rows, n):
        return keys(ledger.grow(empty, rows, quota(spark, n), ["set"]))

    assert grown(pool(spark, 20), 0) == set()
    assert len(grown(pool(spark, 20), None)) == 20
    assert len(grown(pool(spark, 20), 10**9)) == 20
    odd = spark.createDataFrame([("d", "s", None, None, 1), ("d", "s", "a", None, 2), ("d", "s", "a", None, 3), (None, "s", "b", None, 4)], "dataset string, split string, example_id string, added_at timestamp, key int")
    found = ledger.arrivals([odd, odd]).collect()
    assert [(r["dataset"], r["key"]) for r in found] == [("d", "a")] and found[0]["arrival"] is not None
    assert ledger.arrivals([odd.filter("false")]).count() == 0


# Problem 8


def test_packing_keeps_every_token(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(1, 900)))) for i in range(300)] + [(300, ""), (301, None), (None, "x"), (302, "é" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("clash"))
    encode = packing.encoder(packing.TOKENIZER)
    got = packing.packed(docs, "doc_id", "text", 256).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
    for doc, text in rows:
        if doc is None or not text:
            assert doc not in parts
            continue
        size = len(encode(text))
        spans = sorted(parts[doc])
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) == size
        assert len(spans) == max(1, -(-size // 256))
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
    assert max(fill.values()) <= 256 and sum(fill.values()) / (256 * len(fill)) > 0.95
    again = packing.packed(docs.repartition(7), "doc_id", "text", 256).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert packing.packed(docs.filter("false"), "doc_id", "text", 256).count() == 0


def test_shards_follow_content_and_stay_small(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_CHARS", 4000)
    # a third of all documents share a route, the others have forty
    rows = [(i, "championship game " * 5 if i % 3 == 0 else f"internationally{chr(97 + i % 40 % 26)}{chr(97 + i % 40 // 26)} known " * 4) for i in range(900)] + [(900, "no word"), (901, "ß")]
    got = packing.with_shard(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    chars, routes = {}, {}
    for r in got:
        chars[r["shard"]] = chars.get(r["shard"], 0) + len(r["text"])
        routes.setdefault(r["text"], set()).add(r["shard"])
    assert len(got) == 902 and max(chars.values()) <= 2 * 4000
    hot = routes.pop("championship game " * 5)
    assert len(hot) > 4 and all(len(s) == 1 for s in routes.values())


def test_neighbours_share_containers():
    index = packing.ShardIndex([np.array(x) for x in ([9, 4, 5], [1, 2, 6], [7, 8, 9], [1, 2, 3, 9])])
    score = index.scores(3, 3)
    assert score[1] > score[0] and score[1] > score[2]
    assert packing.fill([3, 3, 3, 3], lambda i, n: np.array([1.0, 0, 0])[:n], 6) == [[3, 0], [2, 1]]


def test_packing_tries_every_neighbour():
    # the seed has 100 near copies that fit beside it only one at a time, and one small relative of rank 101
    sizes = [10, 11] + [60] * 100 + [100]
    score = np.array([1.0, 0.0] + [5.0] * 100)
    got = packing.fill(sizes, lambda i, n: score[:n].copy() if i == 102 else np.zeros(n), 171)
    assert got[0] == [102, 2, 0]
    assert sorted(i for own in got for i in own) == list(range(len(sizes)))


def test_packing_asks_for_every_shared_term():
    # item 0 shares only token 99 with the seed, the last; tokens 0 to 12 are rarer, and each is shared with an item of its own
    tokens = [[99, 500], *([t] for t in range(13)), *([99, 600 + k] for k in range(4)), [*range(13), 99]]
    index = packing.ShardIndex([np.array(x) for x in tokens])
    before = index.scores(18, 18)
    assert len(before) == 18 and (before > 0).all()
    assert (index.scores(18, 5) == before[:5]).all()  # leaving items out changes no score
    used = np.zeros(19, bool)
    used[[3, 18]] = True
    index.drop(used)
    after = index.scores(18, 18)
    assert after[3] == 0 and (np.delete(after, 3) == np.delete(before, 3)).all()


def test_scores_are_those_of_bm25():
    rng = np.random.default_rng(6)
    tokens = [np.minimum(rng.geometric(0.05, rng.integers(1, 60)), 80) for _ in range(50)]  # frequent and rare tokens
    index = packing.ShardIndex(tokens)
    assert 0 < len(index.rows) < index.n_terms and len(index.items)
    size = np.mean([len(t) for t in tokens])
    for seed in (0, 7, 49):
        want = np.zeros(50)
        for term in set(tokens[seed].tolist()):
            df = sum(term in t for t in tokens)
            idf = np.log1p((50 - df + 0.5) / (df + 0.5))
            for i, t in enumerate(tokens):
                tf = (t == term).sum()
                want[i] += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(t) / size))
        assert np.allclose(index.scores(seed, 50), want) and np.allclose(index.scores(seed, 20), want[:20])


# Problem 9

ITEM = "at gondvale a badger buried 78 seeds before the shaky frost while hiawisth slept from a glass hut what did the crab group most likely gain from these two seasons"


def leaks(spark, texts, item=ITEM):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, item), (1, item), (2, "too short to leak"), (3, None)], "item_id bigint, text string")
    return {r["doc_id"] for r in leakage.leaked(docs, "doc_id", "text", items, "item_id", "text").collect()}


def test_leaks_whole_partial_and_altered(spark):
    w = ITEM.split()
    filler = "nothing of this kind is said here at all by anyone " * 5
    altered = list(w)
    altered[5], altered[20] = "changed", "other"
    dense = list(w[:18])
    dense[4] = dense[9] = dense[13] = "x"
    texts = [
        filler + ITEM.upper() + filler, filler + " ".join(w[5:23]) + ". " + filler, filler + " ".join(w[5:20]) + filler, " ".join(altered), " ".join(dense), "At Gondvale, a <b>bad</b>ger bur-\nied 78 seeds before the shaky frost while Hia&shy;wisth slept from a glass hut",
        filler, None, "", " ".join([*w[:9], "extra", *w[9:18]]), " ".join(w[:8] + w[9:19]), ITEM,
    ]
    assert leaks(spark, texts) == {0, 1, 3, 5, 9, 10, 11}
    assert leaks(spark, []) == set()


def test_items_in_several_blocks_and_passes(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(leakage, "PASS_BLOCKS", 2)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(7)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in items] + [(99, "nothing")], "doc_id bigint, text string")
    got = leakage.leaked(docs, "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text")
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(7)]
    named = spark.createDataFrame([(f"i{i}", t) for i, t in items], "name string, text string")
    got = leakage.leaked(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), "doc_id", "text", named, "name", "text")
    assert sorted(map(tuple, got.collect())) == [(f"d{i}", f"i{i}") for i in range(7)]


def test_long_items_are_searched_in_parts(spark):
    words = [f"w{k}" for k in range(1000)]
    index = leakage.LeakIndex([(1, " ".join(words)), (2, " ".join(words[:128])), (3, " ".join(words[:129]))])
    assert index.matrix.shape[1] == leakage.PART and index.items.count(2) == 1 and index.items.count(3) == 2
    parts = [(t[0], t[-1]) for t, i in zip(index.texts, index.items) if i == 1]  # words are numbered in their order
    assert all(any(a <= k and k + 34 <= b for a, b in parts) for k in range(1, 967))  # any 35 words in a row stand in one part
    docs = spark.createDataFrame([(k, "x " + " ".join(words[a : a + 18]) + " y") for k, a in enumerate((0, 90, 100, 500, 982))] + [(9, " ".join(words))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    assert sorted(r["doc_id"] for r in leakage.leaked(docs, "doc_id", "text", items, "item_id", "text").collect()) == [0, 1, 2, 3, 4, 9]


def test_dense_places():
    rng = np.random.default_rng(3)
    good, lengths = rng.random((400, 45)) < 0.85, rng.integers(18, 46, 400)

    def brute(row, n):
        return any(8 * (~row[a:b]).sum() <= b - a for a in range(n) for b in range(a + 18, n + 1))

    assert leakage.dense(good, lengths).tolist() == [brute(r, n) for r, n in zip(good, lengths)]


def test_verification_is_exact():
    rng = np.random.default_rng(0)
    item = np.arange(1, 41, dtype=np.int32)
    for _ in range(300):
        a, n = rng.integers(0, 20), rng.integers(14, 21)
        part = list(item[a : a + n])
        e = rng.integers(0, 4)
        for _ in range(e):
            k, op = rng.integers(0, len(part)), rng.integers(0, 3)
            if op == 0:
                part[k] = 0
            elif op == 1:
                part.insert(k, 0)
            else:
                del part[k]
        doc = np.array([0] * 10 + part + [0] * 10, np.int32)
        assert leakage.leaks(doc, item) == brute(doc, item)


def brute(doc, item):
    """Whether any stretch of 18 words or more is held with at most one edit in eight: all stretches, plain dynamic programming."""
    for a in range(len(item) - 17):
        row = np.zeros(len(doc) + 1, int)
        for i in range(a, len(item)):
            now = np.empty_like(row)
            now[0] = row[0] + 1
            now[1:] = np.minimum(row[:-1] + (doc != item[i]), row[1:] + 1)
            for j in range(1, len(now)):
                now[j] = min(now[j], now[j - 1] + 1)
            row = now
            size = i - a + 1
            if size >= 18 and row.min() * 8 <= size:
                return True
    return False


def test_recall_of_windows_two_edits_apart():
    rng = np.random.default_rng(1)
    index = leakage.LeakIndex([(i, " ".join(f"v{x}" for x in rng.integers(0, 400, 40))) for i in range(100)])
    a, b = [], []
    for _ in range(1000):
        t = index.texts[rng.integers(100)]
        o = rng.integers(len(t) - 17)
        one = list(t[o : o + 18])
        two = one + list(rng.integers(1, index.size - 1, 4))
        for _ in range(2):
            j, op = rng.integers(0, 17), rng.integers(3)
            if op == 0:
                two[j] = 0
            elif op == 1:
                del two[j]
            else:
                two.insert(j, 0)
        a.append(one)
        b.append(two[:18])
    x, y = (leakage.item_prints(np.array(z, np.int32), index.bits, index.places) for z in (a, b))
    assert (x == y).any(axis=1).mean() > 0.98


# Problem 10


def lexicon():
    from gradloom.llm.subject_terms import seeds

    return subjects.Lexicon({t: (s, 1.0) for t, s in seeds()}, 1.5)


def test_subjects_of_texts():
    of = lexicon().subjects
    law = "The plaintiff asked the tribunal for bail. The jury heard the affidavit. A verdict followed the testimony. "
    assert of(law) == ["law"]
    assert of(law + "He called the evening a quasar and left.") == ["law"]  # borrowed in passing
    assert of(law * 2 + "The comet passed the planet. The nebula hid the pulsar.") == ["astronomy", "law"]
    assert of(None) == of("") == of("Page not found.") == []
    assert of("Filed under: tariff, currency\n" + law) == ["law"]
    assert of("Die Sammlung mit Lernraten wurde um Tokenfolgen ergänzt.") == ["machine_learning"]
    quiz = "According to Ann, the larva and the tadpole differ. Which one has a membrane? A. The predator and its habitat B. Its hormone and its enzyme C. The genome D. The plankton\n"
    assert of(law + quiz) == ["law"]


def test_no_wording_takes_a_sentence_out():
    of = lexicon().shares
    for text in ("The crater was named after the comet. The nebula hid the pulsar.", "The clinic where the first vaccine was given stood there. The symptom came back with the tumor."):
        assert len(lexicon().scores(subjects.sentences(text))) == 2
    law = "The plaintiff asked the tribunal for bail. The jury heard the affidavit. A verdict followed the testimony. "
    for borrowed in ("He called the whole evening a quasar and left.", "They spoke of it as a quasar of a party."):
        assert of(law + borrowed) == {"law": 1.0}  # a lone word, however it is worded
    line = "Related to this, the plaintiff asked the tribunal for bail, and the jury heard the affidavit of the defendant before the verdict."
    assert of(line + "\n") == {"law": 1.0}


def test_recurring_lone_terms_count_from_a_fifth_on():
    strong, lone = "The plaintiff asked the tribunal. ", "The quasar rose. "
    assert lexicon().shares(strong * 7 + lone * 3) == {"law": 0.7, "astronomy": 0.3}
    assert lexicon().subjects(strong * 8 + lone * 2) == ["astronomy", "law"]
    assert lexicon().subjects(strong * 9 + lone * 2) == lexicon().subjects(strong * 4 + lone) == ["law"]


def test_many_question_marks_take_no_time():
    import time

    began = time.process_time()
    assert len(subjects.drop_questions("ab? " * 300_000)) == 1_200_000
    assert time.process_time() - began < 10
    assert subjects.drop_questions("It fell. Who saw it? Ann did. Is it?").split() == ["Ann", "did.", "Is", "it?"]


def test_longer_terms_count_once():
    scores = lexicon().scores(subjects.sentences("The gradient of the training loss fell."))
    assert scores == [{"machine_learning": 2.0}]


def test_subjects_of_a_table(spark):
    rows = [(1, "The plaintiff asked the tribunal for bail."), (2, None), (3, ""), (None, "The jury heard the affidavit."), (1, "The plaintiff asked the tribunal for bail."), (4, "A verdict and a tort. " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("subject", F.lit("clash"))
    labels = spark.createDataFrame([(1, "law", "a"), (None, "law", "a"), (4, None, "a")], "doc_id bigint, subject string, annotator string")
    fitted = subjects.fitted(docs, labels)
    assert sorted(tuple(r) for r in subjects.assigned(docs, fitted).collect()) == [(1, "law"), (4, "law")]
    assert subjects.assigned(docs.filter("false"), subjects.fitted(docs, labels.filter("false"))).count() == 0


def test_term_rarity_is_that_of_all_documents(spark):
    # the labelled document lacks "plaintiff", every other has it in each sentence, so by itself it is no rare term
    rows = [(1, "The jury heard the affidavit. A verdict followed.")] + [(i, "The plaintiff came back. Then the plaintiff left.") for i in range(2, 200)] + [(200, "The quasar rose.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, "law", "a")], "doc_id bigint, subject string, annotator string")
    lexicon = subjects.fitted(docs, labels)
    total = 2 * 199 + 1
    assert lexicon.terms["plaintiff"] == ("law", subjects.weigh("plaintiff", 2 * 198, total))
    assert lexicon.terms["quasar"] == ("astronomy", subjects.weigh("quasar", 1, total))
    assert lexicon.terms["plaintiff"][1] < subjects.THRESHOLDS[0] < lexicon.terms["quasar"][1]
    again = subjects.assigned_to_all(docs, labels)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, subjects.assigned(docs, lexicon).collect()))


def test_the_whole_sample_calibrates(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(subjects, "calibrated", lambda terms, labelled: seen.append(len(labelled)) or subjects.Lexicon(terms, 1.5))
    docs = spark.range(1100).selectExpr("id as doc_id", "'The jury heard the affidavit.' as text")
    subjects.fitted(docs, docs.selectExpr("doc_id", "'law' as subject"))
    assert seen == [1100]


def test_held_out_agreement(spark):
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/subject_labels.parquet")
    half = F.xxhash64("doc_id") % 2 == 0
    got = subjects.assigned(docs, subjects.fitted(docs, labels.filter(half)))
    held = labels.filter(~half).select("doc_id", "subject").distinct()
    hit = got.join(held, ["doc_id", "subject"], "left_semi").count()
    known = got.join(held.select("doc_id").distinct(), "doc_id", "left_semi").count()
    assert 2 * hit / (known + held.count()) > 0.95
