import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradloom.llm import merkle, repetition, splitting, truncation

# Problem 1


@pytest.mark.parametrize(
    ("text", "share"),
    [
        (None, None), ("", 0.0), ("   \n", 0.0), ("one two three four five", 0.0),
        ("a b c d a b c d", 0.5), ("A, b c d! a B (c) D", 0.5),
        ("ha" * 20, 1.0), ("the the the the the the the the", 1.0),
    ],
)
def test_repeated_share(text, share):
    assert repetition.repeated_share(text) == (share if share is None else pytest.approx(share))


def test_numbers_case_and_punctuation_dont_hide_repeats():
    assert repetition.repeated_share("It costs 22 coins as stated. it COSTS 7 coins, as stated!") > 0.45
    assert repetition.repeated_share("one two three. four one two three five") == 0.0  # three words are no repeat


def test_a_long_chain_counts_whole_and_long_texts_are_linear():
    assert repetition.repeated_share("begin " + "=-" * 50) > 0.9
    assert repetition.repeated_share("word " * 200_000) > 0.99


def test_chains_are_found_in_whole_batches():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", "xyz" * 5, "xyz" * 4, "0123456789abcdef" * 5, "0123456789abcdefg" * 5, "aaaa", "aaaaa"]
    may = repetition.with_chains(texts)
    for text, flag in zip(texts, may):
        assert flag or repetition._CHAIN.search(text) is None
        assert repetition.repeated_share(text, bool(flag)) == repetition.repeated_share(text)
    assert not may[-2] and not may[-3] and not may[-5] and may[-1] and may[-4] and may[-6]
    assert not repetition.with_chains([]).size


def test_failing_documents_come_through_their_hosts(spark, capsys):
    rows = [(f"b{i}", "bad", "again and again the same " * 5) for i in range(3)] + [("g", "good", "nothing is said twice in here")] + [("n", None, "round and round it goes " * 4)]
    docs = spark.createDataFrame(rows, "id string, h string, text string")
    found = repetition.failing(docs, "id", "text", "h")
    assert {r["doc_id"] for r in found.collect()} == {"b0", "b1", "b2", "n"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan or "Join LeftOuter" in plan
    assert repetition.failing(docs.filter("false"), "id", "text", "h").count() == 0


def test_sentences_and_paragraphs(spark):
    texts = [None, "", "123", "One thing. One thing! Another.", "same line\nsame line\nother", "a b. c d\nA B. C, D"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select(repetition.repeated_parts(F.col("t"), repetition.SENTENCE_ENDS), repetition.repeated_parts(F.col("t"), repetition.PARAGRAPH_ENDS)).collect()
    want = [(None, None), (0, 0), (0, 0), (9 / 25, 0), (9 / 23, 9 / 23), (0.5, 0.5)]
    assert [tuple(r) for r in got] == [tuple(x if x is None else pytest.approx(x) for x in w) for w in want]


def test_hosts_are_shrunk_and_joined_back(spark):
    rows = [(f"g{i}", "good", f"text number {i} is of its own kind and says nothing twice") for i in range(40)]
    rows += [(f"b{i}", "bad", "again and again the same " * 5) for i in range(20)] + [("n", None, "a lone one"), ("x", "good", None), ("g0", "good", rows[0][2])]
    docs = spark.createDataFrame(rows, "id string, host_name string, text string").withColumn("repeated", F.lit("clash"))
    got = {r["doc_id"]: r for r in repetition.repetition(docs, "id", "text", "host_name").collect()}
    assert len(got) == 62 and got["b0"]["fails"] and got["b0"]["bad_host"] and not got["g0"]["bad_host"] and got["x"]["fails"] is None
    assert 0 < got["n"]["host_rate"] < got["b0"]["host_rate"] < 1
    assert repetition.repetition(docs.filter("false"), "id", "text", "host_name").count() == 0


# Problem 2

RECORD = "row_no bigint, payload struct<question: string, choices: array<string>, answer_index: int, subject: string>"


def copies(spark, rows):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], RECORD).withColumn("_root", F.lit("clash"))
    return sorted(tuple(r) for r in merkle.surplus_copies(frame, "payload", "row_no").collect())


def test_looks_dont_matter_numbers_do(spark):
    base = ("Is -2.5 less than 3?", ["Yes, it is", "No"], 0, "mathematics")
    rows = [
        base, ("is  -2.5 LESS, than 3", ["yes it is.", "* no"], 0, "Mathematics"), ("Is​ -2.5 less\xa0than 3？", ["Yes it is", "“No”"], 0, "mathematics"),
        ("Is 2.5 less than 3?", ["Yes, it is", "No"], 0, "mathematics"), ("Is -25 less than 3?", ["Yes, it is", "No"], 0, "mathematics"),
        ("Is -2.5 less than 3?", ["No", "Yes, it is"], 0, "mathematics"), ("Is -2.5 less than 3?", ["Yes, it is", "No"], 1, "mathematics"), base,
        ("Is −2.5 less than 3 -", ["Yes, it is", "No"], 0, "mathematics"),
    ]
    assert copies(spark, rows) == [(0, 1), (0, 2), (0, 7), (0, 8)]


def test_nulls_empty_and_many_copies(spark):
    assert copies(spark, []) == []
    assert copies(spark, [("q", None, None, None), ("Q", None, None, None), ("q", [], None, None), ("q", [None], None, None)]) == [(0, 1)]
    frame = spark.range(3000).select(F.col("id").alias("row_no"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("payload"))
    assert merkle.surplus_copies(frame, "payload", "row_no").count() == 999
    assert {r["copies"] for r in merkle.collapse(frame, "payload", "row_no").collect()} == {1, 1000}


def test_field_order_is_of_no_account(spark):
    a = spark.sql("select 1 as row_no, named_struct('a', 'X', 'b', 'y') as payload")
    b = spark.sql("select 1 as row_no, named_struct('b', 'Y.', 'a', 'x') as payload")
    assert merkle.with_root(a, "payload").first()["_root"] == merkle.with_root(b, "payload").first()["_root"]


# Problem 6


def cut(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r["id"]: r["cut"] for r in truncation.cut_off(rows).collect()}


def corpus(n=60):
    rng = random.Random(3)
    return [f"We count {rng.randint(2, 99)} boxes in the hall. Then we add {rng.randint(2, 99)} more boxes to them. Final answer: {rng.randint(2, 99)}" for _ in range(n)]


def test_ends_by_their_trigrams(spark):
    texts = corpus() + [
        "We count 3 boxes in the", "We count 3 boxes in the hall. Then we ad", "We count 5 boxes in the hall.", "Final answer: 12\n", "", None, "Then we add 3 more box…", "Then we add 3 more boxes to [trunc",
        "We count 3 boxes in the hall. ```\nx: 1", "We count 3 boxes, ", "Then we add 3 more", "word",
    ]
    got = cut(spark, texts)
    n = 60
    assert not any(got[i] for i in range(n))
    assert [got[n + i] for i in range(11)] == [True, True, False, False, False, False, True, True, True, True, True]


def test_long_text_and_empty_table(spark):
    assert cut(spark, []) == {}
    got = cut(spark, [*corpus(20), "We count 3 boxes in the hall. " * 20_000 + "Then we add 3 more"])
    assert got[20] is True


def payload(generation):
    return json.dumps({"logliks": None, "token_nlls": None, "generation": generation, "n_bytes": None, "is_greedy_matches": None})


def test_every_text_says_what_judged_it(spark):
    texts = [*corpus(), "We count 3 boxes in the", "We count 3 boxes in the hall. Then we ad", "Final answer: 12", "cut…", "", "The end was cal-"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (r["cut"], r["evidence"]) for r in truncation.cut_off(rows).collect()}
    assert [got[60 + i] for i in range(6)] == [(True, "3"), (True, "begun"), (False, "3"), (True, "mark"), (False, "blank"), (True, "mark")]


def test_a_text_at_its_limit_must_end_more_often(spark):
    # the words end a text in a fifth of their uses and more, but in less than a quarter
    texts = ["so we go on and on"] * 0 + [f"w{i} so we stop here and add {i} more" for i in range(14)] + [f"v{i} x{i} y{i} so we stop here" for i in range(4)]
    rows = spark.createDataFrame([(i, t, limited) for i, t in enumerate(texts) for limited in [i == 17]], "id int, text string, at_limit boolean")
    got = {r["id"]: r["cut"] for r in truncation.cut_off(rows).collect()}
    assert (3 / 17 < truncation.END_SHARE) == got[16] and got[17]


def test_requests(spark):
    rows = [(f"r{i}", "m", payload(t)) for i, t in enumerate(corpus(30))] * 2
    rows += [("cut", "m", payload("We count 3 boxes in the")), ("broken", "m", payload("We count 3 boxes.")[:70]), ("none", "m", payload(None)), ("empty", "m", payload("")), ("lik", "m", '{"logliks": [1.0, 2'), (None, "m", payload("x")), ("nul", "m", None)]
    frame = spark.createDataFrame(rows, "request_hash string, model_id string, payload_json string").withColumn("text", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = {r["request_hash"]: r["cut"] for r in truncation.truncated(frame).collect()}
    assert {k for k, v in got.items() if v} == {"cut", "broken"} and len(got) == 32


# Problem 7


def check_pieces(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in pieces)
    assert (pieces[0][0], pieces[-1][1]) == (0, len(text))
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= overlap
    rebuilt = "".join(text[max(a, pieces[i - 1][1] if i else 0) : b] for i, (a, b) in enumerate(pieces))
    assert rebuilt == text
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n=,é", min_size=1, max_size=400), st.integers(5, 60), st.data())
def test_pieces_round_trip(text, limit, data):
    check_pieces(text, limit, data.draw(st.integers(0, limit - 1)))


def test_cuts_at_natural_places():
    text = "\n\n".join(f"Paragraph {i} begins here. " + "It goes on. " * 30 for i in range(20))
    for a, b in check_pieces(text, 1000, 100)[:-1]:
        assert text[:b].endswith("\n\n") or text[:b].endswith(". ")
    assert splitting.split_text("", 10, 2) == [] and splitting.split_text("short", 10, 2) == [(0, 5)]
    assert len(check_pieces("x" * 100_000, 4000, 200)) == 27
    with pytest.raises(ValueError):
        splitting.split_text("x", 10, 10)


def test_items(spark):
    wiki = spark.createDataFrame([("w1", ("a b. " * 1500,)), ("w1", ("a b. " * 1500,)), ("w2", ("short",)), ("w3", (None,)), ("w4", ("",))], "example_id string, payload struct<text: string>").withColumn("piece", F.lit("clash"))
    res = spark.createDataFrame([("r", "e", '{"l": [' + ", ".join(["1.5"] * 2000) + "]}"), ("r", "f", None)], "run_id string, example_id string, detail_json string")
    items = splitting.oversized(wiki, res)
    pieces = splitting.split_items(items, "text").collect()
    assert {(r["source_table"], r["run_id"], r["example_id"]) for r in pieces} == {("wikitext", "", "w1"), ("example_results", "r", "e")}
    assert all(len(r["piece"]) <= 4000 for r in pieces)
    assert splitting.split_items(items.filter("false"), "text").count() == 0
