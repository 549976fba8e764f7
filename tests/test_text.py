import hashlib
import string

import pytest
from pyspark.sql import functions as F

from gradloom.functions import offline
from gradloom.functions import text as X


def one(spark, column, value=None):
    return spark.range(1).select(F.lit(value).cast("string").alias("t")).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("It adds up. Final answer: 8", 8), ("so #### 1,234", 1234), ("#### 5\nFinal answer: 8", 8), ("she lost $-50", -50), ("12,345 units", 12345), ("costs $19.99", 19.99),
        ("7 * 3 = 21. That's", 21), ("no number here", None), ("Final Answer: -12.5", -12.5), ("", None), (None, None), ("Final answer: 1 then Final answer: 2", 2),
    ],
)
def test_extract_number(spark, text, number):
    assert one(spark, X.extract_number(F.col("t")), text) == number


def test_words_and_strip_take_all_white_space(spark):
    assert one(spark, X.words(F.col("t")), " a b\x1cc\n　d ") == ["a", "b", "c", "d"]
    assert one(spark, X.words(F.col("t")), " \n ") == []
    assert one(spark, X.words(F.col("t")), None) is None
    assert one(spark, X.strip(F.col("t")), "  x y\n\t") == "x y"


@pytest.mark.parametrize(("text", "want"), [("one two three", ("one two", "three")), ("alone", ("", "alone")), ("a b \n", ("a", "b")), ("", ("", ""))])
def test_last_word(spark, text, want):
    context, target = X.last_word_split(F.col("t"))
    assert (one(spark, context, text), one(spark, target, text)) == want


def test_stops_and_punctuation(spark):
    assert one(spark, X.truncate_at(F.col("t"), ["Q:", "\n"]), "a b\nc Q: d") == "a b"
    assert one(spark, X.truncate_at(F.col("t"), []), "a") == one(spark, X.truncate_at(F.col("t"), None), "a") == "a"
    assert one(spark, X.strip_punctuation(F.col("t")), '"word!?') == "word"
    assert X.PUNCTUATION == string.punctuation


@pytest.mark.parametrize(("revision", "step"), [("main", 143000), ("step64000", 64000), ("xstep1", None), ("step", None), ("step1x", None), (None, None)])
def test_revision_step(spark, revision, step):
    assert one(spark, X.revision_step(F.col("t")), revision) == step


def test_argmax_takes_the_first_of_ties(spark):
    assert spark.sql("select array(1.0, 3.0, 3.0) a").select(X.argmax_first(F.col("a"))).first()[0] == 1


def test_draws_equal_sha256(spark):
    keys = [f"0|m|main|prompt {i}| A" for i in range(50)]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", offline.draw(F.col("k")).alias("d")).collect()
    assert all(r["d"] == int(hashlib.sha256(r["k"].encode()).hexdigest()[:16], 16) % 10_000 for r in rows)
