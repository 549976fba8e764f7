"""Texts cut off before their end, by word trigrams inside texts and at ends, in SQL (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: A final gram is judged by its own counts once it was seen this often beyond this text's
#: end, else by a shorter one; it is cut off if at most this share of its uses end something.
LEAST_SEEN = 3
END_SHARE = 0.2
#: The share for a text that is as long as it was allowed to be.
LIMIT_SHARE = 0.25
#: A word seen inside texts this often and at ends in less than this share ends no text, whatever its trigram.
OFTEN_INSIDE = 200
NEVER_SHARE = 0.02
#: A last word is the beginning of another if that one follows the same two words this many times as often.
PREFIX_TIMES = 3
#: or, after whatever words, if that one is used this many times as often.
PREFIX_TIMES_ALONE = 200

#: Capitalised words within a sentence or after a colon stand for names, numbers for numbers.
_NAME = r"(?=\p{Lu})(?<=[\p{L},;:)] )\p{Lu}(?:\p{Ll}[\p{L}\p{M}]*|$)"
_NUMBER = r"-?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand"
).split()
#: Tokens: words with inner hyphens or apostrophes, numbers, runs of one mark, single marks, line ends.
_TOKENS = r"(\p{L}[\p{L}\p{M}]*+(?:['’-]\p{L}++)*+|#+|\*+|`+|=+|\.+|\n|[^\s\p{L}])"
#: Marks that only a broken value leaves: of a cut, half a character, half an escape, a note of cutting, half a hyphenated word.
_BROKEN = r"(…|\p{L}-|\.\.+|�|\\u?[0-9a-fA-F]{0,3}|\[\s*\w*|\[\s*(trunc|cut|\.\.\.)[^\]]*\]?)\s*$"
#: Characters at a text's end in which a note of cutting lies.
NOTE = 200
#: Tokens that end a sentence, and those that may follow them.
_STOPS = "('.', '!', '?', '。', '！', '？')"
_CLOSERS = r"""('\'', '"', '”', '’', '»', ')', ']', '}}', '*', '**', '***', '_', '`', '``', '```', '$')"""
#: A gram from its three tokens: whether it closes a sentence.
_CLOSES = f"w IN {_STOPS} OR w IN {_CLOSERS} AND (b IN {_STOPS} OR b IN {_CLOSERS} AND a IN {_STOPS})"


def tokens(texts: DataFrame) -> DataFrame:
    """``id, t, broken, at_limit``: the masked tokens of each text after two start marks; whether a mark of breaking or an open block shows that it
    is cut; whether it is as long as it was allowed to be. Blank texts have no tokens of their own."""
    body = F.rtrim("text", F.lit("\t\r\n "))
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"[^\S\n]*+\n\s*+", "\n"), _NAME, "Xname"), _NUMBER, "0")
    # Number words in lower case only: a sentence that begins with one is no number. Several dots are one.
    one = lambda w: F.when(w.isin(*NUMBER_WORDS), "0").when(w.startswith("."), ".").otherwise(F.lower(w))
    fences = F.regexp_count("text", F.lit("```")) % 2 == 1
    words = F.transform(F.regexp_extract_all(masked, F.lit(_TOKENS), 1), one)
    limit = F.col("at_limit") if "at_limit" in texts.columns else F.lit(False)
    return texts.select("id", F.concat(F.array(F.lit("^"), F.lit("^")), words).alias("t"), (fences | F.right(body, F.lit(NOTE)).rlike(_BROKEN)).alias("broken"), limit.alias("at_limit"))


def gram_counts(toks: DataFrame) -> DataFrame:
    """``n, before, word, inside, at_end``: how often each gram of 1 to 3 tokens, the last being ``word``, is followed by something or ends a text, a line or a sentence.

    A text counts once for a trigram however often it repeats it, else a text that runs in a loop would decide. Only trigrams leave the texts;
    the shorter grams are summed up from their counts, which partial aggregation has shrunk by then.
    """
    sql = """
    WITH at AS (
      SELECT explode(array_distinct(transform(sequence(3, size(t)), i -> concat_ws('\x1f', get(t, i - 3), get(t, i - 2), get(t, i - 1), coalesce(get(t, i), '\n') = '\n')))) AS g
      FROM {toks} WHERE size(t) > 2),
    once AS (SELECT g, count(*) AS k FROM at GROUP BY g),
    parted AS (SELECT split(g, '\x1f') AS p, k FROM once),
    named AS (SELECT p[0] AS a, p[1] AS b, p[2] AS w, p[3] = 'true' AS last, k FROM parted WHERE p[2] <> '\n'),
    judged AS (SELECT a, b, w, CASE WHEN last OR CLOSES THEN k ELSE 0 END AS e, k FROM named),
    summed AS (
      SELECT a, b, w, sum(k - e) AS inside, sum(e) AS at_end, grouping(a) + grouping(b) AS lack FROM judged
      GROUP BY GROUPING SETS ((a, b, w), (b, w), (w)))
    SELECT int(3 - lack) AS n, CASE lack WHEN 0 THEN concat(a, ' ', b) WHEN 1 THEN b ELSE '' END AS before, w AS word, inside, at_end FROM summed
    """.replace("CLOSES", f"({_CLOSES})")
    return toks.sparkSession.sql(sql, toks=toks)


def cut_off(texts: DataFrame) -> DataFrame:
    """``id, cut, evidence``: whether each text breaks off and what says so. ``texts``: ``id, text`` and, if known, ``at_limit``; each row one text.

    Every text is judged by its final trigram: it is cut if the trigram is frequent inside texts but almost never ends a text, a line or a
    sentence; a trigram seen too rarely leaves it to the last two words, then to the last one (evidence ``3, 2, 1``). A last
    word that is the beginning of a word usual after the two before it, or of a far more usual one, was cut inside (``begun``); so was one
    seen nowhere else (``0``). Of a text as long as its limit most uses of its gram must be ends. Marks that only a broken value leaves and
    open blocks come first (``mark``). Null and blank texts are not cut (``blank``). Counts run over all texts.
    """
    spark = texts.sparkSession
    toks = materialise(tokens(texts), "truncation-tokens")
    counts = materialise(gram_counts(toks), "truncation-grams")
    own = toks.filter("size(t) > 2 and not broken").selectExpr("id", "at_limit", "get(t, size(t) - 3) AS a", "get(t, size(t) - 2) AS b", "get(t, size(t) - 1) AS w")
    tails = own.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).selectExpr(
        "id", "at_limit", f"({_CLOSES.replace('}}', '}')}) AS closed", "n", "CASE n WHEN 3 THEN concat(a, ' ', b) WHEN 2 THEN b ELSE '' END AS before", "w AS word"
    )
    # Each gram that ends a text is judged once, however many texts it ends; only their contexts' words are taken apart.
    grams = spark.sql(
        """
        WITH asked AS (SELECT DISTINCT n, before, word FROM {tails}),
        own AS (SELECT c.n, c.before, c.word, c.inside, c.at_end FROM asked JOIN {counts} c ON asked.n = c.n AND asked.before = c.before AND asked.word = c.word),
        context AS (SELECT DISTINCT n, before FROM asked WHERE n <> 2),
        usual AS (
          SELECT c.n, c.before, left(c.word, p) AS word, max(c.inside + c.at_end) AS uses
          FROM {counts} c LEFT SEMI JOIN context x ON c.n = x.n AND c.before = x.before LATERAL VIEW explode(sequence(1, length(c.word) - 1)) AS p
          WHERE length(c.word) > 1 AND c.inside + c.at_end >= {times} GROUP BY c.n, c.before, left(c.word, p)),
        number AS (
          SELECT DISTINCT 1 AS n, '' AS before, left(w, p) AS word, (SELECT max(inside + at_end) FROM {counts} WHERE n = 1 AND word = '0') AS uses
          FROM (SELECT explode(split('{numbers}', ' ')) AS w) LATERAL VIEW explode(sequence(1, length(w) - 1)) AS p),
        longer AS (SELECT n, before, word, max(uses) AS uses FROM (SELECT * FROM usual UNION ALL SELECT * FROM number) GROUP BY n, before, word)
        SELECT o.n, o.before, o.word, o.inside, o.at_end,
               l.uses >= CASE WHEN o.n = 3 THEN {times} ELSE {alone} END * (o.inside + o.at_end) AS begins,
               o.n = 1 AND o.inside >= {times} * o.at_end AS whole
        FROM own o LEFT JOIN longer l ON o.n = l.n AND o.before = l.before AND o.word = l.word
        """.replace("{times}", str(PREFIX_TIMES)).replace("{alone}", str(PREFIX_TIMES_ALONE)).replace("{numbers}", " ".join(NUMBER_WORDS)),
        tails=tails,
        counts=counts,
    )
    return spark.sql(
        """
        WITH judged AS (
          SELECT t.id, t.n, t.at_limit, t.closed, g.inside, g.at_end - 1 AS at_end, g.inside + g.at_end - 1 >= {least} AS seen, (g.at_end - 1) / nullif(g.inside + g.at_end - 1, 0) AS share, coalesce(g.begins, false) AS begins, g.whole
          FROM {tails} t JOIN {grams} g ON t.n = g.n AND t.before = g.before AND t.word = g.word),
        summed AS (
          SELECT id, max(CASE WHEN n = 3 AND seen THEN share END) AS s3, max(CASE WHEN n = 2 AND seen THEN share END) AS s2, max(CASE WHEN n = 1 AND seen THEN share END) AS s1, bool_or(begins) AND NOT bool_or(whole) AND NOT bool_or(closed) AS begun,
                 bool_or(n = 1 AND inside >= {often} AND at_end < {never} * inside) AND NOT bool_or(closed) AS never, bool_or(at_limit) AS at_limit
          FROM judged GROUP BY id),
        shown AS (SELECT *, coalesce(s3, s2, s1) < CASE WHEN at_limit THEN {bound} ELSE {share} END AS rare, CASE WHEN s3 IS NOT NULL THEN '3' WHEN s2 IS NOT NULL THEN '2' WHEN s1 IS NOT NULL THEN '1' END AS by FROM summed),
        said AS (
          SELECT id, coalesce(rare, true) OR begun OR never AS cut,
                 CASE WHEN rare THEN by WHEN begun THEN 'begun' WHEN never THEN '1' ELSE coalesce(by, '0') END AS evidence
          FROM shown)
        SELECT id, cut, evidence FROM said UNION ALL
        SELECT id, coalesce(broken, false) AS cut, CASE WHEN broken THEN 'mark' ELSE 'blank' END AS evidence FROM {toks} WHERE broken OR coalesce(size(t), 0) <= 2
        """.replace("{often}", str(OFTEN_INSIDE)).replace("{never}", str(NEVER_SHARE)).replace("{least}", str(LEAST_SEEN)).replace("{share}", str(END_SHARE)).replace("{bound}", str(LIMIT_SHARE)),
        tails=tails,
        grams=grams,
        toks=toks,
    )


def generations(predictions: DataFrame) -> DataFrame:
    """``request_hash, model_id, generation, broken, limit_tokens``; ``broken``: the payload holds a generation but does not parse.

    ``generation`` is null for those and for payloads of other kinds; ``limit_tokens`` is the request's ``gen_params.max_new_tokens``, null if it
    isn't known. A row for each row given.
    """
    schema = "generation string, _bad string"
    parsed = F.from_json(
        "payload_json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "true"}
    )
    limit = F.col("gen_params.max_new_tokens") if "gen_params" in predictions.columns else F.lit(None).cast("int")
    rows = predictions.select("request_hash", "model_id", "payload_json", parsed.alias("p"), limit.alias("limit_tokens"))
    bad = F.coalesce(F.col("p._bad").isNotNull() & F.col("payload_json").rlike(r'"generation"\s*:\s*"'), F.lit(False))
    return rows.select("request_hash", "model_id", F.when(~bad, F.col("p.generation")).alias("generation"), bad.alias("broken"), "limit_tokens")


def truncated(predictions: DataFrame) -> DataFrame:
    """``request_hash, model_id, cut, evidence`` for every non-empty or broken generation; a request sent again counts once.

    A request with several stored values is cut if one of them is. Equal generations are judged once; only their digests are joined back.
    A token of the limit is a word between white space.
    """
    gens = generations(predictions).filter("request_hash is not null and (broken or trim(generation) <> '')").withColumn("id", F.unhex(F.md5("generation")))
    whole = gens.filter("not broken")
    n_words = F.size(F.split(F.trim("generation"), r"\s+"))
    texts = whole.groupBy(F.col("generation").alias("text")).agg(F.coalesce(F.max(n_words >= F.col("limit_tokens")), F.lit(False)).alias("at_limit"))
    texts = texts.withColumn("id", F.unhex(F.md5("text")))
    # A broken payload has no text and hence no digest; it is cut by itself.
    asked = gens.select("request_hash", "model_id", "id").distinct()
    judged = asked.join(cut_off(texts), "id", "left").select("request_hash", "model_id", F.coalesce("cut", F.lit(True)).alias("cut"), F.coalesce("evidence", F.lit("mark")).alias("evidence"))
    return judged.groupBy("request_hash", "model_id").agg(F.max("cut").alias("cut"), F.max_by("evidence", "cut").alias("evidence"))
