"""SQL, for DuckDB, of the training-data queries that SQL can express over whole tables."""


def _leaf(x: str) -> str:
    """The normal form of a string, without look-around: signs and points that belong to numbers are marked before punctuation goes."""
    minus = f"regexp_replace(regexp_replace(lower(replace({x}, chr(8722), '-')), '([\\p{{L}}\\p{{N}}])-', '\\1 ', 'g'), '-(\\.?\\p{{Nd}})', chr(1) || '\\1', 'g')"
    point = f"regexp_replace(regexp_replace({minus}, '(^|[^\\p{{L}}])\\.(\\p{{Nd}})', '\\1' || chr(2) || '\\2', 'g'), '(^|[^\\p{{L}}])\\.(\\p{{Nd}})', '\\1' || chr(2) || '\\2', 'g')"
    return f"regexp_replace({point}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\x01\\x02]|[\\x{{FE00}}-\\x{{FE0F}}\\x{{34F}}\\x{{115F}}\\x{{1160}}\\x{{3164}}]', '', 'g')"


_RECORDS = f"""n AS (SELECT row_no, {_leaf('payload.question')} AS q, list_transform(payload.choices, lambda c: {_leaf('c')}) AS c, payload.answer_index AS a, {_leaf('payload.subject')} AS s
  FROM mmlu WHERE payload.question IS NOT NULL),
 g AS (SELECT row_no, min(row_no) OVER (PARTITION BY q, c, a, s) AS first_row_no, count(*) OVER (PARTITION BY q, c, a, s) AS copies FROM n)"""
_ALL = " UNION ALL ".join(f"SELECT dataset, split, example_id, added_at FROM {t}" for t in ("arc_easy", "mmlu", "gsm8k", "wikitext"))

_GROWTH_CUTS = ("2024-03-01", "2024-08-01", "2100-01-01")


def _growth() -> str:
    """The ledger replayed: each step keeps what is chosen and fills a tenth of what has arrived from unseen keys of lowest hash."""
    ctes = [
        f"""k AS (SELECT dataset, split, example_id, coalesce(min(added_at), TIMESTAMPTZ '1970-01-01 00:00:00+00') AS arrival,
          sha256(dataset || '|' || split || '|0|0|' || example_id) AS p FROM ({_ALL}) WHERE example_id IS NOT NULL AND dataset IS NOT NULL AND split IS NOT NULL GROUP BY ALL)""",
        "c0 AS (SELECT dataset, split, example_id, 0 AS version FROM k WHERE false)",
    ]
    for i, cut in enumerate(_GROWTH_CUTS, 1):
        ctes.append(
            f"""c{i} AS (SELECT * FROM c{i - 1} UNION ALL SELECT dataset, split, example_id, {i} AS version FROM (
          SELECT k.*, row_number() OVER (PARTITION BY dataset, split ORDER BY p, example_id) AS r, q, h
          FROM (SELECT * FROM k WHERE arrival <= TIMESTAMPTZ '{cut} 00:00:00+00') k
          JOIN (SELECT dataset, split, ceil(count(*) * 10 / 100.0) AS q FROM k WHERE arrival <= TIMESTAMPTZ '{cut} 00:00:00+00' GROUP BY ALL) USING (dataset, split)
          LEFT JOIN (SELECT dataset, split, count(*) AS h FROM c{i - 1} GROUP BY ALL) USING (dataset, split)
          WHERE NOT EXISTS (SELECT 1 FROM c{i - 1} x WHERE x.dataset = k.dataset AND x.split = k.split AND x.example_id = k.example_id)) WHERE r <= q - coalesce(h, 0))"""
        )
    return f"WITH {', '.join(ctes)} SELECT dataset, split, example_id, version FROM c{len(_GROWTH_CUTS)}"


def _part_hosts() -> str:
    """Rates of the rules on sentences and paragraphs by model, shrunk by a beta prior fitted by moments."""
    parts = "list_filter(list_transform(regexp_split_to_array(lower(generation), '{p}'), lambda x: trim(regexp_replace(x, '[^\\p{{L}}]+', ' ', 'g'))), lambda x: x <> '')"
    letters = "coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    one = "SELECT model_id, '{r}' AS rule, {parts} AS parts FROM g"
    both = " UNION ALL ".join(one.format(r=r, parts=parts.format(p=p)) for r, p in (("sentences", "[.!?\\n]+"), ("paragraphs", "\\n+")))
    return f"""WITH g AS (SELECT DISTINCT request_hash, model_id, json_extract_string(payload_json, '$.generation') AS generation FROM predictions
          WHERE request_hash IS NOT NULL AND json_valid(payload_json) AND json_extract_string(payload_json, '$.generation') IS NOT NULL),
        e AS ({both}),
        f AS (SELECT model_id, rule, CASE WHEN {letters.format(x='parts')} > 0
          THEN 1 - {letters.format(x='list_distinct(parts)')} / {letters.format(x='parts')}::DOUBLE ELSE 0 END >= 0.35 AS fails FROM e),
        h AS (SELECT model_id, rule, count(*) AS n_docs, sum(fails::INT)::BIGINT AS n_failed FROM f GROUP BY ALL),
        m AS (SELECT rule, sum(n_failed) / sum(n_docs)::DOUBLE AS mean, sum(n_docs * pow(n_failed / n_docs::DOUBLE, 2)) / sum(n_docs) AS square, count(*) / sum(1 / n_docs::DOUBLE) AS typical FROM h GROUP BY rule),
        w AS (SELECT rule, mean, greatest(mean * (1 - mean) / greatest(square - mean * mean - mean * (1 - mean) / typical, 1e-6) - 1, 1.0) AS weight FROM m),
        r AS (SELECT model_id, rule, n_docs, n_failed, round((n_failed + mean * weight) / (n_docs + weight), 6) AS rate, mean FROM h JOIN w USING (rule))
        SELECT model_id, rule, n_docs, n_failed, rate, rate > round(2 * mean, 6) AS bad_host FROM r"""


_SQUEEZED = "lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '{by}', 'g'))"
#: Pairs of one choice set; the words of a pair are numbered and written as single characters, so that a distance of characters is one of words.
_OVERLAP = f"""q AS (SELECT DISTINCT example_id, split, list_filter(string_split({_SQUEEZED.format(x='payload.question', by=' ')}, ' '), lambda w: w <> '') AS w,
          list_sort(list_distinct(list_transform(payload.choices, lambda c: {_SQUEEZED.format(x='c', by='')}))) AS g
          FROM arc_easy WHERE example_id IS NOT NULL AND split IN ('train', 'test', 'validation') AND payload.question IS NOT NULL AND payload.choices IS NOT NULL
            AND NOT list_contains(list_transform(payload.choices, lambda c: c IS NULL), true)),
        p AS (SELECT t.example_id AS a, e.example_id AS b, e.split, t.w AS x, e.w AS y, list_distinct(list_concat(t.w, e.w)) AS v, greatest(len(t.w), len(e.w)) AS n
          FROM q t JOIN q e ON t.g = e.g AND t.split = 'train' AND e.split <> 'train' AND abs(len(t.w) - len(e.w)) <= greatest(len(t.w), len(e.w)) // 5),
        o AS (SELECT DISTINCT a, b, split FROM p WHERE x = y OR n >= 5 AND levenshtein(array_to_string(list_transform(x, lambda w: chr((39 + list_position(v, w))::INT)), ''),
          array_to_string(list_transform(y, lambda w: chr((39 + list_position(v, w))::INT)), '')) <= n // 5)"""

ORACLE = {
    "p7_rebuilt": """SELECT DISTINCT 'wikitext' AS source_table, '' AS run_id, example_id, sha256(payload.text) AS digest FROM wikitext WHERE length(payload.text) > 4000
        UNION SELECT DISTINCT 'example_results', run_id, example_id, sha256(detail_json) FROM example_results WHERE length(detail_json) > 4000""",
    "p8_bytes": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0",
    "p1_part_hosts": _part_hosts(),
    "p4_found": f"WITH {_OVERLAP} SELECT DISTINCT least(a, b) AS example_id_a, greatest(a, b) AS example_id_b FROM o",
    "p4_counts": f"""WITH {_OVERLAP} SELECT split, regexp_extract(b, '^[^-]*-(.*)_\\d+$', 1) AS source, count(*) AS n_pairs FROM o GROUP BY ALL""",
    "p5_growth": _growth(),
    "p2_found": f"WITH {_RECORDS} SELECT first_row_no, row_no FROM g WHERE row_no <> first_row_no",
    "p2_records": f"WITH {_RECORDS} SELECT DISTINCT first_row_no, copies FROM g",
    "p5_sample": f"""WITH asked AS (SELECT DISTINCT sweep_id, t.dataset AS dataset, t.split AS split, quota, coalesce(seed, 0) AS seed
          FROM (SELECT sweep_id, spec."limit" AS quota, spec.seed AS seed, unnest(spec.targets) AS t FROM sweep_specs)),
        keys AS (SELECT dataset, split, example_id, min(added_at) AS arrival FROM ({_ALL}) WHERE example_id IS NOT NULL GROUP BY ALL),
        ranked AS (SELECT dataset, split, seed, example_id, row_number() OVER (PARTITION BY dataset, split, seed
            ORDER BY coalesce(arrival, TIMESTAMPTZ '1970-01-01 00:00:00+00'), sha256(dataset || '|' || split || '|' || seed || '|' || seed || '|' || example_id), example_id) AS r
          FROM keys JOIN (SELECT DISTINCT dataset, split, seed FROM asked) USING (dataset, split))
        SELECT sweep_id, dataset, split, example_id FROM asked JOIN ranked USING (dataset, split, seed) WHERE quota IS NULL OR r <= quota""",
    "p7_found": """
        SELECT DISTINCT 'wikitext' AS source_table, '' AS run_id, example_id FROM wikitext WHERE length(payload.text) > 4000
        UNION
        SELECT DISTINCT 'example_results', run_id, example_id FROM example_results WHERE length(detail_json) > 4000""",
}
