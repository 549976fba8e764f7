"""The queries of :mod:`.queries` in SQL, for DuckDB on the same tables."""

from __future__ import annotations

from .functions.text import PUNCTUATION

_SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PUNCT = PUNCTUATION.replace("'", "''")


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SP}+'), lambda w: w <> '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{_SP}+$', '')"


def _draw(*parts: str) -> str:
    key = " || '|' || ".join(("'0|offline-7|main'", *parts))
    return f"(('0x' || left(sha256({key}), 16))::UBIGINT % 10000)::BIGINT"


def _ln2(x: str) -> str:
    return f"({x}) / 0.6931471805599453"


def _bpb(units: str, size: str) -> str:
    return f"CASE WHEN {size} > 0 THEN {_ln2(f'{units} / 10000.0::DOUBLE')} / {size} ELSE 0.0 END"


_DOCS = f"d AS (SELECT doc_id, lang, strlen(text) AS n_bytes, {_words('text')} AS w FROM documents WHERE text IS NOT NULL)"
_SPANS = f"""{_DOCS},
 s AS (SELECT doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
 a AS (SELECT doc_id, w, n, unnest(range(0, CASE WHEN n <= 64 THEN 1 ELSE 1 + ceil((n - 64) / 32.0)::INT END)) AS k FROM s),
 b AS (SELECT *, k * 32 AS start, least(k * 32 + 64, n) AS e, CASE WHEN k = 0 THEN 0 ELSE least((k - 1) * 32 + 64, n) END AS p FROM a),
 spans AS (SELECT doc_id, w, k, start, greatest(p - start, 0) AS c, e - start - greatest(p - start, 0) AS m FROM b
           WHERE start < n AND e - start - greatest(p - start, 0) > 0)"""
_TOTALS = f"""{_SPANS},
 x AS (SELECT doc_id, array_to_string(w[start + 1 : start + c], ' ') AS ctx, array_to_string(w[start + c + 1 : start + c + m], ' ') AS txt, w[start + c + 1 : start + c + m] AS ws FROM spans),
 y AS (SELECT doc_id, ctx, txt, unnest(ws) AS tok, unnest(range(len(ws))) AS i FROM x),
 z AS (SELECT doc_id, sum(5000 + 4 * {_draw('ctx', 'txt', 'tok', 'i')})::BIGINT AS units, count(*) AS n_tok FROM y GROUP BY doc_id),
 t AS (SELECT d.doc_id, d.lang, coalesce(units, 0) AS units, coalesce(n_tok, 0) AS n_tok, n_bytes FROM d LEFT JOIN z USING (doc_id))"""

_BODY = f"payload.text IS NOT NULL AND {_strip('payload.text')} <> '' AND NOT ({_strip('payload.text')} LIKE '=%' AND {_strip('payload.text')} LIKE '%=')"
_CLOZE = f"""r AS (SELECT row_no, {_rstrip('payload.text')} AS body FROM wikitext WHERE {_BODY}),
 q AS (SELECT row_no, body, regexp_extract(body, '(?s)[^ ]*$') AS target FROM r),
 c AS (SELECT row_no, target, substr(body, 1, greatest(length(body) - length(target) - 1, 0)) AS context FROM q)"""
_CLOZE_SCORED = f"""{_CLOZE},
 l AS (SELECT *, ' ' || target AS cont, greatest(len({_words("' ' || target")}), 1) AS n FROM c),
 v AS (SELECT *, -((10000 + 4 * {_draw('context', 'cont')}) * n) / 10000.0::DOUBLE AS ll, {_draw('context', 'cont', "'greedy_match'")} < 5000 AS correct,
        'The answer is ' || ({_draw('context')} // 10) || '.' AS generation FROM l),
 f AS (SELECT row_no, correct, -ll AS target_nll, exp(-ll / n) AS target_ppl, generation,
        'The' = trim({_strip('target')}, '{_PUNCT}') AS word_match FROM v)"""

_MC_ROWS = "FROM {table} WHERE payload.question IS NOT NULL AND payload.choices IS NOT NULL AND payload.answer_index IS NOT NULL"
_LETTERS = "array_to_string(list_transform(payload.choices, lambda x, i: chr((64 + i)::INT) || '. ' || x), chr(10))"
_BLOCK = f"'Question: ' || payload.question || chr(10) || {_LETTERS} || chr(10) || 'Answer:' || chr(10)"
_BY_LETTER = "list_transform(payload.choices, lambda x, i: ' ' || chr((64 + i)::INT))"
_BY_TEXT = "list_transform(payload.choices, lambda x: ' ' || x)"


def _mc(table: str, conts: str) -> str:
    return f"""r AS (SELECT row_no, split, payload.answer_index AS answer_index, {_BLOCK} AS prompt, {conts} AS conts {_MC_ROWS.format(table=table)}),
 o AS (SELECT row_no, answer_index, prompt, unnest(conts) AS cont, unnest(range(len(conts))) AS i FROM r),
 l AS (SELECT *, -((10000 + 4 * {_draw('prompt', 'cont')}) * greatest(len({_words('cont')}), 1)) / 10000.0::DOUBLE AS ll FROM o),
 g AS (SELECT row_no, answer_index, list(ll ORDER BY i) AS lls, list(ll / strlen(cont) ORDER BY i) AS norms FROM l GROUP BY row_no, answer_index),
 m AS (SELECT row_no, answer_index, list_position(lls, list_max(lls)) - 1 AS chosen_index, list_position(norms, list_max(norms)) - 1 AS chosen_index_norm FROM g)"""


def _acc(variant: str, table: str, conts: str) -> str:
    return f"""SELECT '{variant}' AS variant, n_examples, acc, acc_norm FROM (WITH {_mc(table, conts)}
        SELECT count(*) AS n_examples, round(sum((chosen_index = answer_index)::INT) / count(*)::DOUBLE, 6) AS acc,
               round(sum((chosen_index_norm = answer_index)::INT) / count(*)::DOUBLE, 6) AS acc_norm FROM m)"""


_GENERATIONS = """gen AS (SELECT DISTINCT request_hash, json_extract_string(payload_json, '$.generation') AS generation FROM predictions
          WHERE json_valid(payload_json) AND json_extract_string(payload_json, '$.generation') IS NOT NULL)"""
_NUM = r"(-?\d[\d,]*(?:\.\d+)?)"


def _number(x: str) -> str:
    last = lambda p: f"regexp_extract_all({x}, '{p}', 1)[-1]"
    return f"replace(coalesce({last('(?i)final answer:\\s*' + _NUM)}, {last('####\\s*' + _NUM)}, {last(_NUM)}), ',', '')::DOUBLE"


_KEYS = f"""req AS (SELECT row_no, split, {_BLOCK} AS prompt, unnest({_BY_LETTER}) AS cont {_MC_ROWS.format(table='arc_easy')}),
 known AS (SELECT DISTINCT prompt, cont FROM req WHERE split = 'train'),
 k AS (SELECT req.*, known.prompt IS NOT NULL AS is_known FROM req LEFT JOIN known USING (prompt, cont))"""
_PLAN = """pm AS (SELECT sweep_id, spec, unnest(range(1, len(spec.models) + 1)) AS i FROM sweep_specs),
 pr AS (SELECT *, unnest(range(1, len(spec.models[i].revisions) + 1)) AS j FROM pm),
 pt AS (SELECT *, unnest(range(1, len(spec.targets) + 1)) AS k FROM pr),
 plan AS (SELECT sweep_id,
   ((coalesce(list_sum(list_transform(spec.models[1 : i - 1], lambda x: len(x.revisions))), 0) + j - 1) * len(spec.targets) + k - 1)::INT AS ord,
   spec.models[i].model_id AS model_id, spec.models[i].revisions[j] AS revision, spec.targets[k].dataset AS dataset, spec.targets[k].split AS split,
   spec.targets[k].variant AS variant, spec.targets[k].evaluator AS evaluator, spec."limit" AS "limit", spec.seed AS seed FROM pt)"""


def _metric(name: str) -> str:
    found = f"""nullif(regexp_extract(metrics_json, '"{name}"\\s*:\\s*(-?(?:Infinity|[0-9.eE+-]+))', 1), '')"""
    return f"{found}::DOUBLE"


_RUNS = f"""cur AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY recorded_at DESC) = 1),
 size AS (SELECT * FROM (VALUES ('pythia-70m', 70000000), ('pythia-160m', 160000000), ('pythia-410m', 410000000), ('pythia-1b', 1000000000)) v(model_id, params)),
 done AS (SELECT *, {_metric('acc')} AS acc, {_metric('acc_norm')} AS acc_norm, {_metric('bpb')} AS bpb,
   CASE WHEN revision = 'main' THEN 143000 ELSE nullif(regexp_extract(revision, '^step(\\d+)$', 1), '')::INT END AS step FROM cur WHERE status = 'done'),
 fin AS (SELECT done.*, round(log10(params), 6) AS x FROM done JOIN size USING (model_id) WHERE step = 143000)"""
_ACC5 = "('arc_easy', 'hellaswag', 'mmlu', 'lambada', 'gsm8k')"


def _load(dataset: str, table: str, *fields: str, order: str = "row_no", where: str = "true") -> str:
    """A loader's first 50 examples: the last delivery of each, in the place of the first, filtered before the limit."""
    return f"""WITH t AS (SELECT example_id, arg_max(payload, {{'a': added_at, 'r': row_no}}) AS payload, min(row_no) AS row_no FROM {table} WHERE split = 'test' AND example_id IS NOT NULL GROUP BY example_id),
        o AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS ord FROM t WHERE {where})
        SELECT ord, '{dataset}' AS dataset, 'test' AS split, example_id, {', '.join(f'payload.{f} AS {f}' for f in fields)} FROM o WHERE ord < 50"""


_POOL = "['high_school_mathematics', 'college_computer_science', 'high_school_world_history', 'professional_law', 'moral_scenarios', 'astronomy', 'college_biology', 'world_religions']"


def _get(side: str, field: str) -> str:
    return f"json_extract_string({side}.detail_json, '$.{field}')"


def _far(field: str) -> str:
    """Whether two lists of numbers are there and differ in length or beyond the tolerance; null is told from any number."""
    x, y = (f"try_cast(json_extract({s}.detail_json, '$.{field}') AS DOUBLE[])" for s in ("a", "b"))
    apart = f"list_bool_or(list_transform(list_zip({x}, {y}), lambda z: NOT coalesce(abs(z[1] - z[2]) <= 1e-6, false)))"
    return f"coalesce({x} IS NOT NULL AND {y} IS NOT NULL AND (len({x}) <> len({y}) OR coalesce({apart}, false)), false)"


def _number_of(side: str, field: str) -> str:
    return f"try_cast({_get(side, field)} AS DOUBLE)"


_PARITY = f"""{_RUNS}, pair AS (SELECT run_id AS harness, json_extract_string(config_json, '$.parity_of') AS base FROM done WHERE framework = 'lm_eval_harness'
          AND json_extract_string(config_json, '$.parity_of') IN (SELECT run_id FROM done WHERE framework = 'ladder')),
        v AS (SELECT * FROM example_results QUALIFY row_number() OVER (PARTITION BY run_id, example_id ORDER BY recorded_at DESC, correct DESC NULLS LAST, detail_json DESC NULLS LAST) = 1),
        a AS (SELECT harness, example_id, correct, detail_json FROM pair JOIN v ON v.run_id = base), b AS (SELECT harness, example_id, correct, detail_json FROM pair JOIN v ON v.run_id = harness),
        j AS (SELECT coalesce(a.harness, b.harness) AS harness, a.example_id IS NULL OR b.example_id IS NULL AS one,
          (a.correct = 1) IS NOT DISTINCT FROM (b.correct = 1) AND a.example_id IS NOT NULL AND b.example_id IS NOT NULL AS agree,
          coalesce(abs({_number_of('a', 'answer_index')} - {_number_of('b', 'answer_index')}) > 1e-6, false) OR coalesce(abs({_number_of('a', 'answer_number')} - {_number_of('b', 'answer_number')}) > 1e-6, false) AS gold,
          coalesce({_get('a', 'prompt')} <> {_get('b', 'prompt')}, false) AS prompt,
          ({_get('a', 'generation')} IS NOT NULL OR {_get('b', 'generation')} IS NOT NULL) AND {_number_of('a', 'extracted_number')} IS DISTINCT FROM {_number_of('b', 'extracted_number')} AS extracted,
          {_far('logliks')} AS far, {_far('logliks_norm')} AS far_norm FROM a FULL JOIN b ON a.harness = b.harness AND a.example_id = b.example_id),
        sorted AS (SELECT harness, agree, CASE WHEN agree THEN NULL WHEN one OR gold THEN 'DATA_MISMATCH' WHEN prompt THEN 'PROMPT_FORMAT' WHEN extracted THEN 'ANSWER_EXTRACTION'
          WHEN NOT far AND far_norm THEN 'NORMALIZATION' WHEN far THEN 'TOKENIZATION_BOUNDARY' ELSE 'UNEXPLAINED' END AS category FROM j)"""

ORACLE = {
    "ppl_by_lang": f"""WITH {_TOTALS},
        g AS (SELECT lang, count(*) AS n_docs, sum(units) AS units, sum(n_tok) AS n_tok, sum(n_bytes) AS n_bytes FROM t GROUP BY lang)
        SELECT lang, n_docs, n_tok::BIGINT AS n_tok, n_bytes::BIGINT AS n_bytes, round(CASE WHEN n_tok > 0 THEN exp(units / 10000.0::DOUBLE / n_tok) ELSE 'inf'::DOUBLE END, 6) AS ppl,
               round({_bpb('units', 'n_bytes')}, 6) AS bpb FROM g""",
    "doc_bpb": f"WITH {_TOTALS} SELECT doc_id, n_tok, n_bytes, round({_bpb('units', 'n_bytes')}, 6) AS bpb FROM t",
    "ppl_micro_vs_macro": f"""WITH {_TOTALS}
        SELECT lang, round({_bpb('sum(units)', 'sum(n_bytes)')}, 6) AS micro_bpb, round(avg({_bpb('units', 'n_bytes')}), 6) AS macro_bpb FROM t GROUP BY lang""",
    "window_plan": f"WITH {_SPANS} SELECT doc_id, k::INT AS k, start::INT AS start, c::INT AS context_words, m::INT AS scored_words FROM spans",
    "token_contiguity": f"""WITH {_SPANS} SELECT doc_id, max(len(w))::INT AS n_words, sum(m)::BIGINT AS scored, count(*) AS n_windows FROM spans GROUP BY doc_id""",
    "heading_filter": f"SELECT row_no, {_strip('payload.text')} AS text FROM wikitext WHERE {_BODY}",
    "seeded_slice": """SELECT doc_id, row_number() OVER (ORDER BY p, doc_id) - 1 AS ord
        FROM (SELECT doc_id, sha256('0|' || doc_id) AS p FROM documents ORDER BY p, doc_id LIMIT 200)""",
    "pooled_limit": """SELECT ord, row_no, subject FROM (SELECT row_number() OVER (ORDER BY list_position(['high_school_mathematics', 'college_computer_science',
          'high_school_world_history', 'professional_law', 'moral_scenarios', 'astronomy', 'college_biology', 'world_religions'], payload.subject), row_no) - 1 AS ord,
          row_no, payload.subject AS subject FROM mmlu WHERE payload.subject IN ('high_school_mathematics', 'college_computer_science',
          'high_school_world_history', 'professional_law', 'moral_scenarios', 'astronomy', 'college_biology', 'world_religions')) WHERE ord < 300""",
    "content_ids": "SELECT row_no, 'mmlu-' || payload.subject || '-' || left(sha256(payload.question), 16) AS content_id FROM mmlu",
    "cloze_split": f"WITH {_CLOZE} SELECT row_no, context, target FROM c",
    "cloze_scored": f"WITH {_CLOZE_SCORED} SELECT row_no, correct, round(target_nll, 6) AS target_nll, round(target_ppl, 4) AS target_ppl, generation, word_match FROM f",
    "cloze_metrics": f"""WITH {_CLOZE_SCORED} SELECT round(sum(correct::INT) / count(*)::DOUBLE, 4) AS acc, round(avg(target_nll), 4) AS target_nll_mean, round(avg(target_ppl), 4) AS target_ppl_mean,
        round(sum(word_match::INT) / count(*)::DOUBLE, 4) AS nonstandard_generated_word_acc FROM f""",
    "mc_render_letter": f"""SELECT row_no, 'Answer the following multiple choice question by choosing the letter of the correct option.' || chr(10) || {_BLOCK} AS prompt,
        array_to_string({_BY_LETTER}, '|') AS continuations {_MC_ROWS.format(table='arc_easy')}""",
    "mc_render_option_text": f"SELECT row_no, {_BLOCK} AS prompt, array_to_string({_BY_TEXT}, '|') AS continuations {_MC_ROWS.format(table='arc_easy')}",
    "fewshot_prompts": f"""WITH r AS (SELECT row_no, split, {_BLOCK} AS block, chr((65 + payload.answer_index)::INT) AS gold {_MC_ROWS.format(table='arc_easy')}),
        demo AS (SELECT string_agg(block || ' ' || gold || chr(10) || chr(10), '' ORDER BY row_no) AS prefix FROM (SELECT * FROM r WHERE split = 'train' ORDER BY row_no LIMIT 3))
        SELECT row_no, prefix || block AS prompt FROM r, demo WHERE split <> 'train'""",
    "mc_results": f"""WITH {_mc('arc_easy', _BY_LETTER)} SELECT row_no, chosen_index = answer_index AS correct, answer_index, chosen_index::INT AS chosen_index, chosen_index_norm::INT AS chosen_index_norm,
        chosen_index_norm = answer_index AS correct_norm FROM m""",
    "mc_acc_by_variant": " UNION ALL ".join(
        _acc(f"{t}/mc_{v}_v1", t, c) for t in ("arc_easy", "mmlu") for v, c in (("letter", _BY_LETTER), ("option_text", _BY_TEXT))
    ),
    "acc_null_is_wrong": """SELECT run_id, count(*) AS n_examples, round(sum(CASE WHEN correct = 1 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS acc FROM (
        SELECT * FROM example_results QUALIFY row_number() OVER (PARTITION BY run_id, example_id ORDER BY recorded_at DESC, correct DESC NULLS LAST, score DESC NULLS LAST) = 1) GROUP BY run_id""",
    "extract_number": f"WITH {_GENERATIONS} SELECT request_hash, generation, {_number('generation')} AS number FROM gen",
    "stop_truncate": f"""WITH {_GENERATIONS} SELECT request_hash, generation, split_part(split_part(split_part(generation, chr(10), 1), '. ', 1), 'Answer', 1) AS cut FROM gen""",
    "generative_results": f"""WITH r AS (SELECT row_no, payload.answer_number AS gold, 'Question: ' || payload.question || chr(10)
          || 'Solve step by step, then give the final answer as "Final answer: <number>".' || chr(10) || 'Answer:' || chr(10) AS prompt FROM gsm8k
          WHERE payload.question IS NOT NULL AND payload.answer_number IS NOT NULL),
        g AS (SELECT row_no, gold, {_draw('prompt')} // 10 AS n FROM r)
        SELECT row_no, n::DOUBLE = gold AS correct, 'The answer is ' || n || '.' AS generation, n::DOUBLE AS extracted_number FROM g""",
    "cache_counters": f"""WITH {_KEYS}, c AS (SELECT split, count(*) AS n_requests, count(DISTINCT CASE WHEN NOT is_known THEN {{'p': prompt, 'c': cont}} END) AS misses FROM k GROUP BY split)
        SELECT split, n_requests, misses, n_requests - misses AS hits FROM c""",
    "cache_misses": f"WITH {_KEYS} SELECT count(*) AS n_missing FROM (SELECT DISTINCT prompt, cont FROM k WHERE NOT is_known)",
    "cache_hits": f"WITH {_KEYS} SELECT split, count(*) AS n_hits FROM k WHERE is_known GROUP BY split",
    "sweep_plan": f'WITH {_PLAN} SELECT * FROM plan',
    "resume_todo": f"""WITH {_PLAN}, {_RUNS}, dk AS (SELECT DISTINCT model_id, revision, dataset, split, prompt_variant_id AS variant, evaluator,
          json_extract_string(config_json, '$.limit')::INT AS "limit", seed FROM done)
        SELECT min(sweep_id * 10000 + ord) AS ord, model_id, revision, dataset, split, variant, evaluator, "limit", seed FROM plan p
        WHERE NOT EXISTS (SELECT 1 FROM dk WHERE dk.model_id IS NOT DISTINCT FROM p.model_id AND dk.revision IS NOT DISTINCT FROM p.revision AND dk.dataset IS NOT DISTINCT FROM p.dataset
          AND dk.split IS NOT DISTINCT FROM p.split AND dk.variant IS NOT DISTINCT FROM p.variant AND dk.evaluator IS NOT DISTINCT FROM p.evaluator
          AND dk."limit" IS NOT DISTINCT FROM p."limit" AND dk.seed IS NOT DISTINCT FROM p.seed)
        GROUP BY model_id, revision, dataset, split, variant, evaluator, "limit", seed""",
    "latest_run": f"WITH {_RUNS} SELECT run_id, model_id, revision, status, n_examples, started_at, finished_at FROM cur",
    "failed_runs": f"WITH {_RUNS} SELECT status, count(*) AS n_runs FROM cur GROUP BY status",
    "grid_last_write": f"""WITH {_RUNS}, p AS (SELECT done.*, CASE WHEN dataset IN ('wikitext103', 'c4_slice') THEN bpb ELSE acc END AS value FROM done JOIN size USING (model_id)
          WHERE dataset IN ('arc_easy', 'hellaswag', 'mmlu', 'lambada', 'gsm8k', 'wikitext103', 'c4_slice') AND revision IN ('step1000', 'step64000', 'main'))
        SELECT dataset, (list_position(['arc_easy', 'hellaswag', 'mmlu', 'lambada', 'gsm8k', 'wikitext103', 'c4_slice'], dataset) - 1)::INT AS panel, model_id, revision, round(value, 6) AS value
        FROM p WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset, model_id, revision ORDER BY recorded_at DESC, run_id DESC) = 1""",
    "scaling_series": f"""WITH {_RUNS}, ch AS (SELECT * FROM (VALUES ('arc_easy', 0.25), ('hellaswag', 0.25), ('mmlu', 0.25), ('lambada', 0.0), ('gsm8k', 0.0)) v(dataset, chance))
        SELECT dataset, x, round(acc, 6) AS y, chance::DOUBLE AS chance FROM fin LEFT JOIN ch USING (dataset) WHERE acc IS NOT NULL""",
    "headline_series": f"""WITH {_RUNS}, h AS (SELECT CASE WHEN dataset IN {_ACC5} AND acc IS NOT NULL THEN 'acc' WHEN bpb IS NOT NULL THEN 'bpb' END AS axis, * FROM fin)
        SELECT axis, dataset, x, round(CASE WHEN axis = 'acc' THEN acc ELSE bpb END, 6) AS y FROM h WHERE axis IS NOT NULL""",
    "sensitivity_series": f"""WITH {_RUNS}, s AS (SELECT * FROM fin WHERE evaluator = 'loglik_mc' AND prompt_variant_id IS NOT NULL AND acc IS NOT NULL),
        p AS (SELECT dataset, prompt_variant_id AS variant, x, round(acc, 6) AS y FROM s
          UNION ALL SELECT dataset, prompt_variant_id || ' (acc_norm)', x, round(acc_norm, 6) FROM s WHERE prompt_variant_id LIKE '%mc_option_text_v1' AND acc_norm IS NOT NULL)
        SELECT * FROM p WHERE dataset IN (SELECT dataset FROM s GROUP BY dataset HAVING count(DISTINCT prompt_variant_id) >= 2)""",
    "trajectory_series": f"WITH {_RUNS} SELECT model_id, dataset, step AS x, round(acc, 6) AS y FROM done WHERE acc IS NOT NULL AND step IS NOT NULL",
    "model_order": f"""WITH {_RUNS}, m AS (SELECT DISTINCT model_id FROM runs) SELECT model_id, params::BIGINT AS params,
        row_number() OVER (ORDER BY params ASC NULLS LAST, model_id)::INT AS rank FROM m LEFT JOIN size USING (model_id)""",
    "invalidate_dry_run": f"""WITH {_RUNS}, wrong AS (SELECT run_id FROM done WHERE dataset = 'gsm8k')
        SELECT (SELECT count(*) FROM wrong) AS n_runs, (SELECT count(*) FROM example_results WHERE run_id IN (SELECT run_id FROM wrong)) AS n_results,
               (SELECT count(DISTINCT request_hash) FROM predictions WHERE prompt_variant_id = 'gsm8k/gen_v1') AS n_predictions""",
    "parity_diff": f"""WITH {_PARITY} SELECT harness, count(*) AS n, sum(agree::INT)::BIGINT AS n_agree, sum((category = 'DATA_MISMATCH')::INT)::BIGINT AS n_data_mismatch
        FROM (SELECT harness, agree, coalesce(category, '') AS category FROM sorted) GROUP BY harness""",
    "parity_categories": f"WITH {_PARITY} SELECT harness, category, count(*) AS n FROM sorted WHERE category IS NOT NULL GROUP BY ALL",
    "load_arc": _load("arc_easy", "arc_easy", "question", "answer_index"),
    "load_mmlu": _load("mmlu", "mmlu", "subject", "question", "answer_index", order=f"list_position({_POOL}, payload.subject), row_no", where=f"list_contains({_POOL}, payload.subject)"),
    "load_wikitext": _load("wikitext103", "wikitext", "text", where=_BODY).replace("payload.text AS text", f"{_strip('payload.text')} AS text"),
    "load_gsm8k": _load("gsm8k", "gsm8k", "question", "answer_number"),
    "shared_split_ids": "SELECT example_id FROM arc_easy WHERE split = 'train' INTERSECT SELECT example_id FROM arc_easy WHERE split = 'test'",
    "normalised_arc": f"""SELECT 'arc_easy-' || row_no AS example_id, payload.question AS question, len(payload.choices)::INT AS n_choices, payload.answer_index AS answer_index
        {_MC_ROWS.format(table='arc_easy')} AND payload.answer_index BETWEEN 0 AND len(payload.choices) - 1""",
    "rendered_context": f"""SELECT 'hellaswag-' || row_no AS example_id, payload.question || chr(10) AS prompt, array_to_string({_BY_TEXT}, '|') AS continuations, payload.answer_index AS answer_index
        {_MC_ROWS.format(table='arc_easy')}""",
    "gold_numbers": "SELECT row_no AS ord, trunc(payload.answer_number)::DOUBLE AS answer_number FROM gsm8k WHERE payload.question IS NOT NULL AND payload.answer_number IS NOT NULL",
    "series_points": f"""WITH {_RUNS}, ch AS (SELECT * FROM (VALUES ('arc_easy', 0.25), ('hellaswag', 0.25), ('mmlu', 0.25), ('lambada', 0.0), ('gsm8k', 0.0)) v(dataset, chance)),
        p AS (SELECT done.dataset, log10(params) AS px, acc FROM done JOIN size USING (model_id) WHERE step = 143000 AND acc IS NOT NULL)
        SELECT dataset, count(*) AS n_points, string_agg(round(px * 1000000)::BIGINT || ':' || round(acc * 1000000)::BIGINT, ' ' ORDER BY px, acc) AS points, any_value(chance)::DOUBLE AS chance
        FROM p LEFT JOIN ch USING (dataset) GROUP BY dataset""",
    "cached_rerun": f"""WITH {_CLOZE}, m AS (SELECT {_BLOCK} AS prompt, unnest({_BY_LETTER}) AS cont {_MC_ROWS.format(table='arc_easy')}),
        z AS (SELECT context AS prompt, ' ' || target AS cont, NULL AS budget FROM c UNION ALL SELECT context, NULL, greatest(len({_words('target')}), 1) * 4 FROM c),
        t AS (SELECT 'loglik_mc' AS evaluator, count(*) AS n, count(DISTINCT {{'p': prompt, 'c': cont}}) AS d FROM m UNION ALL SELECT 'cloze', count(*), count(DISTINCT {{'p': prompt, 'c': cont, 'b': budget}}) FROM z)
        SELECT evaluator, attempt::INT AS attempt, CASE attempt WHEN 1 THEN n - d ELSE n END AS hits, CASE attempt WHEN 1 THEN d ELSE 0 END AS misses, 0::BIGINT AS unanswered FROM t, (VALUES (1), (2)) a(attempt)""",
    "sweep_executed": f"""WITH n AS (SELECT 'arc_easy' AS dataset, 'loglik_mc' AS evaluator, count(*) AS n FROM ({_load("arc_easy", "arc_easy", "choices")}) WHERE ord < 20 AND len(choices) > 0
          UNION ALL SELECT 'gsm8k', 'generative', count(*) FROM ({_load("gsm8k", "gsm8k", "question")}) WHERE ord < 20
          UNION ALL SELECT 'wikitext103', 'perplexity', count(*) FROM ({_load("wikitext103", "wikitext", "text", where=_BODY)}) WHERE ord < 20)
        SELECT 'offline-7' AS model_id, revision, dataset, evaluator, 'done' AS status, n AS n_examples, n AS n_results, 6::BIGINT AS n_skipped FROM n, (VALUES ('main'), ('step1000')) r(revision)""",
    "json_detail": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
}
