"""Record types as Spark schemas."""

from __future__ import annotations

MC_PAYLOAD = "question string, context string, choices array<string>, answer_index int, subject string"
CLOZE_PAYLOAD = "context string, target string"
GENERATIVE_PAYLOAD = "question string, answer_number double"
TEXT_PAYLOAD = "text string"

PAYLOADS = {
    "arc_easy": MC_PAYLOAD,
    "hellaswag": MC_PAYLOAD,
    "mmlu": MC_PAYLOAD,
    "lambada": CLOZE_PAYLOAD,
    "gsm8k": GENERATIVE_PAYLOAD,
    "wikitext103": TEXT_PAYLOAD,
    "c4_slice": TEXT_PAYLOAD,
}


def example_schema(dataset: str) -> str:
    """The envelope of a dataset's examples, with its payload."""
    fields = ", ".join(f.replace(" ", ": ", 1) for f in PAYLOADS[dataset].split(", "))
    return f"dataset string, split string, example_id string, payload struct<{fields}>"


PREDICTION = (
    "request_hash string, model_id string, revision string, logliks array<double>, token_nlls array<double>, "
    "generation string, n_bytes bigint, is_greedy_matches array<boolean>, n_tokens array<int>"
)
RESULT = "run_id string, example_id string, correct boolean, score double, detail_json string, ord bigint"
RUN = (
    "run_id string, model_id string, revision string, dataset string, split string, prompt_variant_id string, evaluator string, "
    "framework string, seed int, code_version string, metrics map<string,double>, config_json string, n_examples int, "
    "started_at string, finished_at string, status string, seq bigint"
)
RUN_FIELDS = tuple(f.split()[0] for f in RUN.split(", "))

STATUSES = ("running", "done", "failed")
REQUEST_KINDS = ("loglik", "generate", "nll")
