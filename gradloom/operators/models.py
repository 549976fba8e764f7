"""Scoring with a causal language model behind a small interface, in Arrow batches.

A backend has ``encode(text)``, ``logprobs(sequences)`` (for each sequence of tokens one row of next-token log-probabilities for each position),
``generate(text, max_new_tokens, temperature)`` and ``unload()``. :func:`hub_backend` makes one from a model hub where its libraries are installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd

from .evaluators import DEFAULT_MAX_NEW_TOKENS, Scorer, batch_scorer, register_scorer

#: Tokens of a forward pass, padding included.
BATCH_TOKENS = 16_384
#: Models by name and where a hub keeps them. Fixed values.
HUB_MODELS = {
    "pythia-70m": "EleutherAI/pythia-70m",
    "pythia-160m": "EleutherAI/pythia-160m",
    "pythia-410m": "EleutherAI/pythia-410m",
    "pythia-1b": "EleutherAI/pythia-1b",
}


class Backend(Protocol):
    """A model in a Python worker."""

    def encode(self, text: str) -> list[int]: ...

    def logprobs(self, sequences: list[list[int]]) -> list[np.ndarray]: ...

    def generate(self, text: str, max_new_tokens: int, temperature: float) -> str: ...

    def unload(self) -> None: ...


def in_batches(sequences: list[list[int]]) -> Iterator[list[int]]:
    """Numbers of sequences to be passed together, of like length, so that little is padded."""
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    batch: list[int] = []
    for i in order:
        if batch and (len(batch) + 1) * len(sequences[i]) > BATCH_TOKENS:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def picked_logprobs(backend: Backend, asked: list[tuple[list[int], int]]) -> list[tuple[np.ndarray, bool]]:
    """For each ``(ids, skip)`` the log-probabilities of the tokens from ``skip`` on, and whether each is the likeliest.

    Equal sequences, such as one prompt's options asked for twice, are passed once, several in one pass.
    """
    known: dict[tuple[int, ...], int] = {}
    for ids, _ in asked:
        known.setdefault(tuple(ids), len(known))
    sequences = [list(k) for k in known]
    by_sequence: dict[int, list[int]] = {}
    for n, (ids, _) in enumerate(asked):
        by_sequence.setdefault(known[tuple(ids)], []).append(n)
    out: list[tuple[np.ndarray, bool]] = [(np.zeros(0), False)] * len(asked)
    for batch in in_batches(sequences):
        for i, rows in zip(batch, backend.logprobs([sequences[i] for i in batch])):
            for n in by_sequence[i]:
                ids, skip = asked[n]
                own, at = np.array(ids[skip:], int), rows[skip - 1 : len(ids) - 1]
                out[n] = at[np.arange(len(own)), own].astype(float), bool((at.argmax(axis=1) == own).all())
    return out


def continuation_ids(backend: Backend, prompt: str, continuation: str) -> tuple[list[int], int]:
    """Tokens of both together, and how many are the prompt's own: the rest is the continuation's, as it stands in its context."""
    return backend.encode(prompt + continuation), len(backend.encode(prompt))


def window_ids(backend: Backend, context: str, text: str) -> tuple[list[int], int]:
    """Tokens of a window with its context, which one space parts from it, and where scoring starts: without context the first token has nothing to be predicted from."""
    if context:
        return backend.encode(f"{context} {text}"), max(1, len(backend.encode(context)))
    return backend.encode(text), 1


def continuation_score(backend: Backend, prompt: str, continuation: str) -> tuple[float, int, bool]:
    """Log-likelihood, tokens and greedy flag of a continuation; without tokens of its own it scores 0."""
    return _scores(backend, [continuation_ids(backend, prompt, continuation)])[0]


def _scores(backend: Backend, asked: list[tuple[list[int], int]]) -> list[tuple[float, int, bool]]:
    some = [k for k, (ids, skip) in enumerate(asked) if len(ids) > skip > 0]
    out: list[tuple[float, int, bool]] = [(0.0, 0, False)] * len(asked)
    for k, (values, greedy) in zip(some, picked_logprobs(backend, [asked[k] for k in some])):
        out[k] = float(values.sum()), len(values), greedy
    return out


def window_nlls(backend: Backend, context: str, text: str) -> list[float]:
    """Negative log-likelihoods of a window's newly scored tokens, in nats."""
    return _nlls(backend, [window_ids(backend, context, text)])[0]


def _nlls(backend: Backend, asked: list[tuple[list[int], int]]) -> list[list[float]]:
    some = [k for k, (ids, skip) in enumerate(asked) if len(ids) > skip]
    out: list[list[float]] = [[] for _ in asked]
    for k, (values, _) in zip(some, picked_logprobs(backend, [asked[k] for k in some])):
        out[k] = (-values).tolist()
    return out


def cut_at_stops(text: str, stops: list[str] | None) -> str:
    """The text before the earliest stop."""
    for s in stops if stops is not None else []:
        if s:
            text = text.split(s, 1)[0]
    return text


FIELDS = ["loglik", "n_tokens", "is_greedy_match", "token_nlls", "n_bytes", "generation"]


def answers(backend: Backend, requests: pd.DataFrame) -> pd.DataFrame:
    """Answers of a batch of requests, in their order; all likelihoods of the batch are asked for together."""
    rows = [dict.fromkeys(FIELDS) for _ in range(len(requests))]
    asked = list(requests.itertuples(index=False))
    of = lambda kind: [k for k, r in enumerate(asked) if r.kind == kind]
    for k, got in zip(own := of("loglik"), _scores(backend, [continuation_ids(backend, asked[k].prompt, asked[k].continuation) for k in own])):
        rows[k]["loglik"], rows[k]["n_tokens"], rows[k]["is_greedy_match"] = got
    for k, got in zip(own := of("nll"), _nlls(backend, [window_ids(backend, asked[k].context or "", asked[k].prompt) for k in own])):
        rows[k]["token_nlls"], rows[k]["n_bytes"] = got, len(asked[k].prompt.encode())
    for k in of("generate"):
        r = asked[k]
        budget = DEFAULT_MAX_NEW_TOKENS if pd.isna(r.max_new_tokens) else int(r.max_new_tokens)
        rows[k]["generation"] = cut_at_stops(backend.generate(r.prompt, budget, 0.0 if pd.isna(r.temperature) else float(r.temperature)), r.stop)
    return pd.DataFrame(rows, columns=FIELDS).astype({"n_tokens": "Int32", "n_bytes": "Int64", "is_greedy_match": "boolean"})


def model_scorer(load: Callable[[], Backend]) -> Scorer:
    """A scorer whose model is loaded once in each task's Python worker and unloaded when the task's requests are answered."""

    def in_worker() -> tuple[Callable[[pd.DataFrame], pd.DataFrame], Callable[[], None]]:
        backend = load()
        return (lambda requests: answers(backend, requests)), backend.unload

    return batch_scorer(in_worker)


@register_scorer("hub")
def hub_scorer(repository: str = "", revision: str = "main") -> Scorer:
    """A model of a hub or a local folder; needs torch and transformers on the workers."""
    return model_scorer(lambda: hub_backend(repository, revision))


def _named(repository: str) -> Callable[..., Scorer]:
    return lambda revision="main": hub_scorer(repository, revision)


for _name, _repository in HUB_MODELS.items():
    register_scorer(_name)(_named(_repository))


def hub_backend(repository: str, revision: str) -> Backend:
    """Half precision on a GPU, single on a CPU. Decoding is greedy unless the temperature is above 0."""
    try:
        import torch
        import transformers
    except ImportError as e:
        raise ImportError("models of a hub need torch and transformers") from e
    device = "cuda" if torch.cuda.is_available() else "cpu"
    tokenizer = transformers.AutoTokenizer.from_pretrained(repository, revision=revision)
    loaded = transformers.AutoModelForCausalLM.from_pretrained(repository, revision=revision, torch_dtype=torch.float16 if device == "cuda" else torch.float32).to(device).eval()

    class Hub:
        model = loaded

        def encode(self, text: str) -> list[int]:
            return tokenizer(text, add_special_tokens=False)["input_ids"]

        def logprobs(self, sequences: list[list[int]]) -> list[np.ndarray]:
            # Padded on the right: a causal model's earlier positions don't see it.
            longest = max(map(len, sequences))
            padded = torch.tensor([s + [0] * (longest - len(s)) for s in sequences], device=device)
            mask = torch.tensor([[1] * len(s) + [0] * (longest - len(s)) for s in sequences], device=device)
            with torch.no_grad():
                logits = self.model(padded, attention_mask=mask).logits
            return [torch.log_softmax(logits[i, : len(s)].float(), -1).cpu().numpy() for i, s in enumerate(sequences)]

        def generate(self, text: str, max_new_tokens: int, temperature: float) -> str:
            ids = torch.tensor([self.encode(text)], device=device)
            drawn = {"do_sample": True, "temperature": temperature} if temperature > 0 else {"do_sample": False}
            with torch.no_grad():
                done = self.model.generate(ids, max_new_tokens=max_new_tokens, pad_token_id=tokenizer.eos_token_id, **drawn)
            return tokenizer.decode(done[0, ids.shape[1] :], skip_special_tokens=True)

        def unload(self) -> None:
            self.model = None
            if device == "cuda":
                torch.cuda.empty_cache()

    return Hub()
