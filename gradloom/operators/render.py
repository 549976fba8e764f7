"""Prompt variants and their rendering as Columns."""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MC = "Question: {question}\n{lettered_choices}\nAnswer:\n"


@dataclass(frozen=True)
class Variant:
    """A versioned prompt template of one task family: ``mc``, ``cloze`` or ``generative``."""

    id: str
    task_family: str
    template: str
    continuation_style: str | None = None
    num_fewshot: int = 0
    fewshot_split: str | None = None
    fewshot_seed: int = 0
    max_new_tokens: int | None = None
    stop: tuple[str, ...] = ()
    temperature: float = 0.0


#: Templates, budgets and stops that results depend on. Fixed values.
LIBRARY = {
    v.id: v
    for v in (
        Variant("arc_easy/mc_letter_v1", "mc", _MC, "letter"),
        Variant(
            "arc_easy/mc_letter_instr_v1",
            "mc",
            "Answer the following multiple choice question by choosing the letter of the correct option.\n" + _MC,
            "letter",
        ),
        Variant("arc_easy/mc_option_text_v1", "mc", _MC, "option_text"),
        Variant("arc_easy/mc_letter_5shot_v1", "mc", _MC, "letter", num_fewshot=5, fewshot_split="train", fewshot_seed=0),
        Variant("hellaswag/mc_context_v1", "mc", "{context}\n", "option_text"),
        Variant("mmlu/mc_letter_v1", "mc", _MC, "letter"),
        Variant("mmlu/mc_option_text_v1", "mc", _MC, "option_text"),
        Variant("lambada/cloze_v1", "cloze", "{context}"),
        Variant(
            "gsm8k/gen_v1",
            "generative",
            'Question: {question}\nSolve step by step, then give the final answer as "Final answer: <number>".\nAnswer:\n',
            max_new_tokens=256,
            stop=("Question:",),
        ),
    )
}


def load_variant(variant_id: str, library: str | Path | None = None) -> Variant:
    """A variant by id, from a folder of YAML files if one is given, else from the built-in ones; KeyError if unknown."""
    if library is not None:
        import yaml

        path = Path(library) / f"{variant_id}.yaml"
        if not path.is_file():
            raise KeyError(f"unknown prompt variant {variant_id!r}")
        given = yaml.safe_load(path.read_text(encoding="utf-8"))
        given["stop"] = tuple(given.get("stop") or ())
        return replace(Variant("", "", ""), **{k: v for k, v in given.items() if v is not None})
    if variant_id not in LIBRARY:
        raise KeyError(f"unknown prompt variant {variant_id!r}; known: {', '.join(sorted(LIBRARY))}")
    return LIBRARY[variant_id]


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """The template with its fields filled in once: braces inside a value stay as they are."""
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if name not in fields:
                raise KeyError(f"the template has an unknown field {name!r}")
            parts.append(fields[name])
    return F.concat(*parts) if parts else F.lit("")


def lettered(choices: Column) -> Column:
    """``A. first`` and so on, one line for each choice; more than 26 fail."""
    lines = F.transform(choices, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x))
    return F.when(F.size(choices) > 26, F.raise_error(F.lit("more than 26 choices")).cast("string")).otherwise(F.array_join(lines, "\n"))


def continuations(choices: Column, style: str | None) -> Column:
    """What is scored for each choice: a space and its text, or a space and its letter."""
    if style == "option_text":
        return F.transform(choices, lambda x: F.concat(F.lit(" "), x))
    return F.transform(choices, lambda x, i: F.concat(F.lit(" "), F.char(i + 65)))


def _mc_block(template: str, payload: Column, fields: set[str]) -> Column:
    found = {"lettered_choices": lettered(payload["choices"])} | {f: F.coalesce(payload[f], F.lit("")) for f in ("question", "context") if f in fields}
    if "context" in found and "question" not in found:
        found["question"] = found["context"]
    return fill_template(template, found)


def fewshot_prefix(variant: Variant, demos: list[dict]) -> str:
    """The demonstrations' blocks with their gold continuations, in order; a constant that the driver computes once."""
    out = []
    for d in demos:
        choices = d["choices"]
        lines = "\n".join(f"{string.ascii_uppercase[i]}. {x}" for i, x in enumerate(choices))
        values = {"question": d.get("question") or "", "context": d.get("context") or "", "lettered_choices": lines}
        block = re.sub(r"\{(\w+)\}", lambda m: values[m[1]], variant.template)
        gold = choices[d["answer_index"]] if variant.continuation_style == "option_text" else string.ascii_uppercase[d["answer_index"]]
        out.append(f"{block} {gold}")
    return "".join(f"{x}\n\n" for x in out)


def sample_demos(pool: DataFrame, variant: Variant) -> list[dict]:
    """The demonstrations, drawn without replacement by the variant's seed from the pool in its order.

    Only the drawn rows leave the cluster: the draw is of row numbers.
    """
    size = pool.count()
    if size < variant.num_fewshot:
        raise ValueError(f"{variant.id} needs {variant.num_fewshot} demonstrations, the pool has {size}")
    picked = random.Random(variant.fewshot_seed).sample(range(size), variant.num_fewshot)
    rows = {r["ord"]: r["payload"].asDict() for r in pool.filter(F.col("ord").isin(picked)).select("ord", "payload").collect()}
    return [rows[i] for i in picked]


def render(examples: DataFrame, variant: Variant, demos: list[dict] | None = None) -> DataFrame:
    """Adds ``prompt_variant_id, kind, prompt, continuations, gen_params``; demonstrations count for multiple choice only."""
    payload = F.col("payload")
    fields = set(examples.schema["payload"].dataType.fieldNames())
    none_params = F.lit(None).cast("struct<max_new_tokens:int,stop:array<string>,temperature:double>")
    conts, params = F.lit(None).cast("array<string>"), none_params
    if variant.task_family == "mc":
        kind, prompt = "loglik", _mc_block(variant.template, payload, fields)
        if demos:
            prompt = F.concat(F.lit(fewshot_prefix(variant, demos)), prompt)
        conts = continuations(payload["choices"], variant.continuation_style)
    elif variant.task_family == "cloze":
        kind, prompt = "generate", fill_template(variant.template, {"context": payload["context"]})
    elif variant.task_family == "generative":
        kind, prompt = "generate", fill_template(variant.template, {"question": payload["question"]})
        params = F.struct(
            F.lit(variant.max_new_tokens).cast("int").alias("max_new_tokens"), F.array(*map(F.lit, variant.stop)).cast("array<string>").alias("stop"), F.lit(variant.temperature).alias("temperature")
        )
    else:
        raise NotImplementedError(f"no rendering for the task family {variant.task_family!r}")
    return examples.withColumns({"prompt_variant_id": F.lit(variant.id), "kind": F.lit(kind), "prompt": prompt, "continuations": conts, "gen_params": params})
