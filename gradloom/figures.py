"""PNG files of the reports. Only the small relations of :mod:`.plans.reports` reach the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame

from .plans import reports

#: Colours by dataset and checkpoint and markers by model and prompt variant, with those that unknown names get in turn. Fixed values.
DATASET_COLORS = {"arc_easy": "tab:blue", "hellaswag": "tab:orange", "mmlu": "tab:green", "lambada": "tab:red", "gsm8k": "tab:purple"}
OTHER_COLORS = ("tab:brown", "tab:pink", "tab:gray", "tab:olive", "tab:cyan")
REVISION_COLORS = {"step1000": "#c6dbef", "step64000": "#6baed6", "main": "#08519c"}
MODEL_MARKERS = {"pythia-70m": "o", "pythia-160m": "s", "pythia-410m": "^", "pythia-1b": "D"}
VARIANT_MARKERS = {
    "arc_easy/mc_letter_v1": "o",
    "arc_easy/mc_option_text_v1": "s",
    "arc_easy/mc_letter_instr_v1": "^",
    "arc_easy/mc_letter_5shot_v1": "D",
    "mmlu/mc_letter_v1": "o",
    "mmlu/mc_option_text_v1": "s",
}
OTHER_MARKERS = ("v", "P", "X", "*", "h")


class Style:
    """What each name of a chart looks like: its fixed value, or the next spare one in the order of asking, round and round."""

    def __init__(self, fixed: dict[str, str], spare: tuple[str, ...]):
        self.fixed, self.spare, self.given = fixed, spare, {}

    def __getitem__(self, name: str) -> str:
        if name in self.fixed:
            return self.fixed[name]
        return self.given.setdefault(name, self.spare[len(self.given) % len(self.spare)])


def by_size(models: Iterable[str]) -> list[str]:
    """Models by their number of parameters, unknown ones last by name."""
    return sorted(models, key=lambda m: (reports.PARAM_COUNTS.get(m, math.inf), m))


def lines_of(rows: list, *by: str) -> dict[tuple, tuple[list, list]]:
    """The points of each line, in order: two lists for each key, by key."""
    out: dict[tuple, tuple[list, list]] = {}
    for r in sorted(rows, key=lambda r: (*(str(r[b]) for b in by), r["x"], r["y"])):
        xs, ys = out.setdefault(tuple(r[b] for b in by), ([], []))
        xs.append(r["x"])
        ys.append(r["y"])
    return out


def accuracy_grid(plt, rows: list):
    """A panel for each dataset: models by size, a bar for each checkpoint; chance as a line."""
    panels = sorted({(r["panel"], r["dataset"]) for r in rows})
    columns = 3 if len(panels) > 1 else 1
    fig, grid = plt.subplots(-(-len(panels) // columns), columns, figsize=(4.5 * columns, 3.5 * -(-len(panels) // columns)), squeeze=False)
    axes = [a for line in grid for a in line]
    width = 0.8 / len(reports.GRID_REVISIONS)
    for axis, (_, dataset) in zip(axes, panels):
        value = {(r["model_id"], r["revision"]): r["value"] for r in rows if r["dataset"] == dataset}
        models = by_size({m for m, _ in value})
        for k, revision in enumerate(reports.GRID_REVISIONS):
            there = [(i + (k - 1) * width, value[m, revision]) for i, m in enumerate(models) if (m, revision) in value]
            axis.bar([x for x, _ in there], [y for _, y in there], width=width, color=REVISION_COLORS[revision], label=revision)
        accuracy = dataset not in reports.PPL_DATASETS
        if accuracy:
            axis.axhline(reports.CHANCE[dataset], linestyle="--", linewidth=1, color="black", alpha=0.5)
            axis.set_ylim(0, 1)
        axis.set_xticks(range(len(models)))
        axis.set_xticklabels(models, fontsize="small", rotation=20)
        axis.set_title(dataset, fontsize="medium")
        axis.set_ylabel("accuracy" if accuracy else "bpb")
    for axis in axes[len(panels) :]:
        axis.axis("off")
    axes[0].legend(fontsize="small")
    return fig


def scaling_curve(plt, rows: list):
    """Accuracy against the logarithm of the size, a line and its chance rate for each dataset."""
    fig, axis = plt.subplots(figsize=(7, 5))
    color = Style(DATASET_COLORS, OTHER_COLORS)
    for (dataset,), (xs, ys) in lines_of(rows, "dataset").items():
        axis.plot(xs, ys, marker="o", label=dataset, color=color[dataset])
        if dataset in reports.CHANCE:
            axis.axhline(reports.CHANCE[dataset], linestyle="--", linewidth=1, color=color[dataset], alpha=0.6)
    _label(axis, "log10(parameters)", "acc", 1)
    return fig


def headline(plt, rows: list):
    """Accuracy on the left axis, bits per byte on the right one, which is turned over so that up is better on both."""
    fig, left = plt.subplots(figsize=(8, 5.5))
    right = left.twinx()
    color, drawn = Style(DATASET_COLORS, OTHER_COLORS), []
    for (axis, dataset), (xs, ys) in lines_of(rows, "axis", "dataset").items():
        if axis == "acc":
            drawn += left.plot(xs, ys, marker="o", label=dataset, color=color[dataset])
            if dataset in reports.CHANCE:
                left.axhline(reports.CHANCE[dataset], linestyle="--", linewidth=1, color=color[dataset], alpha=0.6)
        else:
            drawn += right.plot(xs, ys, marker="s", linestyle="--", label=f"{dataset} (bpb)", color=color[dataset])
    left.set_xlabel("log10(parameters)")
    left.set_ylabel("accuracy")
    left.set_ylim(0, 1)
    right.set_ylabel("bits per byte")
    if any(r["axis"] == "bpb" for r in rows):
        right.invert_yaxis()
    left.legend(handles=drawn, labels=[x.get_label() for x in drawn], fontsize="small")
    return fig


def prompt_sensitivity(plt, rows: list):
    """Accuracy by prompt variant: colour tells the dataset, the marker the variant; normalised accuracy is hollow."""
    fig, axis = plt.subplots(figsize=(8, 5.5))
    color, marker = Style(DATASET_COLORS, OTHER_COLORS), Style(VARIANT_MARKERS, OTHER_MARKERS)
    for (dataset, variant), (xs, ys) in lines_of(rows, "dataset", "variant").items():
        hollow = variant.endswith(" (acc_norm)")
        axis.plot(xs, ys, marker=marker[variant.removesuffix(" (acc_norm)")], linestyle=":" if hollow else "-", markerfacecolor="none" if hollow else color[dataset], color=color[dataset], label=variant)
    _label(axis, "log10(parameters)", "accuracy", 1)
    return fig


def trajectory(plt, rows: list):
    """A metric against the training step: colour tells the dataset, the marker the model."""
    fig, axis = plt.subplots(figsize=(8, 5.5))
    color, marker = Style(DATASET_COLORS, OTHER_COLORS), Style(MODEL_MARKERS, OTHER_MARKERS)
    lines = lines_of(rows, "model_id", "dataset")
    order = by_size({m for m, _ in lines})
    for (model, dataset), (xs, ys) in sorted(lines.items(), key=lambda x: (order.index(x[0][0]), x[0][1])):
        axis.plot(xs, ys, marker=marker[model], color=color[dataset], label=f"{model} / {dataset}")
    _label(axis, "training step", "value", None)
    return fig


def _label(axis, x: str, y: str, top: float | None) -> None:
    axis.set_xlabel(x)
    axis.set_ylabel(y)
    if top:
        axis.set_ylim(0, top)
    axis.legend(fontsize="x-small")


#: File, its relation, and what draws it.
CHARTS: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable]] = {
    "accuracy_per_run": (reports.accuracy_grid, accuracy_grid),
    "scaling_curve": (lambda runs: reports.scaling_points(runs, "acc"), scaling_curve),
    "trajectory": (lambda runs: reports.trajectory_points(runs, "acc"), trajectory),
    "trajectory_bpb": (lambda runs: reports.trajectory_points(runs, "bpb"), trajectory),
    "headline": (reports.headline_points, headline),
    "prompt_sensitivity": (reports.sensitivity_points, prompt_sensitivity),
}


def draw_all(runs: DataFrame, out: str) -> list[str]:
    """Six files; a chart without data is left out. Needs matplotlib, without which ImportError says so."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise ImportError("figures need matplotlib") from e
    return draw(plt, runs, out)


def draw(plt, runs: DataFrame, out: str) -> list[str]:
    """The same with a drawing library given."""
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    written = []
    for name, (relation, chart) in CHARTS.items():
        rows = relation(runs).collect()  # a point for each run
        if rows:
            fig = chart(plt, rows)
            fig.tight_layout()
            fig.savefig(path := str(folder / f"{name}.png"))
            plt.close(fig)
            written.append(path)
    return written
