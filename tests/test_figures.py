"""Charts are drawn with a recorder in place of the drawing library, which may be missing."""

import pytest

from gradloom import figures


class Recorder:
    """Takes any call and remembers it."""

    def __init__(self, log, name=""):
        self.log, self.name = log, name

    def __getattr__(self, name):
        return Recorder(self.log, name)

    def __call__(self, *args, **kwargs):
        self.log.append((self.name, args, kwargs))
        if self.name == "subplots":
            one = Recorder(self.log)
            return Recorder(self.log), [[one] * args[1] for _ in range(args[0])] if args else one
        if self.name == "plot":
            return [Recorder(self.log)]
        return Recorder(self.log)


RUN = "run_id string, model_id string, revision string, dataset string, evaluator string, prompt_variant_id string, status string, metrics map<string,double>, seq int"


@pytest.fixture
def drawn(spark, tmp_path):
    rows = []
    for k, (model, revision, dataset, metric) in enumerate(
        [(m, r, d, x) for m in ("pythia-70m", "pythia-1b", "other") for r in ("step1000", "main") for d, x in (("arc_easy", "acc"), ("wikitext103", "bpb"))]
    ):
        rows.append((f"r{k}", model, revision, dataset, "loglik_mc", None, "done", {metric: 0.1 * (k + 1)}, k))
    for k, variant in enumerate(("arc_easy/mc_letter_v1", "arc_easy/mc_option_text_v1")):
        rows.append((f"v{k}", "pythia-70m", "main", "arc_easy", "loglik_mc", variant, "done", {"acc": 0.5, "acc_norm": 0.6}, 50 + k))
    log = []
    return figures.draw(Recorder(log), spark.createDataFrame(rows, RUN), str(tmp_path)), log


def test_all_charts_are_drawn(drawn):
    files, log = drawn
    assert [f.rsplit("/")[-1] for f in files] == [f"{n}.png" for n in figures.CHARTS]
    names = [n for n, *_ in log]
    assert names.count("bar") == 6 and "twinx" in names and "invert_yaxis" in names and names.count("savefig") == 6
    chance = [a[0] for n, a, _ in log if n == "axhline"]
    assert set(chance) == {0.25}
    plots = [(a, k) for n, a, k in log if n == "plot"]
    assert any(k.get("marker") == "D" and k["label"] == "pythia-1b / arc_easy" and k["color"] == "tab:blue" for _, k in plots)
    assert any(k.get("marker") == "v" and k["label"].startswith("other") for _, k in plots)  # unknown models have spare markers
    assert any(k.get("markerfacecolor") == "none" and k["label"].endswith("(acc_norm)") for _, k in plots)


def test_nothing_to_draw(spark, tmp_path):
    assert figures.draw(Recorder([]), spark.createDataFrame([], RUN), str(tmp_path)) == []


def test_styles_go_round():
    style = figures.Style({"a": "red"}, ("x", "y"))
    assert [style[n] for n in ("a", "b", "c", "d", "b", "a")] == ["red", "x", "y", "x", "x", "red"]
    assert figures.by_size(["z", "pythia-1b", "pythia-70m", "b"]) == ["pythia-70m", "pythia-1b", "b", "z"]
