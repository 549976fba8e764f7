"""Command line: ``run``, ``sweep``, ``results``, ``show``, ``figures``, ``invalidate``, ``import``, ``parity``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.evaluators import EVALUATORS, get_scorer
from .operators.models import HUB_MODELS
from .operators.store import Warehouse
from .plans import parity as P
from .plans import sweep
from .session import discard_work, work_dir


def _scorer_of(model_id: str, revision: str):
    try:
        return get_scorer(model_id, **({"revision": revision} if model_id in HUB_MODELS else {}))
    except KeyError:
        if model_id.startswith("offline"):
            return get_scorer("offline")
        raise


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gradloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str, **optional: object) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--db", required=True)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        for k, v in optional.items():
            p.add_argument(f"--{k}", default=v, type=type(v) if v is not None else str)
        return p

    command("run", "data", "model", "dataset", "evaluator", variant=None, revision="main", split="test", limit=None, seed=0, library=None)
    command("sweep", "data", "spec", library=None)
    command("results")
    command("show", "run")
    command("figures", "out")
    command("invalidate", "data", "dataset", library=None).add_argument("--apply", action="store_true")
    command("import", "file", "run", model="", revision="main", dataset="", split="", variant=None, evaluator="loglik_mc", framework=P.FRAMEWORK)
    command("parity", "a", "b", report=None)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code 0, or 1 for unknown names, missing runs, an empty warehouse, failed runs and unexplained disagreements."""
    args = parser().parse_args(argv)
    if args.command == "run" and args.evaluator not in EVALUATORS:
        print(f"unknown evaluator {args.evaluator!r}; known: {', '.join(EVALUATORS)}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("gradloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return _done(args, spark, Warehouse(spark, args.db))
    finally:
        discard_work(spark)


def _done(args: argparse.Namespace, spark: SparkSession, db: Warehouse) -> int:
    if args.command == "run":
        try:
            scorer = _scorer_of(args.model, args.revision)
        except KeyError as e:
            print(e, file=sys.stderr)
            return 1
        limit = None if args.limit is None else int(args.limit)
        run_id, ok = sweep.execute(db, args.data, args.model, args.revision, args.dataset, args.split, args.variant, args.evaluator, limit, args.seed, scorer, library=args.library)
        print(run_id, "done" if ok else "failed")
        return int(not ok)
    if args.command == "sweep":
        out = sweep.run_sweep(db, args.data, sweep.load_spec(args.spec), _scorer_of, library=args.library)
        print(f"executed {len(out.executed)}, skipped {out.skipped}, failed {len(out.failed)}")
        return int(bool(out.failed))
    if args.command == "import":
        run = P.imported_run(args.run, args.model, args.revision, args.dataset, args.split, args.variant, args.evaluator, args.framework)
        print(json.dumps(P.import_run(db, args.file, run)["metrics"]))
        return 0
    if args.command == "parity":
        if missing := [r for r in (args.a, args.b) if db.get_run(r) is None]:
            print(f"no run {', '.join(missing)}", file=sys.stderr)
            return 1
        rows = P.parity(db.results(args.a), db.results(args.b))
        total = P.agreement(rows).first()
        if args.report:
            P.write_report(rows, args.a, args.b, args.report)
        print(json.dumps(total.asDict()))
        for r in P.category_counts(rows).orderBy("category").collect():
            print(f"{r['category']}: {r['n']}")
        return int(bool(total["unexplained"]))
    rows = db.list_runs()
    if args.command == "show":
        run = db.get_run(args.run)
        if run is None:
            print(f"no run {args.run}", file=sys.stderr)
            return 1
        print(json.dumps(run, default=str, indent=1))
        for r in db.results(args.run).limit(20).collect():
            print(r["example_id"], r["correct"], r["score"])
        return 0
    if rows.isEmpty():
        print("no runs", file=sys.stderr)
        return 1
    if args.command == "results":
        for r in rows.toLocalIterator():
            print(r["run_id"], r["model_id"], r["revision"], r["dataset"], r["prompt_variant_id"] or "-", r["status"], json.dumps(r["metrics"]))
        return 0
    if args.command == "figures":
        from .figures import draw_all

        print(*draw_all(db.runs(), args.out), sep="\n")
        return 0
    wrong = db.runs().filter((F.col("dataset") == args.dataset) & (F.col("status") == "done"))
    # Each run's keys are appended to one folder, so no plan grows with the number of runs.
    folder, any_ = f"{work_dir(spark)}/keys", False
    for run in wrong.toLocalIterator():
        sweep.cache_keys(db, args.data, run.asDict(), library=args.library).write.mode("append").parquet(folder)
        any_ = True
    if not any_:
        print(f"no finished run of {args.dataset}", file=sys.stderr)
        return 1
    keys = spark.read.schema("request_hash string").parquet(folder).distinct()
    print(json.dumps(db.invalidate(keys, wrong.select("run_id"), dry_run=not args.apply)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
