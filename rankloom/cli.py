"""Command line: ``python -m rankloom.cli models list|inspect|delete``, ``evaluate``, ``latency``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from rankloom.errors import RankError
from rankloom.functions import names
from rankloom.operators import evaluation, retrieval, statistics
from rankloom.session import local_session
from rankloom.sources import beir, registry


def _models(args) -> int:
    root = args.cache or str(names.cache_root())
    if args.action == "delete":
        registry.delete_model(local_session(cpus=2), root, args.model_id)
        print(f"deleted {args.model_id}")
        return 0
    found = registry.cached_models(local_session(cpus=2), root).orderBy("model_id")
    if args.action == "inspect":
        found = found.where(F.col("model_id") == args.model_id)
    lines = [r.value for r in found.select(F.to_json(F.struct("*")).alias("value")).collect()]
    print("\n".join(lines))
    return 0 if lines or args.action == "list" else 1


def _evaluate(args) -> int:
    """BM25 over a dataset: NDCG and reciprocal rank, unjudged queries counting as 0."""
    data = beir.load_beir(local_session(cpus=args.cpus), args.path)
    found = retrieval.Bm25(data.corpus).search(data.queries, args.top).withColumn("rank", F.col("idx") + 1).persist()
    per = evaluation.ndcg_at(found, data.judged, 10).join(evaluation.reciprocal_rank(found, data.judged), "qid")
    print(evaluation.macro_mean(per, data.queries).toJSON().first())
    return 0


def _latency(args) -> int:
    """Statistics of a column of latencies in a Parquet table, and whether they meet the target."""
    rows = local_session(cpus=args.cpus).read.parquet(args.path)
    row = statistics.within_target(statistics.latency_stats(rows, args.column), args.target).first()
    print(row.asDict())
    return 0 if row["within_target"] else 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rankloom")
    commands = top.add_subparsers(dest="command", required=True)
    models = commands.add_parser("models", help="the model cache")
    models.add_argument("action", choices=["list", "inspect", "delete"])
    models.add_argument("model_id", nargs="?")
    models.add_argument("--cache")
    models.set_defaults(run=_models)
    evaluate = commands.add_parser("evaluate", help="BM25 over a retrieval dataset")
    evaluate.add_argument("path")
    evaluate.add_argument("--top", type=int, default=100)
    evaluate.add_argument("--cpus", type=int, default=8)
    evaluate.set_defaults(run=_evaluate)
    latency = commands.add_parser("latency", help="latency statistics against a target")
    latency.add_argument("path")
    latency.add_argument("--column", default="latency")
    latency.add_argument("--target", type=float, default=20.0)
    latency.add_argument("--cpus", type=int, default=8)
    latency.set_defaults(run=_latency)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "models" and args.action != "list" and not args.model_id:
        print("a model id is needed", file=sys.stderr)
        return 2
    try:
        return args.run(args)
    except RankError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
