"""``python -m tillcast``: jobs on a transaction log in CSV files."""

from __future__ import annotations

import argparse

from tillcast.operators import explore
from tillcast.operators.labels import TOTAL_THRESHOLD
from tillcast.plans import features as sets
from tillcast.plans import jobs
from tillcast.plans.features import FEATURE_SETS
from tillcast.session import get_session
from tillcast.sources.log import read_keys, read_transactions
from tillcast.sources.sinks import write_predictions


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(prog="tillcast")
    args.add_argument("job", choices=["score", "backtest", "search", "evaluate", "features", "explore"])
    args.add_argument("--log", help="CSV files of order lines; all jobs but evaluate")
    args.add_argument("--labels", help="evaluate: CSV files with customer_id, label")
    args.add_argument("--scores", help="evaluate: CSV files with customer_id, probability")
    args.add_argument("--ym", default="2011-12", help="target month")
    args.add_argument("--features", default="full", choices=sorted(FEATURE_SETS))
    args.add_argument("--threshold", type=float, default=TOTAL_THRESHOLD)
    args.add_argument("--folds", type=int, default=10)
    args.add_argument("--seed", type=int, default=0)
    args.add_argument("--single", action="store_true", help="boosted trees only, no blend")
    args.add_argument("--out", help="score, features: output folder")
    args.add_argument("--keys", help="score: CSV file of the customers to score")
    args.add_argument("--trials", type=int, default=50, help="search: number of draws")
    return args


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_session()
    if args.job == "evaluate":
        if not (args.labels and args.scores):
            parser().error("evaluate needs --labels and --scores")
        jobs.evaluate_files(spark, args.labels, args.scores).show()
        return
    if not args.log:
        parser().error(f"{args.job} needs --log")
    lines = read_transactions(spark, args.log)
    learners = jobs.default_learners(not args.single)
    common = {"folds": args.folds, "seed": args.seed}
    if args.job == "score":
        if not args.out:
            parser().error("score needs --out")
        keys = read_keys(spark, args.keys) if args.keys else None
        scores = jobs.score_month(
            lines, args.ym, args.features, learners, keys=keys, threshold=args.threshold, **common
        )
        write_predictions(scores, args.out)
    elif args.job == "features":
        if not args.out:
            parser().error("features needs --out")
        rows = sets.build(args.features, lines, [args.ym], threshold=args.threshold)
        rows.write.mode("overwrite").parquet(args.out)
    elif args.job == "explore":
        explore.profile(lines).orderBy("column").show(truncate=False)
        explore.histogram(lines, "total", 10).orderBy("bin").show()
    elif args.job == "backtest":
        jobs.backtest(
            lines, args.ym, args.features, args.threshold, learners=learners, **common
        ).show()
    else:
        data = jobs.prepare_month(lines, args.ym, args.features, threshold=args.threshold)
        jobs.random_search(data, trials=args.trials, **common).show(2 * args.trials, truncate=False)


if __name__ == "__main__":
    main()
