"""Command line: ``python -m evidentia run NAME --data DIR``, ``list``, ``sql NAME``, ``view VIEW --data DIR``, ``phases --log DIR``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from evidentia.operators.reports import console_table

#: What a user asks for, as the queries that answer it.
VIEWS = {
    "status": ("table_summary", "group_counts", "cost_by_phase"),
    "validate": ("known_connections", "known_recall", "recall_metric"),
    "conjectures": ("prediction_join", "status_lattice", "convergence_rows"),
    "analyze": ("comparison_table", "prediction_gaps", "novelty_bands"),
    "compare": ("compare_all", "compare_topic", "weighted_match_score"),
    "cite-check": ("uncited_pairs", "novel_matches"),
    "premises": ("shared_items", "droppable_premises", "premise_rank"),
    "assumptions": ("premises_by_group",),
    "contradictions": ("pair_severity", "contradiction_inputs"),
    "convergences": ("convergence_strength", "ordered_by_agreement"),
    "obstacles": ("symptom_obstacle", "mark_universal"),
    "interrogate": ("skeleton_groups", "parity_scan", "coefficient_ratios", "limit_disagreement", "substitution_matches"),
    "symptoms": ("symptoms_all",),
    "historical-match": ("profile_knn", "records_by_error", "turning_point_match"),
    "breakthrough-report": ("symptoms_all", "records_by_error", "augment_all", "suggestions"),
    "investigate-top": ("worth_investigating",),
    "duplicates": ("exact_dup_clusters", "duplicate_tiers"),
    "patterns": ("density_clusters", "cluster_summary", "unexpected_agreement", "missing_outliers"),
    "graph": ("pagerank", "group_flow", "bridge_score", "connected_components"),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="evidentia", description=__doc__)
    tasks = out.add_subparsers(dest="task", required=True)
    tasks.add_parser("list", help="names of the queries")
    sql = tasks.add_parser("sql", help="a query's DuckDB equivalent")
    sql.add_argument("name")
    for task, what in (("run", "name"), ("view", "view")):
        one = tasks.add_parser(task)
        one.add_argument(what, choices=sorted(VIEWS) if task == "view" else None)
        one.add_argument("--data", required=True, help="folder of the tables")
        one.add_argument("--out", help="folder for Parquet files, instead of the console")
        one.add_argument("--rows", type=int, default=20, help="rows shown of each query")
    phases = tasks.add_parser("phases", help="what a phase log says")
    phases.add_argument("--log", required=True)
    phases.add_argument("--reset", action="store_true", help="begin anew: every phase is marked as pending")
    return out


def main(given: Sequence[str] | None = None) -> int:
    args = parser().parse_args(given)
    from evidentia.plans import catalogue

    if args.task == "list":
        print("\n".join(f"{name}{'' if name in catalogue.ORACLES else '  (no SQL)'}" for name in sorted(catalogue.QUERIES)))
        return 0
    if args.task == "sql":
        print(catalogue.ORACLES.get(args.name, "none"))
        return int(args.name not in catalogue.QUERIES)

    from evidentia.session import session

    spark = session()
    if args.task == "phases":
        from evidentia.streaming.incremental import PHASES, PhaseLog

        log = PhaseLog(spark, args.log, PHASES)
        for phase in PHASES if args.reset else ():
            log.set(phase, "pending")
        print(console_table(log.statuses(), ["phase"], len(PHASES)), f"\nnext: {log.next()}")
        return 0
    names = VIEWS[args.view] if args.task == "view" else (args.name,)
    if missing := [n for n in names if n not in catalogue.QUERIES]:
        print("unknown:", ", ".join(missing))
        return 1
    for name in names:
        df = catalogue.QUERIES[name](spark, args.data)
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        else:
            print(f"\n{name}\n{console_table(df, df.columns, args.rows)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
