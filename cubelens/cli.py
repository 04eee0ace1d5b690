"""Command line: ``python -m cubelens.cli run-all|run-views|run-stage|run-experiments --config FILE``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import pipeline
from .sources import config, sinks

STAGES = ("data_prep", "dropout", "missingness_threshold", "full_performance", "narrative_analysis", "tiered_performance")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cubelens", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("run-all", "run-views", "run-document-level", "run-document-complete", "run-stage", "run-experiments"):
        p = sub.add_parser(name)
        p.add_argument("--config", required=True)
        if name == "run-stage":
            p.add_argument("--stage", required=True, choices=STAGES)
    return top


def run_stage(spark: SparkSession, cfg: config.AnalysisConfig, stage: str, column: str = "full_response") -> pipeline.Tables:
    """One stage over the rows that ``data_prep`` has written, merged or else parsed ones; without any over freshly prepared ones.

    Only the stage's tables are written; those of its earlier run that it doesn't make again are deleted.
    """
    prepared: pipeline.Tables = {}
    cube = None if stage == "data_prep" else sinks.read_table(spark, cfg.output_dir, "merged_outputs", "parsed_outputs")
    summary = None if stage == "data_prep" else sinks.read_table(spark, cfg.output_dir, "llm_json_processing_summary")
    if cube is None or summary is None:
        prepared = pipeline.data_prep(spark, cfg)
        cube, summary = prepared["merged_outputs"], prepared["llm_json_processing_summary"]
    stages = {
        "data_prep": lambda: prepared,
        "dropout": lambda: pipeline.dropout(summary),
        "missingness_threshold": lambda: pipeline.missingness_threshold(cube, cfg.truth_mode),
        "full_performance": lambda: pipeline.full_performance(cube, cfg.truth_mode, cfg.bootstrap_iterations, cfg.random_seed, not cfg.enable_temperature_analysis),
        "narrative_analysis": lambda: pipeline.narrative_analysis(cube, column, cfg.truth_mode),
        "tiered_performance": lambda: pipeline.tiered_performance(cube, cfg.bootstrap_iterations, cfg.random_seed),
    }
    try:
        made = stages[stage]()
        if made:
            sinks.write_tables(made, cfg.output_dir, stage=stage)
    finally:
        pipeline.release(prepared)
    return made


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cubelens").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    if args.command == "run-experiments":
        pipeline.run_experiments(spark, config.load_client(args.config))
        return 0
    cfg = config.load_analysis(args.config)
    if args.command == "run-stage":
        run_stage(spark, cfg, args.stage)
    elif args.command == "run-views":
        pipeline.run_views(spark, cfg)
    else:
        mode = {"run-document-level": "document", "run-document-complete": "document_complete"}.get(args.command)
        pipeline.run_all(spark, cfg.variant(cfg.validation_level, mode) if mode else cfg)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
