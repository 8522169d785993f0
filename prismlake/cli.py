"""python -m prismlake.cli {prepare,process,score} --root TABLES PROJECT ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from prismlake import config as cfg
from prismlake.catalog import Catalog
from prismlake.plans import project as projects
from prismlake.sources import images as sources


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="prismlake")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("prepare")
    p.add_argument("source", choices=[*sources.SOURCES, "local"])
    p.add_argument("category", nargs="?")
    p.add_argument("--data", required=True, help="the dataset's folder (with --all: of all categories)")
    p.add_argument("--all", action="store_true")
    p.add_argument("--download", action="store_true", help="fetch what isn't below the folder of --data yet")
    q = sub.add_parser("process")
    q.add_argument("project")
    q.add_argument("--force", choices=cfg.STAGES)
    q.add_argument("--compat", action="store_true", help="historic hashes, and stages without input are left out")
    r = sub.add_parser("score")
    r.add_argument("project")
    r.add_argument("--method", choices=["mean", "max", "sum"])
    r.add_argument("--min-pct", type=float)
    r.add_argument("--max-pct", type=float)
    r.add_argument("--pixel-sample", type=int, default=100_000)
    for x in (p, q, r):
        x.add_argument("--root", required=True, help="folder of the tables")
        x.add_argument("--config", help="YAML file over the defaults")
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("prismlake").getOrCreate()
    catalog = Catalog(spark, args.root)
    config = cfg.load(args.config) if args.config else cfg.merged(cfg.DEFAULTS, catalog.project_config(args.project)) if args.command != "prepare" else cfg.DEFAULTS
    if args.command == "prepare":
        wanted = sources.SOURCES.get(args.source, []) if args.all else [args.category]
        failed = 0
        for category in wanted:
            try:
                folder = f"{args.data}/{category}" if args.all and args.source != "visa" and not args.download else args.data
                project = projects.prepare_project(catalog, args.source, category, folder, download=args.download)
                if args.config:
                    catalog.save_project_config(project, config)
                print("prepared", project)
            except (OSError, ValueError) as error:
                failed += 1
                print(f"{category}: {error}")
        return int(failed > 0)
    if args.command == "process":
        print(json.dumps(projects.process_project(catalog, args.project, config, force_from=args.force, compat=args.compat)))
        return 0
    found = projects.score_project(catalog, args.project, config, method=args.method, min_pct=args.min_pct, max_pct=args.max_pct, pixel_sample=args.pixel_sample)
    print(json.dumps(found))
    return int(found is None)


if __name__ == "__main__":
    raise SystemExit(main())
