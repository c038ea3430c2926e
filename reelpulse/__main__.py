"""Command line / spark-submit entry point.

    python -m reelpulse list
    python -m reelpulse run <operator> <sf_dir> [--out PATH] [--format parquet|csv|json] [--show N]
    python -m reelpulse marts <sf_dir> <out_dir> [--no-models]

``run`` evaluates one registered operator over the given tables and either
writes the full result (distributed write, no collect) or shows its first rows.
``marts`` builds the session mart, KPI marts, forecast, recommendations, run
metrics and models (P20).  The session comes from the platform when submitted
to a cluster; locally a ``local[*]`` session is created.
"""

from __future__ import annotations

import argparse
import sys

from .plans import registry
from .session import get_spark
from .sources import sinks


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="reelpulse")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the registered operators")
    run = sub.add_parser("run", help="run one operator")
    run.add_argument("operator")
    run.add_argument("sf_dir")
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    run.add_argument("--show", type=int, default=20)
    marts = sub.add_parser("marts", help="build marts and models")
    marts.add_argument("sf_dir")
    marts.add_argument("out_dir")
    marts.add_argument("--no-models", action="store_true")
    args = ap.parse_args(argv)

    if args.cmd == "list":
        for name in registry.queries():
            print(f"{name}\t{registry.binding_of(name)}")
        return 0
    spark = get_spark()
    if args.cmd == "run":
        queries = registry.queries()
        if args.operator not in queries:
            print(f"unknown operator {args.operator!r}; see `python -m reelpulse list`", file=sys.stderr)
            return 2
        df = queries[args.operator](spark, args.sf_dir)
        if args.out:
            {"parquet": sinks.write_parquet, "csv": sinks.write_csv, "json": sinks.write_json}[args.format](
                df, args.out)
            print(args.out)
        else:
            df.show(args.show, truncate=False)
        return 0
    out = sinks.build_marts(spark, args.sf_dir, args.out_dir, with_models=not args.no_models)
    for name, path in out.items():
        print(f"{name}\t{path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
