"""Command line: the batch entry points of the reference, on Spark.

  python -m souq list
  python -m souq query NAME [--sf-dir DIR] [--show N] [--out PATH]
  python -m souq build --out BASE [--sf-dir DIR]        warehouse build (E1)
  python -m souq metric NAME [--group-by COL] [--sf-dir DIR]   governed metric (E2)
  python -m souq scorecard [--sf-dir DIR]               data-quality scorecard (E4)

On a cluster submit with spark-submit; ``--master`` is only for local runs.
"""

from __future__ import annotations

import argparse
import sys

DEFAULT_DIR = "/root/testdata/sf0.01"


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="souq")
    ap.add_argument("--master", default=None)
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name")
    b = sub.add_parser("build")
    b.add_argument("--out", required=True)
    m = sub.add_parser("metric")
    m.add_argument("name")
    m.add_argument("--group-by", default="store_id")
    sc = sub.add_parser("scorecard")
    for p in (q, b, m, sc):
        p.add_argument("--sf-dir", default=DEFAULT_DIR)
    for p in (q, m, sc):
        p.add_argument("--show", type=int, default=20)
        p.add_argument("--out", default=None, help="write the result as Parquet instead of showing it")
    args = ap.parse_args(argv)

    from .queries import queries, star_for
    if args.cmd == "list":
        for name in sorted(queries()):
            print(name)
        return 0

    from .session import get_spark
    spark = get_spark("souq-cli", master=args.master)
    star = star_for(spark, args.sf_dir)
    if args.cmd == "query":
        qs = queries()
        if args.name not in qs:
            print(f"unknown query {args.name!r}; see `python -m souq list`", file=sys.stderr)
            return 2
        df = qs[args.name](spark, args.sf_dir)
    elif args.cmd == "metric":
        from .operators.semantic import compile_metric
        df = compile_metric(star.tables(), args.name, args.group_by)
    elif args.cmd == "scorecard":
        from .operators.quality import dq_scorecard
        d = star.d
        df = dq_scorecard(d.orders, d.order_items, d.payments, star.fact_orders, star.as_of)
    else:  # build
        from .plans.build import build_warehouse
        for name, path in build_warehouse(star, args.out).items():
            print(f"{name}\t{path}")
        return 0
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
        print(args.out)
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
