"""Command line: run registered queries over a folder of tables, or the gate as a check.

python -m quarrylane.cli query NAME --tables DIR [--out FOLDER] [--condition B] [--model PART] [--strategy cot]
python -m quarrylane.cli gate --tables DIR [--no-gate]
python -m quarrylane.cli list
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import CORE


def registered() -> dict:
    """The core's queries by name."""
    return {k: f for m in CORE for k, f in importlib.import_module(f"quarrylane.plans.{m}").QUERIES.items()}


def narrowed(df: DataFrame, condition: str | None, model: str | None, strategy: str | None) -> DataFrame:
    """Rows of the cells asked for; a filter on a column that the result lacks is an error. model is any part of the name."""
    for column, value in (("condition", condition), ("model_key", model), ("strategy", strategy)):
        if value is None:
            continue
        if column not in df.columns:
            raise ValueError(f"the result has no column {column}")
        df = df.where(F.contains(F.col(column), F.lit(value)) if column == "model_key" else F.col(column) == value)
    return df


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code: 0, or 1 for a breached gate."""
    parser = argparse.ArgumentParser(prog="quarrylane")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    query = sub.add_parser("query")
    query.add_argument("name")
    gate = sub.add_parser("gate")
    gate.add_argument("--no-gate", action="store_true", help="report only")
    for p in (query, gate):
        p.add_argument("--tables", required=True)
    query.add_argument("--out", help="folder to write Parquet to instead of printing")
    query.add_argument("--rows", type=int, default=20, help="rows to print")
    for name in ("--condition", "--model", "--strategy"):
        query.add_argument(name)
    args = parser.parse_args(argv)
    queries = registered()
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "gate":
        rows = queries["leakage_gate"](spark, args.tables).collect()  # a row for each channel
        print("\n".join(json.dumps(r.asDict()) for r in rows))
        return int(any(r.breach for r in rows) and not args.no_gate)
    df = narrowed(queries[args.name](spark, args.tables), args.condition, args.model, args.strategy)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
