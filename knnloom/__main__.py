"""Command line: the join and the point tools.

    python -m knnloom K INPUT TRAINING [options]
    python -m knnloom generate N TARGET [--seed S]
    python -m knnloom multiply SOURCE TARGET FACTOR      (factor 1 converts)
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import FACTORS, generate_uniform, multiply, run_metrics, target_count
from .plans import strategy_mask
from .sources import DIGITS, THIN_DIGITS, load_points, read_points, read_tokens, result_name, write_metrics, write_neighbours, write_points


def _session(threads: int = 0, memory: int = 1024) -> SparkSession:
    return SparkSession.builder.master(f"local[{threads or '*'}]").config("spark.driver.memory", f"{max(memory, 512)}m").getOrCreate()


def generate(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="knnloom generate", description="N uniform points.")
    p.add_argument("n", type=int)
    p.add_argument("target", help=".bin, .parquet or text")
    p.add_argument("--seed", type=int, default=1)
    a = p.parse_args(argv)
    if a.n < 0:
        p.error("N must not be negative")
    write_points(generate_uniform(_session(), a.n, a.seed), a.target)
    print(f"{a.n} points written to {a.target}")


def multiplied(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="knnloom multiply", description="Thins, converts or multiplies a point file.")
    p.add_argument("source")
    p.add_argument("target", help=".bin, .parquet or text")
    p.add_argument("factor", type=int, choices=FACTORS)
    a = p.parse_args(argv)
    points = read_points(_session(), a.source)
    write_points(multiply(points, a.factor), a.target, digits=THIN_DIGITS if a.factor < 0 else DIGITS)
    print(f"{target_count(points.count(), a.factor)} points written to {a.target}")


def join(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="knnloom", description="All k nearest neighbours of INPUT among TRAINING.")
    p.add_argument("k", type=int)
    p.add_argument("input")
    p.add_argument("training")
    p.add_argument("--threads", type=int, default=0, help="local threads; 0: all")
    p.add_argument("--accuracy", type=float, default=1e-15)
    p.add_argument("--stripes", type=int, default=0, help="0: from the size of TRAINING")
    p.add_argument("--mask", default="1" * 30, help="30 digits 0 or 1")
    p.add_argument("--no-compare", action="store_true", help="don't compare results with the first strategy's")
    p.add_argument("--no-pad", action="store_true", help="no empty slots where TRAINING holds fewer than K points")
    p.add_argument("--full", action="store_true", help="write distances with all digits")
    p.add_argument("--save", help="folder for neighbour files")
    p.add_argument("--metrics", help="folder for the metrics CSV, semicolons and decimal commas")
    p.add_argument("--memory", type=int, default=1024, help="MB for the driver")
    a = p.parse_args(argv)
    if a.k < 1:
        p.error("K must be at least 1")
    spark = _session(a.threads, a.memory)
    queries, training, seconds = load_points(spark, a.input, a.training)
    places = None if a.input.endswith((".bin", ".bins", ".parquet")) else read_tokens(spark, a.input, place=True)  # lines in order of a text file
    print(f"loaded in {seconds:.3f} s")

    def save(name, result, took):
        write_neighbours(result, f"{a.save}/{result_name(name, took)}", full=a.full, places=places)

    options = {"stripes": a.stripes} if a.stripes else {}
    metrics = run_metrics(strategy_mask(a.mask), queries, training, a.k, a.accuracy, not a.no_compare, pad=not a.no_pad, save=save if a.save else None, **options).persist()
    metrics.show(truncate=False)
    if a.metrics:
        write_metrics(metrics, a.metrics, localised=True)


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    tool = {"generate": generate, "multiply": multiplied}.get(argv[0] if argv else "")
    tool(argv[1:]) if tool else join(argv)


if __name__ == "__main__":
    main()
