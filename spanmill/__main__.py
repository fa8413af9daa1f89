"""Command line: python -m spanmill extract | build | train | predict."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import model, workflow


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanmill")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("extract")
    for a in ("vcf", "bam", "ref", "out"):
        p.add_argument(f"--{a}", required=True)
    p.add_argument("--chroms", nargs="+", default=list(workflow.CHROMOSOMES))
    p.add_argument("--chunk-size", type=int, default=1_000_000)
    p.add_argument("--mode", choices=("strict", "compat"), default="strict")
    p = sub.add_parser("build")
    for a in ("features", "out"):
        p.add_argument(f"--{a}", required=True)
    for a in ("tp", "fp", "vcf", "truth", "bed", "ref"):
        p.add_argument(f"--{a}")
    p = sub.add_parser("train")
    for a in ("data", "out"):
        p.add_argument(f"--{a}", required=True)
    p.add_argument("--split-by-chrom", action="store_true")
    p.add_argument("--rounds", type=int, default=model.ROUNDS)
    p = sub.add_parser("predict")
    for a in ("features", "vcf", "model", "out"):
        p.add_argument(f"--{a}", required=True)
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"spanmill-{a.command}").getOrCreate()
    if a.command == "extract":
        workflow.require(a.vcf, a.bam, a.ref, a.ref + ".fai")
        workflow.extract(spark, a.vcf, a.bam, a.ref, a.out, chroms=a.chroms, mode=a.mode, chunk=a.chunk_size)
    elif a.command == "build":
        print(json.dumps(workflow.build(spark, a.features, a.out, tp=a.tp, fp=a.fp, vcf=a.vcf, truth=a.truth, bed=a.bed, ref=a.ref)))
    elif a.command == "train":
        print(json.dumps(workflow.train(spark, a.data, a.out, by_chromosome=a.split_by_chrom, rounds=a.rounds)))
    else:
        print(json.dumps(workflow.predict(spark, a.features, a.vcf, a.model, a.out)))


if __name__ == "__main__":
    main()
