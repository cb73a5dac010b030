"""Command line: python -m maskwright.cli --input lines.txt [--output folder] [--steps nfkc,digits]; or corpus --out folder --n-sentences 1000."""

from __future__ import annotations

import argparse
import importlib


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from maskwright.functions.session import ship
    from maskwright.operators.normalize import STEPS
    from maskwright.operators.redact import Pipeline
    from maskwright.operators.synth import corpus
    from maskwright.sources import io

    p = argparse.ArgumentParser(prog="maskwright")
    p.add_argument("command", nargs="?", choices=("redact", "corpus"), default="redact")
    p.add_argument("--input")
    p.add_argument("--output")
    p.add_argument("--steps", default=",".join(STEPS))
    p.add_argument("--checkpoint", help="a model's folder; --loader turns it into a column function of neural spans")
    p.add_argument("--loader", help="module:function that loads a checkpoint")
    p.add_argument("--no-neural", action="store_true", help="rules only, whatever checkpoint is given")
    p.add_argument("--out")
    p.add_argument("--n-sentences", type=int, default=1000)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--arabizi-rate", type=float, default=0.3)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("maskwright").getOrCreate()
    ship(spark)
    if a.command == "corpus":
        if not a.out:
            p.error("corpus needs --out")
        io.write_records(corpus(spark, a.n_sentences, a.seed, a.arabizi_rate), a.out)
        return 0
    if not a.input:
        p.error("redact needs --input")
    steps = tuple(s for s in a.steps.split(",") if s)
    pipeline = Pipeline(steps)
    if a.checkpoint and not a.no_neural:
        if not a.loader:
            p.error("--checkpoint needs --loader")
        module, _, name = a.loader.partition(":")
        pipeline = Pipeline.from_checkpoint(a.checkpoint, getattr(importlib.import_module(module), name), steps=steps)
    out = pipeline.redact(io.read_lines(spark, a.input))
    if a.output:
        io.write_lines(out, a.output)
    else:
        for r in out.select("redacted").toLocalIterator():
            print(r[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
