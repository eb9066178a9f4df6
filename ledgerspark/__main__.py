"""python -m ledgerspark STAGE --out DIR [--raw DIR] [--questions FILE] [--companies FILE] [--gold FILE] [--limit N]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from ledgerspark.plans import stages
from ledgerspark.sources import files


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ledgerspark", description=__doc__)
    p.add_argument("stage", choices=["fetch", *stages.ORDER, "eval", "all"])
    for name in ("out", "raw", "questions", "companies", "gold", "source"):
        p.add_argument(f"--{name}")
    p.add_argument("--limit", type=int)
    a = p.parse_args(argv)
    needs = {"fetch": ("source", "raw"), "corpus": ("raw", "out"), "index": ("out",), "infer": ("out", "questions"), "package": ("out", "questions"), "eval": ("out", "gold"), "verify": ("out",), "all": ("raw", "out", "questions")}
    missing = [n for n in needs[a.stage] if not getattr(a, n)]
    if missing:
        p.error(f"{a.stage} needs --{' --'.join(missing)}")
    spark = SparkSession.builder.appName("ledgerspark").getOrCreate()
    if a.stage == "fetch":
        files.fetch(spark, a.source, a.raw)
    elif a.stage == "corpus":
        stages.run_corpus(spark, a.raw, a.out, a.limit)
    elif a.stage == "index":
        stages.run_index(spark, a.out)
    elif a.stage == "infer":
        stages.run_infer(spark, a.out, a.questions, a.companies, a.limit)
    elif a.stage == "package":
        print(stages.run_package(spark, a.out, a.questions))
    elif a.stage == "eval":
        print(json.dumps(stages.run_eval(spark, a.out, a.gold), ensure_ascii=False, indent=1))
    elif a.stage == "verify":
        stages.run_verify(spark, a.out)
    else:
        stages.run_all(spark, a.raw, a.out, a.questions, a.companies)


if __name__ == "__main__":
    main()
