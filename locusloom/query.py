"""The older form of the query command: ``python -m locusloom.query --compressed STORE --coverage --chrom C [--start S --end E] [--gtf GTF]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .__main__ import main


def older(arguments: list[str], spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="locusloom.query", description=__doc__)
    p.add_argument("--compressed", required=True)
    which = p.add_mutually_exclusive_group(required=True)
    for name in ("bundles", "coverage", "reads", "counts"):
        which.add_argument(f"--{name}", dest="what", action="store_const", const=name)
    for name in ("chrom", "start", "end", "gtf"):
        p.add_argument(f"--{name}")
    a = p.parse_args(arguments)
    rest = [x for name in ("chrom", "start", "end", "gtf") if (v := getattr(a, name)) is not None for x in (f"--{name}", v)]
    main(["query", f"--{a.what}", *rest, a.compressed], spark)


if __name__ == "__main__":
    older(sys.argv[1:])
