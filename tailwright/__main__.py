"""The analysis from the command line, on whatever cluster spark-submit or the session's settings name.

    spark-submit ... -m tailwright sample --reads r.fa --genome g.fa --annotations list.txt --priority prio.txt --out folder
    python -m tailwright cohort --manifest group1.txt --manifest group2.txt --out folder

A manifest has a line for each sample: the path of its annotation summary and, for the reads' form, that of its
annotated reads; its group is the file's name.
"""

from __future__ import annotations

import argparse
from dataclasses import fields
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from tailwright.plans import files
from tailwright.plans.pipeline import Settings
from tailwright.sources import readers

#: Inputs of a sample that may be left out, with what they are.
OPTIONAL = {"repeats": "intervals of repeats (BED)", "psl": "hits of a second aligner", "snps": "known variants", "fastq": "raw reads with qualities", "aligner": "a file of aligner commands"}
#: What a setting limits, by its name.
LIMITS = {
    "species": "class of the reads that a second aligner judges", "level": "stringency, 1 to 3", "share": "least share of an annotation's commonest end",
    "least_percent": "least percentage of a heterozygous variant", "most_percent": "most percentage of it", "quality": "least base quality of a modification",
    "reads": "least reads of a modification in a sample", "samples": "least samples with it", "compat": "order-dependent forms of older tools", "snp_rule": "'any' base that is a variant removes a modification, or cut from the 'end'",
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tailwright", description="End modifications of small RNAs, from files to files.")
    steps = top.add_subparsers(dest="step", required=True)
    one = steps.add_parser("sample", help="every table of one sample")
    for name in ("reads", "genome", "annotations", "priority", "out"):
        one.add_argument(f"--{name}", required=True, dest="reads_path" if name == "reads" else name)
    for name, text in OPTIONAL.items():
        one.add_argument(f"--{name}", help=text)
    many = steps.add_parser("cohort", help="modifications that several samples support")
    many.add_argument("--manifest", action="append", required=True)
    many.add_argument("--out", required=True)
    for step in (one, many):
        for f in fields(Settings):
            flag = f"--{f.name.replace('_', '-')}" if f.name != "reads" else "--least-reads"
            if isinstance(f.default, bool):
                step.add_argument(flag, dest=f.name, action="store_true", help=LIMITS[f.name])
            else:
                step.add_argument(flag, dest=f.name, type=type(f.default), default=f.default, help=f"{LIMITS[f.name]} ({f.default})")
    return top


def run(spark: SparkSession, arguments: list[str]) -> dict[str, str]:
    """Runs a step; the paths of the tables that it has written, by name."""
    a = parser().parse_args(arguments)
    settings = Settings(**{f.name: getattr(a, f.name) for f in fields(Settings)})
    if a.step == "sample":
        p = files.sample(spark, a.reads_path, a.genome, a.annotations, a.priority, settings, **{name: getattr(a, name) for name in OPTIONAL})
        return files.write(p, a.out)
    summaries, reads = {}, {}
    for path in a.manifest:
        group = PurePosixPath(path).stem
        for r in readers.sample_manifest(spark, path, group).collect():
            summaries[group, str(r["sample"])] = r["summary_path"]
            if r["overlap_path"]:
                reads[group, str(r["sample"])] = r["overlap_path"]
    return files.write_cohort(spark, summaries, a.out, settings, reads or None)


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("tailwright").getOrCreate()
    try:
        for name, path in run(spark, sys.argv[1:]).items():
            print(f"{name}\t{path}")
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
