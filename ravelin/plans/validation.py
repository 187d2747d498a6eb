"""Command line that checks result files: python -m ravelin.plans.validation -m FILE [-c FILE] -t FOLDER [--check-ids]. Ends with 1 if a file breaks a rule."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ravelin.operators import validate
from ravelin.sources import tables


def report(spark: SparkSession, matching: str, candidates: str | None, folder: str, check_ids: bool = False) -> list[tuple[str, str, str, int, str]]:
    """The rules that are broken: file, severity, rule, number of offenders, examples. ``folder`` holds test_source1.tsv, and for ``check_ids`` those of the other sources."""
    s1 = tables.read_tsv(spark, f"{folder}/test_source1.tsv")
    known = tables.read_tsv(spark, f"{folder}/test_source2.tsv").unionByName(tables.read_tsv(spark, f"{folder}/test_source3.tsv")) if check_ids else None
    found, lists = [], {}
    for kind, path in (("matches", matching), ("candidates", candidates)):
        if path is None:
            continue
        rows = validate.validate_file(spark, path, kind, s1, known).where("n > 0").collect()
        found += [(path, r.severity, r.rule, r.offenders, r.examples) for r in rows]
        if not any(r.rule == "header" for r in rows):
            lists[kind] = validate.lists_of(validate.headed(spark.read.text(path))[1])
    if len(lists) == 2:
        found += [(matching, r.severity, r.rule, r.offenders, r.examples) for r in validate.validate_subset(lists["matches"], lists["candidates"]).where("n > 0").collect()]
    return found


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Check result files")
    parser.add_argument("--matching", "-m", default="output/matching_results.tsv")
    parser.add_argument("--candidate", "-c", default=None, help="left out: not checked")
    parser.add_argument("--test-dir", "-t", default="dataset/test")
    parser.add_argument("--check-ids", action="store_true", help="also look every id up in the sources")
    args = parser.parse_args(arguments)
    found = report(SparkSession.builder.getOrCreate(), args.matching, args.candidate, args.test_dir, args.check_ids)
    for path, severity, rule, n, examples in found:
        print(f"{severity}: {path}: {rule}: {n}: {examples}")
    wrong = any(x[1] == "error" for x in found)
    print("FAIL" if wrong else "PASS")
    return int(wrong)


if __name__ == "__main__":
    sys.exit(main())
