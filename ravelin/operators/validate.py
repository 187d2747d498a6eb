"""The output contract: each rule's number of breaches and some examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADERS = {"matches": ("source1_entity_id", "matched_entity_ids"), "candidates": ("source1_entity_id", "candidate_entity_ids")}


def check_header(line: str | None, kind: str) -> str | None:
    """What is wrong with a file's first line (None: no file); nothing if it is as it must be."""
    if line is None:
        return "the file is missing"
    if not line.strip():
        return "the file is empty"
    if "\t" not in line:
        return "the file is comma-separated" if "," in line else "the header has no tab"
    if tuple(x.strip().lower() for x in line.rstrip("\r\n").split("\t")) != HEADERS[kind]:
        return f"the header is not {HEADERS[kind]}"
    return None


def _found(rule: str, severity: str, bad: DataFrame) -> DataFrame:
    """``bad``: one column of examples. ``n`` counts breaches, ``offenders`` what is different among them; counts combine before the shuffle, and the five least examples are shown."""
    few = bad.select(F.col(bad.columns[0]).cast("string").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    shown = few.orderBy("x").limit(5).select("x", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("o"))
    counted = few.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("o")).select(F.lit(None).cast("string").alias("x"), "n", "o")
    both = shown.unionByName(counted).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("o").alias("offenders"), F.array_join(F.sort_array(F.collect_list("x")), ", ").alias("examples"))
    return both.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "offenders", "examples")


def lists_of(lines: DataFrame) -> DataFrame:
    """Rows of a text file (column ``value``, without header): ``s1_id, ids``. Lines without a tab are left out; a blank list has no ids, and in others each item counts as it is written, padded and empty ones too."""
    ok = lines.where(F.contains("value", F.lit("\t")))
    parts = F.split("value", "\t", 2)
    rest = F.get(parts, F.lit(1))
    return ok.select(F.get(parts, F.lit(0)).alias("s1_id"), F.when(rest.rlike(r"\S"), F.split(rest, ",")).otherwise(F.expr("cast(array() as array<string>)")).alias("ids"))


def validate_lists(lists: DataFrame, s1: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Breaches of the rules for ``s1_id, ids``: ``rule, severity, n, examples``, a row for each rule. ``s1`` and ``known`` (targets) need ``entity_id``."""
    each = lists.select("s1_id", F.explode("ids").alias("id"))
    required = s1.select(F.col("entity_id").alias("s1_id"))
    rules = [
        _found("duplicate_row", "error", lists.groupBy("s1_id").count().where("count > 1").select("s1_id")),
        _found("duplicate_in_list", "error", lists.where(F.size(F.array_distinct("ids")) < F.size("ids")).select("s1_id")),
        _found("source1_id_in_list", "error", each.where(F.col("id").startswith("S1-")).select("id")),
        _found("bad_prefix", "error", each.where(~F.col("id").rlike("^S[123]-")).select("id")),
        _found("missing_row", "error", required.join(lists, "s1_id", "left_anti").select("s1_id")),
        _found("extra_row", "error", lists.join(required, "s1_id", "left_anti").select("s1_id")),
    ]
    if known is not None:
        targets = each.where(F.col("id").rlike("^S[23]-"))
        rules.append(_found("unknown_id", "error", targets.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti").select("id")))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def validate_subset(matches: DataFrame, pool: DataFrame) -> DataFrame:
    """A warning for matched ids that are no candidates."""
    pairs = lambda x: x.select("s1_id", F.explode("ids").alias("id"))
    return _found("matched_not_candidate", "warning", pairs(matches).join(pairs(pool), ["s1_id", "id"], "left_anti").select(F.concat_ws(" ", "s1_id", "id").alias("pair")))


def validate_lines(lines: DataFrame) -> DataFrame:
    return _found("no_tab", "error", lines.where((F.trim("value") != "") & ~F.contains("value", F.lit("\t"))).select("value"))


def headed(text: DataFrame) -> tuple[list[str], DataFrame]:
    """The first line of each file of a text table, and the table without these lines."""
    lines = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    first = lines.where("_block = 0").groupBy("_file").agg(F.min(F.struct("_line", "value")).alias("head")).select("_file", "head._line", F.col("head.value").alias("head"))
    heads = [r[0] for r in first.select("head").distinct().orderBy("head").limit(100).collect()]
    return heads, lines.join(F.broadcast(first.select("_file", "_line")), ["_file", "_line"], "left_anti").select("value")


def validate_file(spark, path: str, kind: str, s1: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All rules for a file or a folder of part files, each of which begins with the header."""
    try:
        heads, body = headed(spark.read.text(path))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        heads, body = [None], None
    for head in heads or [""]:
        if fault := check_header(head, kind):
            return spark.createDataFrame([("header", "error", 1, 1, fault)], "rule string, severity string, n bigint, offenders bigint, examples string")
    return validate_lines(body).unionByName(validate_lists(lists_of(body), s1, known))
