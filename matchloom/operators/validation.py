"""Integrity rules of output files, as a table of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import exists, strings

ERROR, WARNING = "error", "warning"
HEADERS = {"matches": ["source1_entity_id", "matched_entity_ids"], "candidates": ["source1_entity_id", "candidate_entity_ids"]}


def header_problem(spark: SparkSession, path: str, expected: list[str]) -> str | None:
    """V1: what is wrong with a file's existence or first line."""
    if not exists(spark, path):
        return "file not found"
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return "empty"
    if not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty():
        return "not UTF-8"
    line = first[0].value
    if "\t" not in line and "," in line:
        return "comma-separated"
    return None if [c.strip().lower() for c in line.split("\t")] == expected else "unexpected header"


def parse(lines: DataFrame) -> DataFrame:
    """(s1_id, ids, malformed) of text lines (value) after the header: ids aren't trimmed; a blank line isn't a row."""
    x = lines.where(F.trim("value") != "")
    rest = F.substring("value", F.instr("value", "\t") + 1, F.length("value"))
    none = F.array().cast("array<string>")
    ids = F.when(F.instr("value", "\t") > 0, F.when(F.trim(rest) == "", none).otherwise(F.split(rest, ","))).otherwise(none)
    return x.select(F.split("value", "\t")[0].alias("s1_id"), ids.alias("ids"), (F.instr("value", "\t") == 0).alias("malformed"))


def _finding(bad: DataFrame, rule: str, name: str, severity: str = ERROR) -> DataFrame:
    """severity, rule, file, n and the first five offenders of bad (x), if there are any. Each task keeps its
    five least; only those meet."""
    x = bad.select(F.col("x").cast("string").alias("x")).distinct()
    n = x.agg(F.count("*").alias("n"))
    five = x.orderBy("x").limit(5).agg(F.sort_array(F.collect_list("x")).alias("examples"))
    return n.crossJoin(five).where("n > 0").select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(name).alias("file"), "n", F.array_join("examples", ",").alias("examples"))  # one row each


def findings(rows: DataFrame, required: DataFrame, name: str, valid: DataFrame | None = None) -> DataFrame:
    """Rules V2 to V8 on rows (s1_id, ids, malformed). required: entity_id of S1; valid: entity_id of S2 and S3."""
    ok = rows.where(~F.col("malformed"))
    each = ok.select(F.explode(F.array_distinct("ids")).alias("x"))
    good = each.where(F.col("x").rlike("^S[23]-"))
    need, have = required.select(F.col("entity_id").alias("x")).distinct(), ok.select(F.col("s1_id").alias("x")).distinct()
    parts = [
        _finding(rows.where("malformed").select(F.col("s1_id").alias("x")), "V2_malformed_row", name),
        _finding(ok.groupBy("s1_id").count().where("count > 1").select(F.col("s1_id").alias("x")), "V3_duplicate_row", name),
        _finding(ok.where(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.col("s1_id").alias("x")), "V4_repeated_id", name),
        _finding(each.where(F.col("x").startswith("S1-")), "V5_self_match", name),
        _finding(each.where(~F.col("x").rlike("^S[123]-")), "V6_wrong_prefix", name),
        _finding(need.join(have, "x", "left_anti"), "V8_missing", name),
        _finding(have.join(need, "x", "left_anti"), "V8_extra", name),
    ]
    if valid is not None:
        parts.append(_finding(good.join(valid.select(F.col("entity_id").alias("x")), "x", "left_anti"), "V7_unknown_id", name))
    return reduce(DataFrame.unionByName, parts)


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """V9: rows with a match that isn't one of their candidates."""
    c = candidates.groupBy("s1_id").agg(F.flatten(F.collect_list("ids")).alias("_c"))
    x = matches.join(c, "s1_id").where(F.size(F.array_except("ids", "_c")) > 0)
    return _finding(x.select(F.col("s1_id").alias("x")), "V9_outside_candidates", "matches", WARNING)


def validate(spark: SparkSession, matches: str, candidates: str | None, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """All findings (severity, rule, file, n, examples) of output files."""
    out, read = [], {}
    for name, path in (("matches", matches), ("candidates", candidates)):
        problem = header_problem(spark, path, HEADERS[name]) if path else "file not found"
        if problem == "file not found" and name == "candidates":
            out.append(_note(spark, WARNING, "V10_no_candidates", name))
        elif problem:
            out.append(_note(spark, ERROR, f"V1_{problem.replace(' ', '_')}", name))
        else:
            lines = spark.read.text(path)
            read[name] = parse(lines.where(F.lower(F.regexp_replace("value", r"\s", "")) != "".join(HEADERS[name])))
            out.append(findings(read[name], required, name, valid))
    if valid is None:
        out.append(_note(spark, WARNING, "V10_ids_not_checked", "matches"))
    if len(read) == 2:
        out.append(outside_candidates(read["matches"], read["candidates"]))
    return reduce(DataFrame.unionByName, out)


def _note(spark: SparkSession, severity: str, rule: str, name: str) -> DataFrame:
    return spark.createDataFrame([(severity, rule, name, "")], strings("severity", "rule", "file", "examples")).select("severity", "rule", "file", F.lit(1).cast("long").alias("n"), "examples")


def passed(report: DataFrame) -> bool:
    return report.where(F.col("severity") == ERROR).isEmpty()
