"""Reading and writing: TSV sources, ground truth, outputs, artifacts."""

from __future__ import annotations

import json
import os
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import text as X, vocab

FIELDS = ("entity_id", "business_name", "business_address", "country")


def load_config(path: str) -> dict:
    """A nested mapping from YAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, missing ones as ''."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote='"', escape='"', multiLine=False)
    return df.select(*(_present(F.col(f"`{c}`")).alias(c) for c in df.columns))


def _present(c: Column) -> Column:
    return F.when(c.isNull() | c.isin(*vocab.MISSING), "").otherwise(c)


def scan_source(spark: SparkSession, path: str) -> DataFrame:
    """A source's rows; its four fields must be there, more may be. A missing file is Spark's error."""
    df = _tsv(spark, path)
    if lacking := [f for f in FIELDS if f not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return df


def scan_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Names and addresses only, of those source files that are there."""
    found = [scan_source(spark, p).select("entity_id", "business_name", "business_address") for p in paths if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], strings("entity_id", "business_name", "business_address"))
    return reduce(DataFrame.unionByName, found)


def scan_truth(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path)


def parse_truth(truth: DataFrame) -> DataFrame:
    """(s1_id, matches): the listed ids, trimmed, none of them empty; [] is a singleton."""
    ids = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return truth.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("matches"))


def scan_sources(spark: SparkSession, config: dict, mode: str) -> dict[str, DataFrame]:
    """S1, S2 and S3 of the training or the test set."""
    if mode not in ("train", "test"):
        raise ValueError(f"mode is train or test, not {mode}")
    paths = config["paths"]
    return {f"S{i}": scan_source(spark, os.path.join(paths.get("base_dir", ""), paths[f"{mode}_source{i}"])) for i in (1, 2, 3)}


def last_wins(df: DataFrame, key: str = "entity_id") -> DataFrame:
    """One row a key: the fields of its last row at the place of its first. df has seq."""
    w = Window.partitionBy(key)
    x = df.withColumn("_last", F.row_number().over(w.orderBy(F.desc("seq")))).withColumn("_first", F.min("seq").over(w))
    return x.where("_last = 1").withColumn("seq", F.col("_first")).drop("_last", "_first")


def with_seq(df: DataFrame, start: int = 0) -> DataFrame:
    """Adds seq, which follows the order of the file (not without gaps)."""
    return df.withColumn("seq", F.monotonically_increasing_id() + F.lit(start))


def in_country(df: DataFrame, country: str, fallback: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """Rows of a country; for '' and `unknown` those without one. If there are none, in existing
    neither, then all rows."""
    want = "" if country.strip().lower() in ("", "unknown") else country.strip().lower()
    own = df.where(F.lower(F.trim("country")) == want)
    if want == "" and fallback and own.isEmpty() and (existing is None or existing.isEmpty()):
        own = df
    return own if existing is None else existing.unionByName(own)


def records(df: DataFrame) -> DataFrame:
    """Normalised records of rows (the four fields, seq): names, addresses, their parts and tokens."""
    c, a = F.lower(F.trim("country")), F.coalesce("business_address", F.lit(""))
    a = F.when(F.trim(a).isin("", "nan"), "").otherwise(a)
    x = df.select("entity_id", "seq", F.split("entity_id", "-")[0].alias("source"), c.alias("country"), F.coalesce("business_name", F.lit("")).alias("original_name"), a.alias("original_address"))
    x = x.withColumn("part", F.when(F.col("country") == "", "unknown").otherwise(F.col("country")))
    x = x.withColumn("name_tokens", X.name_tokens(F.col("original_name"))).withColumn("_address", X.address_tokens(F.col("original_address")))
    a = F.col("original_address")
    city, state = X.city_state(a)
    x = x.select(
        "*", X.joined(F.col("name_tokens")).alias("name"), X.compact(F.col("name_tokens")).alias("compact_name"), X.joined(F.col("_address")).alias("address"),
        X.postal(a, F.col("country")).alias("postal_code"), X.house_number(a).alias("house_number"), X.landmark(a).alias("landmark"), city.alias("city"), state.alias("state"),
    ).drop("_address")
    x = x.withColumn("address_tokens", X.tokens(F.col("address"))).withColumn("numeric_tokens", X.digit_tokens(F.col("name"), F.col("address")))
    return x.withColumn("record_text", F.concat_ws(" ", "name", "address"))


def source_of(c: Column) -> Column:
    return F.when(c.startswith("S2"), "S2").otherwise("S3")


def listed(s1: DataFrame, pairs: DataFrame, name: str, prefixed: bool = False) -> DataFrame:
    """(source1_entity_id, name): each S1 row's candidates in order of rank, once each, as a comma list.
    prefixed: only S2- and S3- ids. pairs: s1_id, candidate_id, rank."""
    if prefixed:
        pairs = pairs.where(F.col("candidate_id").rlike("^S[23]-"))
    own = pairs.groupBy("s1_id", "candidate_id").agg(F.min("rank").alias("rank")).groupBy("s1_id").agg(F.sort_array(F.collect_list(F.struct("rank", "candidate_id"))).alias("ids"))
    ids = F.array_join(F.transform("ids", lambda x: x["candidate_id"]), ",")
    return s1.select(F.col("entity_id").alias("s1_id")).distinct().join(own, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(ids, F.lit("")).alias(name))


def write_candidates(s1: DataFrame, pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    listed(s1, pairs, "candidate_entity_ids").write.mode(mode).csv(path, sep="\t", header=True, emptyValue="")


def write_matches(s1: DataFrame, pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    listed(s1, pairs, "matched_entity_ids", True).write.mode(mode).csv(path, sep="\t", header=True, emptyValue="")


def write_baseline(s1: DataFrame, path: str) -> None:
    """Every S1 row with no match."""
    s1.select(F.col("entity_id").alias("source1_entity_id"), F.lit("").alias("matched_entity_ids")).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def merged_baseline(baseline: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each row of the baseline with its prediction, if it has one."""
    p = predicted.select("source1_entity_id", F.col("matched_entity_ids").alias("_got"))
    return baseline.join(p, "source1_entity_id", "left").select("source1_entity_id", F.coalesce("_got", F.lit("")).alias("matched_entity_ids"))


def remaining(s1: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows of S1 that aren't in both outputs yet."""
    done = candidates.select("source1_entity_id").intersect(matches.select("source1_entity_id"))
    return s1.join(done, F.col("entity_id") == F.col("source1_entity_id"), "left_anti")


def reconciled(candidates: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both outputs, with only the rows whose id is in the other one too."""
    return candidates.join(matches, "source1_entity_id", "left_semi"), matches.join(candidates, "source1_entity_id", "left_semi")


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """An output's rows; an empty list is ''."""
    return spark.read.csv(path, sep="\t", header=True).fillna("")


def mend(spark: SparkSession, candidates: str, matches: str) -> DataFrame | None:
    """The ids (source1_entity_id) that both outputs have; None if one of them isn't there. Where the outputs disagree (a run broke
    off between two appends), or one has an id twice, both are rewritten: one row of each id that both have. The new files are
    complete before the old ones go, and a run that breaks off here is mended by the next."""
    if not (exists(spark, candidates) and exists(spark, matches)):
        return None
    paths = {"candidates": candidates, "matches": matches}
    read = {n: read_output(spark, p) for n, p in paths.items()}
    n = {k: df.agg(F.count("*"), F.count_distinct("source1_entity_id")).first() for k, df in read.items()}
    own = reconciled(read["candidates"], read["matches"])
    both = own[0].select("source1_entity_id").distinct()
    if len({both.count(), *n["candidates"], *n["matches"]}) > 1:
        for df, p in zip(own, paths.values()):
            df.dropDuplicates(["source1_entity_id"]).write.mode("overwrite").csv(f"{p}.mended", sep="\t", header=True, emptyValue="")
        for p in paths.values():
            replace(spark, p, f"{p}.mended")
    return read_output(spark, candidates).select("source1_entity_id")


def scan_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct values of a file's first column, without blanks."""
    df = spark.read.csv(path, sep="\t", header=True)
    first = df.columns[0]
    return df.select(F.trim(F.col(f"`{first}`")).alias("entity_id")).where("entity_id <> ''").distinct()


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it has it: any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def replace(spark: SparkSession, path: str, by: str) -> None:
    """Puts the folder `by` in the place of `path`."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)
    if not fs.rename(file_system(spark, by)[1], p):
        raise OSError(f"can't move {by} to {path}")


def save_json(value: dict, path: str) -> None:
    fs, p = file_system(SparkSession.active(), path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def load_json(path: str) -> dict:
    return json.loads(SparkSession.active().read.text(path, wholetext=True).first()[0])


def read_through(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written first if it isn't there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def package_outputs(team: str, files: list[str], out: str) -> str:
    """A zip of the given files in a folder of the team's name."""
    path = Path(out) / f"{team}.zip"
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            if Path(f).exists():
                z.write(f, f"{team}/{Path(f).name}")
    return str(path)


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
