"""Three sources of business records, with known matches, from the customer and nation tables.

The SQL is valid in Spark and in DuckDB, so that both start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import written
from ..shipping import ship
from ..sources import files

_BRANDS = "acme,globex,initech,umbra,stark,wayne,soylent,hooli,vandelay,wonka,tyrell,cyber,oscorp,massive,gringott,nakatomi,zorg,virtu,aperture"
_KINDS = "trading,foods,steel,textile,logist,pharma,telecom,agri,mfg,infra,elec,café,consult"
_FORMS = "Ltd,Pvt Ltd,Inc,LLC,& Sons,Corp.,Co,SARL,Grp,PLC,Intl"
_STREETS = "Maple St,Oak Ave,Hill Rd,Lake Dr,Mill Ln,Park Blvd,King Sq,Station Rd,rue Verte,MG Marg,Elm Ct,West Hwy,Bay Pl"
_CITIES = "Springfield,Riverton,Lakeside,Fairview,Old Town,Port Grand,Clayton,Ashby,Milton"
_TAILS = "near Central Park,opp. City Mall,behind Old Mill,2nd floor,no note,close to Tower"


def _pick(items: str, key: str) -> str:
    n = items.count(",") + 1
    return f"split_part('{items}', ',', CAST(({key}) % {n} AS INT) + 1)"


BASE = f"""
SELECT c_custkey AS k,
  {_pick(_BRANDS, "c_custkey")} || {_pick("on,ex,ia,or,um,us,el", "c_custkey * 3 + 1")} || ' ' || {_pick(_KINDS, "c_custkey * 7 + 2")} AS stem,
  {_pick(_FORMS, "c_custkey * 5 + 3")} AS form,
  CAST(c_custkey * 37 % 980 + 1 AS STRING) || ' ' || {_pick(_STREETS, "c_custkey * 11")} AS street,
  {_pick(_CITIES, "c_custkey * 13")} AS city, {_pick(_TAILS, "c_custkey * 17")} AS tail,
  CAST(10000 + c_custkey * 7919 % 89999 AS STRING) AS code,
  CASE n_regionkey WHEN 0 THEN 'US' WHEN 1 THEN 'India' WHEN 2 THEN 'France' WHEN 3 THEN '' ELSE 'US' END AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

#: The sources' rows; seq is their order in S1, then S2, then S3.
SOURCES = {
    "S1": "SELECT 'S1-' || CAST(k AS STRING) AS entity_id, stem || ' ' || form AS business_name, street || ', ' || tail || ', ' || city || ', ' || CASE WHEN k % 4 = 0 THEN 'WA ' ELSE '' END || code AS business_address, country, k AS seq FROM base",
    "S2": """SELECT 'S2-' || CAST(k AS STRING) AS entity_id,
  CASE WHEN k % 3 = 0 THEN upper(stem) || ' ' || form WHEN k % 3 = 1 THEN stem ELSE substr(stem, 1, 4) || substr(stem, 6) || ' ' || form END AS business_name,
  CASE WHEN k % 7 = 0 THEN street || ', ' || city ELSE street || ', ' || city || ', ' || code END AS business_address, country, 10000000 + k AS seq FROM base WHERE k % 5 <> 0""",
    "S3": """SELECT 'S3-' || CAST(k AS STRING) AS entity_id,
  CASE WHEN k % 2 = 0 THEN form || ' ' || stem ELSE stem || ' Services ' || form END AS business_name,
  CASE WHEN k % 6 = 0 THEN '' ELSE 'No. ' || street || ', ' || tail || ', ' || city || ' ' || code END AS business_address, CASE WHEN k % 11 = 0 THEN '' ELSE country END AS country, 20000000 + k AS seq FROM base WHERE k % 4 <> 1""",
}
TRUTH = "SELECT 'S1-' || CAST(k AS STRING) AS s1_id, CASE WHEN k % 5 <> 0 THEN 'S2-' || CAST(k AS STRING) ELSE '' END AS m2, CASE WHEN k % 4 <> 1 THEN 'S3-' || CAST(k AS STRING) ELSE '' END AS m3 FROM base"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.sql(BASE.replace("FROM customer", "FROM {customer}").replace("JOIN nation", "JOIN {nation}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"), nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))


def rows(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The raw rows of sources."""
    base = _base(spark, sf_dir)
    got = [spark.sql(SOURCES[n].replace("FROM base", "FROM {base}"), base=base) for n in names]
    return got[0] if len(got) == 1 else got[0].unionByName(got[1]) if len(got) == 2 else got[0].unionByName(got[1]).unionByName(got[2])


def queries_and_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Normalised records of S1, and of S2 and S3: written once, since every channel and the features read them."""
    return written(files.records(rows(spark, sf_dir, "S1")), "queries"), written(files.records(rows(spark, sf_dir, "S2", "S3")), "candidates")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, matches)."""
    t = spark.sql(TRUTH.replace("FROM base", "FROM {base}"), base=_base(spark, sf_dir))
    return t.select("s1_id", F.array_remove(F.array("m2", "m3"), "").alias("matches"))
