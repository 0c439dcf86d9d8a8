"""Sources: tables, JDBC, CSV and JSON files, optional inputs, views and small configuration files."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.functions.values import normed

VERIFIED_CLAIMS = "claim_text string, speaker_name string, debate_date date, verification_status string, evidence_source string, explanation string"
CLAIMS = (
    "claim_text string, full_context string, speaker string, claim_type string, "
    "context struct<date:string,session:string,topic_h1:string,topic_h2:string,topic_h3:string,document_id:bigint,statement_id:bigint>"
)


def load_dotenv(path: str, into: dict[str, str] | None = None) -> dict[str, str]:
    """``KEY=value`` lines of a file, without overriding what is set; a missing file sets nothing."""
    target = os.environ if into is None else into
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                if line and not line.startswith("#") and "=" in line:
                    key, _, value = line.partition("=")
                    target.setdefault(key.strip(), value.strip().strip("\"'"))
    return target


def jdbc_options(env: Mapping[str, str] | None = None, **given: str) -> dict[str, str]:
    """JDBC options from arguments, else from the environment; secrets never stand in code."""
    env = os.environ if env is None else env
    pick = lambda name, fallback="": given.get(name) or env.get(f"DB_{name.upper()}") or fallback
    return {"url": f"jdbc:postgresql://{pick('host', 'localhost')}:{pick('port', '5432')}/{pick('name')}", "user": pick("user"), "password": pick("password"), "driver": "org.postgresql.Driver"}


def read_jdbc(spark: SparkSession, dbtable: str, options: Mapping[str, str], partition: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64) -> DataFrame:
    """A database table or query, read in parallel ranges of a numeric column where one is given."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", dbtable)
    if partition and bounds:
        reader = reader.option("partitionColumn", partition).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def read_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV with a header, quoted line breaks and an optional byte-order mark; all columns are strings, missing is empty."""
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").csv(paths)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns]).na.fill("")


def read_json_array(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """Files that each hold one JSON array, or JSON objects."""
    return spark.read.option("multiLine", True).schema(schema).json(paths)


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines, splittable at any size."""
    return spark.read.schema(schema).json(paths)


def existing(paths: Sequence[str], spark: SparkSession | None = None) -> list[str]:
    """The paths that exist, local or in any file system Spark can reach."""
    if spark is None:
        return [p for p in paths if os.path.exists(p)]
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            found.append(p)
    return found


def read_claims(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Claims of all files that exist, in one relation; none gives the empty relation."""
    there = existing(paths, spark)
    return read_json_array(spark, there, CLAIMS) if there else spark.createDataFrame([], CLAIMS)


def table_or_empty(spark: SparkSession, name: str, schema: str = VERIFIED_CLAIMS) -> DataFrame:
    """A catalogue table, or an empty relation of the given columns where it does not exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def debates(statements: DataFrame, documents: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Statements with text of their documents in a range of days, newest first; empty bounds and limit 0 do not bind.

    Days are null first and sequences null last, as the ordered scan gives them.
    """
    rows = statements.where("content_en is not null and content_en <> ''").join(documents.select(F.col("id").alias("document_id"), "date"), "document_id")
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    named = rows.select(F.col("id").alias("statement_id"), "document_id", "date", F.col("who_en").alias("speaker_name"), F.col("content_en").alias("content"), F.col("h1_en").alias("topic"), "sequence", "procedural")
    ordered = named.orderBy(F.desc_nulls_first("date"), F.asc_nulls_last("sequence"))
    return ordered.limit(limit) if limit else ordered


def legacy_debates(table: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """The same over one flat table of debates."""
    rows = table
    if start:
        rows = rows.where(F.col("debate_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("debate_date") <= F.lit(end).cast("date"))
    ordered = rows.orderBy(F.desc_nulls_first("debate_date"))
    return ordered.limit(limit) if limit else ordered


def lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a table whose key is among ``ids`` (one column ``key``)."""
    return table.join(ids.select(F.col("key").alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def create_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    """Register relations as views, again and again if need be."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def knowledge_base(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with their vector normed once."""
    return rows.withColumn("vector", normed(vector))
