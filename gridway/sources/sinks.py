"""Rows to files people and programs read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridway.functions import text


def csv_line(columns: list[Column]) -> Column:
    """Columns joined by semicolons, quoted where needed."""
    quoted = [F.when(s.rlike('[;"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s) for s in (F.coalesce(c.cast("string"), F.lit("")) for c in columns)]
    return F.concat_ws(";", *quoted)


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolons, decimal commas, UTF-8."""
    shown = [text.comma(F.col(c), 2).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def kml_line(points: Column) -> Column:
    """A line (array of structs lat, lng) as the coordinates of a KML document."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", F.format_string("%.6f", p["lng"]), F.format_string("%.6f", p["lat"]))), " ")


def kml_document(name: Column, points: Column) -> Column:
    escaped = F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>'), escaped, F.lit("</name><LineString><coordinates>"), kml_line(points), F.lit("</coordinates></LineString></Placemark></Document></kml>"))


def replace_project(findings: DataFrame, path: str) -> None:
    """Write findings so that each project they hold is replaced as a whole."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The versions whose write has ended."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/runs/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def publish(findings: DataFrame, projects: DataFrame, folder: str, version: int) -> None:
    """Replace the findings of projects (project_id), those without any findings included, as one version.

    The list of its projects is written last; until then, and if anything fails, readers see the versions before. A version that has
    ended is not written again, so a replayed batch changes nothing. Findings of other projects are refused.
    """
    spark = findings.sparkSession
    if version in committed(spark, folder):
        return
    mine = projects.select(F.col("project_id").cast("bigint").alias("project_id")).distinct()
    known = findings.join(mine.withColumn("__known", F.lit(True)), "project_id", "left")
    checked = known.withColumn("__known", F.coalesce("__known", F.raise_error(F.concat(F.lit("finding of another project: "), F.coalesce(F.col("project_id").cast("string"), F.lit("null")))).cast("boolean")))
    checked.filter("__known").drop("__known").write.mode("overwrite").parquet(f"{folder}/rows/version={version}")
    mine.write.mode("overwrite").parquet(f"{folder}/runs/version={version}")


def published(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Each project's findings as of the newest version that has it."""
    versions = committed(spark, folder)
    if not versions:
        return spark.createDataFrame([], schema)
    runs = spark.read.parquet(f"{folder}/runs").filter(F.col("version").isin(versions))
    newest = runs.groupBy("project_id").agg(F.max("version").alias("version"))
    rows = spark.read.parquet(f"{folder}/rows").filter(F.col("version").isin(versions)).join(newest, ["project_id", "version"])
    names = spark.createDataFrame([], schema).columns
    return rows.select(*names)
