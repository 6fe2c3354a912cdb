"""Prompt files: whole texts by name, from the first folder that has the name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = ".md"


def prompt_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """name, text, rank of the prompt files in each folder (its place in the list); a folder that isn't there has none."""
    found = []
    for rank, folder in enumerate(folders):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            files = spark.read.option("pathGlobFilter", f"*{SUFFIX}").text(folder, wholetext=True)
            found.append(files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("name"), F.col("value").alias("text"), F.lit(rank).alias("rank")))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "name string, text string, rank int")


def load_prompts(wanted: DataFrame, folders: list[str]) -> DataFrame:
    """`wanted` (with `name`, repeats and null included) and `text` of the first folder that has it, '' if none has."""
    first = prompt_files(wanted.sparkSession, folders).groupBy("name").agg(F.min_by("text", "rank").alias("text"))
    return wanted.join(first, "name", "left").withColumn("text", F.coalesce("text", F.lit("")))
