"""Test sets, checkpoints and logs as text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESULT_SCHEMA = "entry_index long, model string, correct boolean, correct_aligned boolean, correct_stripped boolean, duration double, input_tokens long, output_tokens long, logprob double, failed_patched_code string, error boolean, patch_commit_hash string, code_commit_hash string"

# white space and line ends inside of fields are kept
EXACT = {"header": True, "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def description_parts(description: Column) -> tuple[Column, Column, Column]:
    """(code hash with ``^``, patch hash, file name) of ``code / patch\\nfile``; without `` / `` all is the code hash."""
    left = F.regexp_extract(description, r"(?s)^(.*?)(?: / (.*))?\z", 1)
    right = F.regexp_extract(description, r"(?s)^(.*?)(?: / (.*))?\z", 2)
    return F.concat(left, F.lit("^")), F.split_part(right, F.lit("\n"), F.lit(1)), F.split_part(right, F.lit("\n"), F.lit(2))


def read_test_set(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Test entries of CSV files with a header and quoted fields over several lines; shorter records are left out."""
    raw = spark.read.csv(list(paths) if not isinstance(paths, str) else paths, header=True, multiLine=True, escape='"', schema="id string, run string, description string, patch string, code string, patched_code string", mode="PERMISSIVE")
    code_hash, patch_hash, name = description_parts(F.col("description"))
    return raw.where("patched_code is not null").select("id", "patch", "code", "patched_code", code_hash.alias("code_commit_hash"), patch_hash.alias("patch_commit_hash"), name.alias("filename"))


def read_results(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Typed checkpoint rows; a folder that is not there has no rows."""
    names = [paths] if isinstance(paths, str) else list(paths)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in names if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if not there:
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.csv(there, schema=RESULT_SCHEMA, multiLine=True, **EXACT)


def write_results(df: DataFrame, path: str) -> None:
    """Write a new checkpoint folder; the folder must not be one that ``df`` reads. Texts come back as they were, with
    their white space and line ends."""
    df.write.mode("overwrite").csv(path, **EXACT)


def status_entries(spark: SparkSession, path: str) -> DataFrame:
    """(hash, path) of unmerged entries of a status listing parted by NUL: the eighth and the tenth later field."""
    rows = spark.read.option("lineSep", "\0").text(path).where(F.col("value").startswith("u UU"))
    f = F.split("value", " ", 11)
    return rows.select(F.get(f, F.lit(8)).alias("hash"), F.get(f, F.lit(10)).alias("path"))


def commit_pairs(lines: DataFrame, number: str, line: str, key: str) -> DataFrame:
    """(commit, upstream) from log lines of one or more logs (``key``): the first upstream note of each commit.

    Commits without a note are left out.
    """
    commit = F.nullif(F.regexp_extract(F.trim(line), "^commit ([0-9a-f]{40})$", 1), F.lit(""))
    upstream = F.nullif(F.regexp_extract(F.trim(line), r"^(?:commit ([0-9a-f]{40}) upstream\.?|\[ ?[Uu]pstream commit ([0-9a-f]{40}) ?\])$", 1), F.lit(""))
    other = F.nullif(F.regexp_extract(F.trim(line), r"^\[ ?[Uu]pstream commit ([0-9a-f]{40}) ?\]$", 1), F.lit(""))
    w = Window.partitionBy(key).orderBy(number)
    rows = lines.withColumn("commit", F.last(commit, ignorenulls=True).over(w)).withColumn("upstream", F.coalesce(upstream, other))
    return rows.where("commit is not null and upstream is not null").groupBy(key, "commit").agg(F.min_by("upstream", number).alias("upstream"))
