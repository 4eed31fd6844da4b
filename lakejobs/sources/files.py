"""Files as rows, and several inputs as one relation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.errors import MISSING_FILE, NotFound


def file_inventory(spark: SparkSession, directory: str, pattern: str | None = None) -> DataFrame:
    """One row (path, length, modified) per file at any depth below ``directory``.

    Only metadata columns are selected, so no file content is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(directory).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def split_inputs(inputs: str | list[str]) -> list[str]:
    """A comma list, or a list whose items may be comma lists, as single paths."""
    given = [inputs] if isinstance(inputs, str) else inputs
    return [path for item in given for path in item.split(",")]


def check_inputs(spark: SparkSession, inputs: str | list[str]) -> list[str]:
    """The qualified form of every input (globs allowed); one that is missing is an error."""
    gateway = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    qualified = []
    for name in split_inputs(inputs):
        path = gateway.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        if not fs.globStatus(path):
            raise NotFound(MISSING_FILE.format(name))
        qualified.append(path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())
    return qualified


def read_inputs(
    spark: SparkSession,
    inputs: str | list[str],
    reader: Callable[[SparkSession, list[str]], DataFrame] | str = "text",
    **options: object,
) -> DataFrame:
    """Several inputs as one relation, by a data source name or a ``(spark, paths)`` function."""
    paths = check_inputs(spark, inputs)
    if callable(reader):
        return reader(spark, paths, **options)
    return spark.read.format(reader).options(**options).load(paths)


def file_text(spark: SparkSession, name: str) -> str:
    """The text of a script: one small file, or all files a folder or glob names, in order of their paths."""
    files = spark.read.text(check_inputs(spark, [name])[0], wholetext=True).select(F.input_file_name().alias("path"), "value")
    return "\n".join(r.value for r in files.orderBy("path").collect())


def modified_before(inventory: DataFrame, now_ms: int, max_age_ms: int) -> DataFrame:
    """Files of a :func:`file_inventory` whose age exceeds ``max_age_ms`` at ``now_ms``."""
    return inventory.where(F.unix_millis("modified") < F.lit(now_ms - max_age_ms))
