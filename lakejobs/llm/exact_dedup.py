"""Exact deduplication with streaming keyed state.

Arrivals (digest, length, id, locator) stream through an aggregation whose state is kept on disk
(RocksDB, in the query's checkpoint) and never expires: per digest the row that stays and the size of
the group. The state is then read as a table. A hit is not believed on its digest: the bytes of every
copy are compared with those of the row that stays; where they differ, that digest's rows are grouped
by their whole texts instead. All steps are DataFrame operations in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakejobs.llm.tables import free_name, from_files, kept
from lakejobs.session import on_disk_state, scratch_path


def normalised(text: Column) -> Column:
    """The text with each run of blanks (space, tab to carriage return) as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def locator(docs: DataFrame) -> Column:
    """Where a row's content is: (file, row in file), or the row's place in the scan for other inputs."""
    meta = [f for f in docs.select(docs.metadataColumn("_metadata")).schema[0].dataType.names] if _from_files(docs) else []
    if "row_index" in meta:
        m = docs.metadataColumn("_metadata")
        return F.struct(m["file_path"].alias("file"), m["row_index"].alias("row"))
    return F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))


def _from_files(docs: DataFrame) -> bool:
    from pyspark.errors import AnalysisException

    try:
        docs.select(docs.metadataColumn("_metadata"))
        return True
    except AnalysisException:  # an input that is not a plain file table has no such column
        return False


def arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """(digest, n_bytes, id, at): what the stream needs of a document; works on streams too."""
    text = normalised(F.col(text_col))
    return docs.select(
        digest(text).alias("digest"), F.octet_length(text).alias("n_bytes"), F.col(id_col).alias("id"), locator(docs).alias("at")
    )


def dedup_stream(arriving: DataFrame) -> DataFrame:
    """Per digest the size of its group and the row that stays (smallest id, null last, then place)."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("first")
    return arriving.groupBy("digest", "n_bytes").agg(F.count("*").alias("group_size"), first)


def start_dedup(arriving: DataFrame, checkpoint: str) -> StreamingQuery:
    """Take in what has arrived; state goes to ``checkpoint`` and a later start goes on from it."""
    return (
        dedup_stream(arriving).writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, n_bytes, group_size, first) as the stream's state holds it after its last batch."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        "key.digest", "key.n_bytes",
        F.col("value.count").alias("group_size"), F.col("value.min").alias("first"),
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """One row per document row: (id, keep_id, group_size, kept, digest, at).

    Texts are equal when their normalised forms are. The row with the smallest id stays; rows with
    equal ids are told apart by their place, a null id comes last, a null text is an empty text.
    An empty table gives no rows. Other columns are not read.
    """
    spark, docs = docs.sparkSession, from_files(docs)
    table = scratch_path(spark, "arrivals")
    arrivals(docs, id_col, text_col, digest).write.parquet(table)
    seen = spark.read.parquet(table)
    with on_disk_state(spark):
        checkpoint = scratch_path(spark, "dedup-state")
        start_dedup(spark.readStream.schema(seen.schema).parquet(table), checkpoint).awaitTermination()
        groups = kept(read_state(spark, checkpoint)) if not seen.isEmpty() else None
    if groups is None:
        groups = dedup_stream(seen)
    rows = seen.join(groups, ["digest", "n_bytes"]).withColumn("stays", F.col("at") == F.col("first.at"))
    differing = _differing(docs, rows, text_col)
    plain = rows
    if not differing.isEmpty():
        plain = rows.join(differing, "digest", "left_anti").unionByName(_by_text(docs, rows, differing, text_col))
    return plain.select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", F.col("stays").alias("kept"), "digest", "at"
    )


def _texts(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """The given rows with their normalised text."""
    texts = docs.select(normalised(F.col(text_col)).alias("_text"), locator(docs).alias("at"))
    return rows.join(texts, "at")


def _differing(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """Digests under which some copy's bytes are not those of the row that stays."""
    copies = _texts(docs, rows.where("group_size > 1").select("digest", "n_bytes", "at", "stays"), text_col)
    kept_text = copies.where("stays").select(F.col("digest").alias("_d"), F.col("n_bytes").alias("_n"), F.col("_text").alias("_kept"))
    same = (F.col("digest") == F.col("_d")) & (F.col("n_bytes") == F.col("_n"))
    hits = copies.where("not stays").join(kept_text, same)
    return kept(hits.where(F.col("_text") != F.col("_kept")).select("digest").distinct())


def _by_text(docs: DataFrame, rows: DataFrame, differing: DataFrame, text_col: str) -> DataFrame:
    texts = _texts(docs, rows.join(differing, "digest", "left_semi").drop("group_size", "first", "stays"), text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("first")
    groups = texts.groupBy("_text").agg(F.count("*").alias("group_size"), first)
    return texts.join(groups, "_text").withColumn("stays", F.col("at") == F.col("first.at")).drop("_text")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns."""
    docs, name = from_files(docs), free_name(docs, "_at")
    dropped = kept(exact_groups(docs, **options).where("not kept").select(F.col("at").alias(name)))
    return docs.withColumn(name, locator(docs)).join(dropped, name, "left_anti").drop(name)
