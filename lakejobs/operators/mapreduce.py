"""Map/reduce over external programs, and the two jobs always shown with it: word count and wc."""

from __future__ import annotations

import os
import shlex
import subprocess
import sys
import threading
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.errors import MISSING_PARAM, BadParam
from lakejobs.sources.files import read_inputs

# The pipe function travels inside the query: executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])

# Fixed value: the characters that separate words.
WHITESPACE = "[ \t\n\r\f]+"
_READ_BYTES = 1 << 20


def _pipe(command: str, env: dict[str, str]) -> Callable[[Iterator], Iterator]:
    """A ``mapInArrow`` function that sends one partition's lines through a program.

    Lines arrive with their newline, so the bytes of a batch go to the program as they are; output
    is cut into lines by offsets. No line becomes a Python object.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = subprocess.Popen(
            shlex.split(command),
            stdin=subprocess.PIPE,
            stdout=subprocess.PIPE,
            env={**os.environ, **env},
            cwd=SparkFiles.getRootDirectory(),
        )
        failure: list[BaseException] = []

        def feed() -> None:
            try:
                with process.stdin as sink:
                    for batch in batches:
                        if batch.num_rows:
                            sink.write(_bytes_of(batch.column(0)))
            except BrokenPipeError:
                pass  # the program stopped reading, as head does
            except BaseException as error:  # noqa: BLE001 - raised again in the reading thread
                failure.append(error)
                process.kill()

        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        try:
            rest = b""
            while block := process.stdout.read(_READ_BYTES):
                end = block.rfind(b"\n") + 1
                if end:
                    yield _lines_of(rest + block[:end])
                    rest = block[end:]
                else:
                    rest += block
            if rest:
                yield _lines_of(rest + b"\n")
            code = process.wait()
            feeder.join()
        finally:
            if process.poll() is None:
                process.kill()
        if failure:
            raise failure[0]
        if code:
            raise RuntimeError(f"program failed with exit code {code}: {command}")

    return run


def _bytes_of(lines: pa.Array) -> memoryview:
    """The values of a binary array one after the other."""
    width = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
    _, offsets, data = lines.buffers()
    ends = np.frombuffer(offsets, width, len(lines) + 1 + lines.offset)
    return memoryview(data)[ends[lines.offset] : ends[-1]] if data else memoryview(b"")


def _lines_of(block: bytes) -> pa.RecordBatch:
    """A block of whole lines as one row per line, without newlines."""
    text = np.frombuffer(block, np.uint8)
    newline = text == ord("\n")
    ends = np.flatnonzero(newline)
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends - np.arange(len(ends))
    data = pa.py_buffer(text[~newline].tobytes())
    lines = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), data])
    return pa.RecordBatch.from_arrays([lines], names=["line"])


def _through(lines: DataFrame, command: str, env: dict[str, str]) -> DataFrame:
    """Pipe the text column ``line`` and split each output line at its first tab."""
    ended = lines.select(F.concat("line", F.lit("\n")).cast("binary").alias("line"))
    out = ended.mapInArrow(_pipe(command, env), "line binary")
    return out.select(F.col("line").cast("string").alias("line")).selectExpr(
        "substring_index(line, '\t', 1) AS key",
        "substring(line, length(substring_index(line, '\t', 1)) + 2) AS value",
    )


def _as_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.concat_ws("\t", "key", "value").alias("line"))


def stream_map_reduce(
    spark: SparkSession,
    inputs: DataFrame | str | list[str],
    mapper: str,
    reducer: str,
    n_reducers: int | None = None,
    env: dict[str, str] | None = None,
    files: Sequence[str] = (),
    combiner: str | None = None,
) -> DataFrame:
    """Pipe lines through ``mapper``, group them by key, pipe each reduce partition through ``reducer``.

    ``inputs`` are text files or a one-column DataFrame of text. A program's output line is a key up
    to the first tab and a value after it. Lines reach the reducer as ``key<tab>value``, partitioned
    by key and sorted by key; a program that ends with another code than 0 fails the job. ``files``
    are shipped to the programs' working directory.

    Shuffle and sort are Spark's and spill; programs see a stream, so no partition is held in
    memory. ``combiner`` runs over each sorted map partition before the shuffle: with it, a key
    crosses the network once per map task however often it occurs. Give one wherever the reducer
    allows, since all lines of one key must reach one reducer.
    """
    for name, value in (("input", inputs), ("mapper", mapper), ("reducer", reducer)):
        if value is None or (isinstance(value, (str, list)) and not value):
            raise BadParam(MISSING_PARAM.format(name))
    for path in files:
        spark.sparkContext.addFile(path)
    env = dict(env or {})
    lines = inputs if isinstance(inputs, DataFrame) else read_inputs(spark, inputs)
    mapped = _through(lines.select(F.col(lines.columns[0]).alias("line")), mapper, env)
    if combiner:
        mapped = _through(_as_lines(mapped.sortWithinPartitions("key")), combiner, env)
    count = n_reducers or int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = mapped.repartition(count, "key").sortWithinPartitions("key")
    return _through(_as_lines(grouped), reducer, env)


def write_pairs(pairs: DataFrame, output: str) -> None:
    """Keep the result of a job as text, ``key<tab>value`` per line; output that exists is an error."""
    pairs.select(F.concat_ws("\t", "key", "value")).write.text(output)


def word_count(df: DataFrame, col: str) -> DataFrame:
    """How often each whitespace-separated word occurs; case is kept."""
    words = df.select(F.explode(F.split(col, WHITESPACE)).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("count"))


def text_wc(df: DataFrame, col: str, per: str | list[str] | None = None) -> DataFrame:
    """Newlines, words and bytes of the texts of each group."""
    keys = [] if per is None else [per] if isinstance(per, str) else per
    text = F.col(col)
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    words = F.size(F.array_remove(F.split(text, WHITESPACE), ""))
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(newlines), F.lit(0)).alias("lines"),
        F.coalesce(F.sum(F.when(text.isNotNull(), words)), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"),
    )
