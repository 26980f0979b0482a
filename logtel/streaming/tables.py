"""Tables that streams write: one folder per micro-batch, overwritten when a batch is replayed, and merged as they grow in number.

A batch that runs again after a failure replaces its own output, so every row
counts once. Readers see the union of all batches, with the batch number.

A folder holds a span of batches and is named by it. After every ``FAN``
batches their folders are merged into one, after ``FAN`` of those these again,
so a table of n batches has some ``FAN`` folders for each power of ``FAN`` in
n. A merged folder is written under a hidden name and renamed when it is
whole; those that it holds are deleted afterwards. Whatever is left by a run
that ended in between, or by a batch replayed after it was merged, lies within
a larger span and is not read. Merging needs a file system that renames
folders as one step.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

BATCH = "_batch_id"
SPAN = "_span"
#: Folders that are merged into one.
FAN = 16


def _folder(path: str, low: int, high: int) -> str:
    return f"{path}/{SPAN}={low}-{high}"


def _files(spark: SparkSession, path: str):
    """(file system, path) as the JVM sees them: renaming and deleting folders is beyond the DataFrame API."""
    jvm = spark._jvm.org.apache.hadoop.fs
    place = jvm.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.withColumn(BATCH, F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(_folder(path, batch, batch))
    size = FAN
    while (batch + 1) % (size * FAN) == 0:
        size *= FAN
    if (batch + 1) % size == 0:
        _merge(df.sparkSession, path, df.schema, batch + 1 - size, batch)


def _merge(spark: SparkSession, path: str, schema: StructType, low: int, high: int) -> None:
    full, spans = _all_batches(spark, path, schema)
    held = [s for s in spans if low <= s[0] and s[1] <= high]
    if (low, high) in held:
        return  # a replay: the merged folder has this batch already
    hidden, merged = f"{path}/_merging-{low}-{high}", _folder(path, low, high)
    full.filter(F.col(SPAN).isin(_names(_outer(held)))).drop(SPAN).write.mode("overwrite").parquet(hidden)
    files, place = _files(spark, hidden)
    if not files.rename(place, _files(spark, merged)[1]):
        raise OSError(f"cannot rename {hidden}")
    for span in held:
        files.delete(_files(spark, _folder(path, *span))[1], True)


def _outer(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie within no other."""
    found: list[tuple[int, int]] = []
    for low, high in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not found or high > found[-1][1]:
            found.append((low, high))
    return found


def _names(spans: Iterable[tuple[int, int]]) -> list[str]:
    return [f"{low}-{high}" for low, high in spans]


def _all_batches(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Everything below ``path`` with its span, and the spans there are; the file listing tells these, no job."""
    full = StructType([*schema.fields, StructField(BATCH, LongType()), StructField(SPAN, StringType())])
    try:
        found = spark.read.schema(full).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise  # a folder that is there but cannot be read is not an empty one
        return spark.createDataFrame([], full), []
    named = {part for file in found.inputFiles() for part in file.split("/") if part.startswith(f"{SPAN}=")}
    spans = [tuple(map(int, name.removeprefix(f"{SPAN}=").split("-"))) for name in named]
    return found, spans


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All batches written so far (none yet gives an empty table)."""
    full, spans = _all_batches(spark, path, schema)
    return full.filter(F.col(SPAN).isin(_names(_outer(spans)))).drop(SPAN)


def read_before(spark: SparkSession, path: str, schema: StructType, batch: int) -> DataFrame:
    """State as the batch before ``batch`` left it, from that batch's folder only."""
    full, spans = _all_batches(spark, path, schema)
    own = (batch - 1, batch - 1)
    here = [own] if own in spans else [s for s in _outer(spans) if s[0] <= batch - 1 <= s[1]]
    return full.filter(F.col(SPAN).isin(_names(here)) & (F.col(BATCH) == batch - 1)).drop(SPAN, BATCH)


def write_state(df: DataFrame, path: str, batch: int) -> None:
    """State after ``batch``. Only that and the one before it are kept: a replay of ``batch`` starts from the latter."""
    df.withColumn(BATCH, F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(_folder(path, batch, batch))
    _, spans = _all_batches(df.sparkSession, path, df.schema)
    for low, high in spans:
        if high < batch - 1:
            files, place = _files(df.sparkSession, _folder(path, low, high))
            files.delete(place, True)
