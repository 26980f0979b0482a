"""Whole small files, loose or packed, file listings and checkpoint files."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtel.functions import variants as v
from logtel.functions.scalars import iso_ms
from logtel.operators.layout import exchanged

# JSON objects with a repeated member keep the last one, as the producers' own readers do.
DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"


def pack_documents(documents: DataFrame, path: str) -> None:
    """Rows of (file, text) as a pack: Parquet files that hold any number of small files each.

    A file of its own costs a create, an open and a place in the driver's
    listing whatever its size, so millions of small ones are kept like this.
    ``file`` is the path inside the pack. A text is one value, as when a small
    file is read whole; large files are better left loose.
    """
    documents.select("file", "text").write.parquet(path)


def read_documents(spark: SparkSession, path: str | Sequence[str], glob: str = "*.json", packed: bool = False) -> DataFrame:
    """(file, text) of every matching file; a document is one JSON value and is read whole.

    With ``packed`` the files are those inside the packs at ``path``.
    """
    spark.conf.set(DUPLICATE_KEYS, "true")
    if packed:
        paths = [path] if isinstance(path, str) else list(path)
        inside = spark.read.schema("file string, text string").parquet(*paths)
        name = F.regexp_extract("file", "[^/]*$", 0)
        pack = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        matching = inside if glob == "*" else inside.filter(name.rlike(fnmatch.translate(glob)))
        return matching.select(F.concat(pack, F.lit("/"), "file").alias("file"), "text")
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return docs.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_listing(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, size, modified_ms) of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"))


def parse_checkpoints(documents: DataFrame) -> DataFrame:
    """Checkpoints from (file, text): the path ends in group/hub/partition, the body is a JSON object."""
    parts = F.split(F.regexp_replace("file", r"/+$", ""), "/")
    root = F.col("_root")
    raw = F.try_variant_get(root, "$.SequenceNumber", "string")
    broken = root.isNull() | ~v.is_object(root)
    given = v.kind(root, "$.SequenceNumber").isNotNull() & (v.kind(root, "$.SequenceNumber") != "VOID")
    seq = raw.try_cast("bigint")
    status = (
        F.when(broken, "error: invalid JSON")
        .when(given & seq.isNull(), "error: invalid SequenceNumber")
        .when(~given, "no_checkpoint")
    )
    return v.with_parsed(documents, "text", "_root").select(
        F.element_at(parts, -3).alias("consumer_group"),
        F.element_at(parts, -2).alias("hub"),
        F.element_at(parts, -1).alias("partition_id"),
        F.when(~broken, seq).alias("seq"),
        F.when(~broken, F.try_variant_get(root, "$.Offset", "string")).alias("msg_offset"),
        F.when(~broken, iso_ms(v.text(root, "$.RetrievalTime"))).alias("retrieved_ms"),
        status.alias("status"),
    )


def read_checkpoints(spark: SparkSession, path: str | Sequence[str], partitions: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """Checkpoint files below ``path``.

    ``partitions`` (consumer_group, hub, partition_id) are those asked for: one row
    each, ``no_checkpoint`` for one without a file in that very group and hub.
    """
    found = parse_checkpoints(read_documents(spark, path, "*", packed))
    if partitions is None:
        return found
    keys = ["consumer_group", "hub", "partition_id"]
    wanted = partitions.select(*[F.col(k).cast("string").alias(k) for k in keys])
    marked = found.withColumn("_found", F.lit(True))
    return wanted.join(exchanged(marked), keys, "left").withColumn(
        "status", F.when(F.col("_found").isNull(), "no_checkpoint").otherwise(F.col("status"))
    ).drop("_found")
