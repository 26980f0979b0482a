"""Text as numbered lines: from files of any size, and from chunks of a log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtel.operators.layout import Running, lay_out, running
from logtel.session import cut, written

MIN_PARTITIONS = "spark.sql.files.minPartitionNum"


def without_cr(c: Column) -> Column:
    return F.regexp_replace(c, r"\r$", "")


def read_blocks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw lines with their file, the start of their file block, and a row id that grows within a block.

    The size of file blocks depends on the number of cores at planning time unless
    it is pinned; it must be the same in every scan of the same files.
    """
    if spark.conf.get(MIN_PARTITIONS, None) is None:
        spark.conf.set(MIN_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.xxhash64("_metadata.file_path").alias("_file_hash"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )


def join_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Join rows to the table of their file blocks without moving the rows.

    A block's key is three numbers: its task, which the row ids start with, its
    place in the file, and a hash that tells apart the few files of a task. With
    what is joined that is some 60 bytes for 128 MB of text, 50 MB for 100 TB.
    """
    keys = ["_task", "_start", "_file_hash"]
    return lines.withColumn("_task", _task(F.col("_id"))).join(F.broadcast(blocks), keys).drop("_task")


def _task(row_id: Column) -> Column:
    return F.shiftright(row_id, 33)


def block_keys(lines: DataFrame) -> DataFrame:
    """Rows grouped by file block, with the columns that ``join_blocks`` needs."""
    return lines.groupBy("file", "_start", "_file_hash", _task(F.col("_id")).alias("_task"))


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """1-based line per file, blank lines counted.

    Only one row per file block is ordered: the lines of the blocks before give
    a block's first number, and the row ids give the place within it.
    """
    per_block = block_keys(lines).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        "_task", "_start", "_file_hash", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    numbered = join_blocks(lines, cut(offsets))
    return numbered.select(
        "file", (F.col("_offset") + F.col("_id") - F.col("_first") + 1).alias("line"), without_cr(F.col("value")).alias("value")
    )


def read_numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return with_line_numbers(read_blocks(spark, path))


def lines_of_documents(documents: DataFrame) -> DataFrame:
    """Numbered lines of small files that were read whole, (file, text); as in ``with_line_numbers``, nothing follows the last line end."""
    pieces = F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)).alias("_piece", "value")
    apart = documents.filter("length(text) > 0").select("file", pieces)
    return apart.select("file", (F.col("_piece") + 1).cast("bigint").alias("line"), without_cr(F.col("value")).alias("value"))


#: Bytes of the table of line numbers, one narrow row for each chunk, that are broadcast.
NUMBERS_BROADCAST = 64 << 20


@dataclass(frozen=True)
class Pieces:
    """Lines of chunked text: ``whole`` (stream, line, value) lie inside one chunk, ``seams`` (the same and ``ended``)
    touch the start or the end of a chunk; ``ends`` (stream, n) counts the line ends."""

    whole: DataFrame
    seams: DataFrame
    ends: DataFrame


#: Chunks of a log that one page holds at most, as a power of two, and the longest chunk that is put into pages.
PAGE_BITS, PAGED_BYTES = 6, 256 << 10
#: Text of pages that one task makes.
PAGES_BYTES = 64 << 20


def split_chunks(chunks: DataFrame, before: DataFrame | None = None, broadcast: int = NUMBERS_BROADCAST) -> Pieces:
    """Lines of text that was cut into chunks anywhere, without moving the lines that no cut goes through.

    ``chunks``: stream, chunk (order, unique in a stream), text. ``before``
    (stream, n): lines that a stream had already. Only (stream, chunk, number of
    line ends) is put in order. The line numbers meet the texts through a
    broadcast, if they are small enough, and the lines inside a chunk are
    emitted where they are read; what is exchanged are the first and the last
    fragment of every chunk. With more numbers than that, each text is moved
    once to meet its number, and so are the fragments. If the chunks are so short that cuts go through
    most lines, so that their text moves anyway, it moves once into pages
    (``_paged``) and these are split. ``ended`` tells a line whose end has been seen.
    """
    ends = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint")
    facts = chunks.agg(
        F.sum(F.coalesce(F.octet_length("stream"), F.lit(0)) + 40).alias("numbers"),
        F.sum(F.octet_length("text").cast("bigint")).alias("bytes"),
        F.max(F.octet_length("text")).alias("longest"),
        (F.sum(ends) < 2 * F.count(F.lit(1))).alias("short"),
    ).first()
    many = (facts["numbers"] or 0) > broadcast
    if many and facts["short"] and facts["longest"] <= PAGED_BYTES:
        pages, laid = _paged(chunks, ends, before, facts["bytes"])

        def numbered(*columns: Column) -> DataFrame:
            return pages.select("stream", "chunk", "_before", *columns)
    else:
        laid, numbers = _line_numbers(chunks.select("stream", "chunk", ends.alias("_ends")), before)
        numbers = numbers.select(F.col("stream").alias("_stream"), F.col("chunk").alias("_chunk"), "_before")
        here = F.col("stream").eqNullSafe(F.col("_stream")) & (F.col("chunk") == F.col("_chunk"))

        def numbered(*columns: Column) -> DataFrame:
            return chunks.select("stream", "chunk", *columns).join(numbers if many else F.broadcast(numbers), here)

    parts = F.col("_parts")
    inside = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    whole = numbered(F.split("text", "\n", -1).alias("_parts")).select("stream", "_before", F.posexplode(inside).alias("_piece", "value"))
    # the part before the first end, and the part after the last one if there is any
    first = F.struct((F.col("_before") + 1).alias("line"), F.col("_first").alias("text"), (F.col("_ends") > 0).alias("ended"))
    final = F.struct((F.col("_before") + F.col("_ends") + 1).alias("line"), F.col("_final").alias("text"), F.lit(False).alias("ended"))
    cuts = F.when((F.col("_ends") > 0) & (F.col("_final") != ""), F.array(first, final)).otherwise(F.array(first))
    fragments = numbered(
        F.substring_index("text", "\n", 1).alias("_first"), F.substring_index("text", "\n", -1).alias("_final"), F.coalesce(ends, F.lit(0)).alias("_ends")
    )
    seams = (
        fragments.select("stream", "chunk", F.inline(cuts))
        .groupBy("stream", "line")
        .agg(_joined(F.struct("chunk", "text")).alias("value"), F.bool_or("ended").alias("ended"))
    )
    return Pieces(
        whole.select("stream", (F.col("_before") + F.col("_piece") + 2).alias("line"), "value"),
        seams,
        laid.groupBy("stream").agg(F.sum("_ends").alias("n")),
    )


def _joined(piece: Column) -> Column:
    """Texts of a group in the order of their chunks."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "")


def _line_numbers(counts: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(counts in order, lines before each chunk) of (stream, chunk, number of line ends)."""
    keys, order = ["stream"], ["chunk"]
    if before is not None:
        counts = counts.unionByName(before.select("stream", F.lit(None).cast("bigint").alias("chunk"), F.col("n").alias("_ends")))
    laid = lay_out(counts, keys, order)  # null chunks come first
    placed = running(laid, keys, order, {"_before": Running("sum", F.col("_ends"), before=True)}).filter("chunk IS NOT NULL")
    return laid, placed.select("stream", "chunk", F.coalesce("_before", F.lit(0)).alias("_before"))


def _paged(chunks: DataFrame, ends: Column, before: DataFrame | None, text_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(pages, counts in order): neighbouring chunks as one text, with the number of lines before it.

    A page has the chunks of one stretch of numbers, so its size is bounded
    however long the log is. The number of lines before a page comes to its
    texts as one more row of the group: texts are exchanged once and written once.
    """
    spark, page = chunks.sparkSession, F.shiftright("chunk", PAGE_BITS)
    laid, numbers = _line_numbers(chunks.groupBy("stream", page.alias("chunk")).agg(F.sum(ends).alias("_ends")), before)
    texts = chunks.filter("chunk IS NOT NULL").select("stream", page.alias("_page"), F.struct("chunk", "text").alias("_piece"))
    rows = texts.unionByName(numbers.select("stream", F.col("chunk").alias("_page"), "_before"), allowMissingColumns=True)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // PAGES_BYTES))
    pages = rows.repartition(tasks, "stream", "_page").groupBy("stream", "_page").agg(
        _joined(F.col("_piece")).alias("text"), F.max("_before").alias("_before")
    )
    kept = written(pages, "chunk-pages")
    return kept.select("stream", F.col("_page").alias("chunk"), "_before", "text"), laid


def reassemble_lines(chunks: DataFrame, flush: bool = True, broadcast: int = NUMBERS_BROADCAST) -> DataFrame:
    """Whole numbered lines of chunked text; without ``flush`` a last line not yet ended is held back."""
    pieces = split_chunks(chunks, broadcast=broadcast)
    kept = pieces.seams.filter("ended OR length(value) > 0") if flush else pieces.seams.filter("ended")
    return finished(pieces.whole.unionByName(kept.select("stream", "line", "value")))


def finished(lines: DataFrame) -> DataFrame:
    return lines.select("stream", "line", without_cr(F.col("value")).alias("value"))
