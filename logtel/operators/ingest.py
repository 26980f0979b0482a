"""Telemetry rows to keyed log events: pull, order, key, serialise, batch, publish."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtel.functions.scalars import datetime_ms_text, epoch_ms_text, is_text, iso_duration_ms
from logtel.operators.layout import BLOCK, attach, counted, lay_out, least_of
from logtel.session import cut, ship_package

# Columns that hold the event time, in order of preference.
EPOCH_COLUMNS = ("clientTime",)
DATETIME_COLUMNS = ("PreciseTimeStamp", "TIMESTAMP", "env_time")
#: Later than any time stamp.
_NEVER = 9223372036854775807


def high_watermarks(store: DataFrame, users: DataFrame) -> DataFrame:
    """Latest ``client_time`` per listed user: maximum of the text, then parsed.

    Users differing only in case are one user; the first spelling is reported.
    """
    listed = users.groupBy(F.lower("object_id").alias("_id")).agg(F.min("object_id").alias("object_id"))
    latest = (
        store.filter(F.length("client_time") > 0)
        .groupBy(F.lower("user_id").alias("_id"))
        .agg(F.max("client_time").alias("_text"))
    )
    return listed.join(latest, "_id", "left").select("object_id", datetime_ms_text(F.col("_text")).alias("watermark_ms"))


def incremental_pull(
    rows: DataFrame,
    watermarks: DataFrame,
    now_ms: int,
    lookback: str = "PT2H",
    session_id: str | None = None,
    explicit_users: bool = False,
) -> DataFrame:
    """Rows newer than their user's watermark, or of one session, ordered by client time.

    ``rows`` carries object_id, session_id, client_ms and ts_ms; ``watermarks``
    carries object_id and watermark_ms (NULL: look back from ``now_ms``).
    """
    marks = watermarks.select("object_id", "watermark_ms")
    if session_id is not None and session_id.strip():
        pulled = rows.filter(F.col("session_id") == session_id)
        if explicit_users:
            pulled = pulled.join(marks.select("object_id"), "object_id", "left_semi")
    else:
        since = now_ms - iso_duration_ms(lookback)
        # watermarks are computed once; no row outside their bounds can be fresh for any user, and the bounds reach the scan
        marks = counted(marks)
        if not marks.counted_rows:
            raise ValueError("at least one user or a session is required")
        never = F.lit(_NEVER)
        latest = marks.agg(F.coalesce(F.max(F.when(F.col("watermark_ms").isNull(), F.lit(since))), never)).scalar()
        rows = rows.filter((F.col("client_ms") > least_of(marks, F.coalesce("watermark_ms", never))) | (F.col("ts_ms") > latest))
        fresh = F.when(F.col("watermark_ms").isNotNull(), F.col("client_ms") > F.col("watermark_ms")).otherwise(
            F.col("ts_ms") > F.lit(since)
        )
        ties = [c for c in ("_file", "_ord", "event_id") if c in rows.columns]
        pulled = attach(rows, marks, ["object_id"], ties or ["client_ms", "ts_ms"]).filter(fresh).select(*rows.columns)
    ties = [c for c in ("_file", "_ord", "event_id") if c in rows.columns]
    return pulled.orderBy(F.col("client_ms").asc_nulls_first(), *ties)


def _by_position(df: DataFrame) -> DataFrame:
    """The same rows under names that cannot collide when only case differs."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def _field(names: Sequence[str], field: str) -> Column:
    """First non-blank value among the exact column and then its case variants, as text."""
    exact = [i for i, n in enumerate(names) if n == field]
    folded = [i for i, n in enumerate(names) if n != field and n.lower() == field.lower()]
    values = [F.col(f"_c{i}").cast("string") for i in exact + folded]
    return F.coalesce(*[F.when(is_text(v), v) for v in values], F.lit(None).cast("string"))


def event_time_ms(df: DataFrame) -> DataFrame:
    """Add ``_event_ms``: epoch-ms column first, then the date-time columns, NULL if none is readable."""
    names = df.columns
    readings = [epoch_ms_text(_field(names, c)) for c in EPOCH_COLUMNS]
    readings += [datetime_ms_text(_field(names, c)) for c in DATETIME_COLUMNS]
    placed = _by_position(df)
    return placed.select("*", F.coalesce(*readings).alias("_event_ms")).toDF(*names, "_event_ms")


def order_chronologically(df: DataFrame, ties: Sequence[str] = ("_file", "_ord")) -> DataFrame:
    """Rows by event time, those without one last, ties in arrival order."""
    return event_time_ms(df).orderBy(F.col("_event_ms").asc_nulls_last(), *ties)


def resolve_key(
    df: DataFrame, field: str = "sessionId", allow_unkeyed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Split rows into (kept, skipped) with their partition key in ``_key``."""
    names = df.columns
    keyed = _by_position(df).select("*", _field(names, field).alias("_key")).toDF(*names, "_key")
    if allow_unkeyed:
        return keyed, keyed.filter(F.lit(False))
    return keyed.filter(F.col("_key").isNotNull()), keyed.filter(F.col("_key").isNull())


def rows_to_json(df: DataFrame, payload: Sequence[str] | None = None, body: str = "_body") -> DataFrame:
    """Add the whole row as JSON text, nulls included; names starting with ``_`` are bookkeeping."""
    names = df.columns
    wanted = payload or [n for n in names if not n.startswith("_")]
    fields = [F.col(f"_c{i}").alias(n) for i, n in enumerate(names) if n in wanted]
    options = {
        "ignoreNullFields": "false",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    }
    return _by_position(df).select("*", F.to_json(F.struct(*fields), options).alias(body)).toDF(*names, body)


# --- size-bounded batches -------------------------------------------------------------------


def _block_steps(sizes: np.ndarray, limit: int) -> tuple[int, int, list[dict]]:
    """What a block of event sizes does to the bytes ``b`` already open when it starts.

    Returns (bytes open, batches opened) for b = 0, and steps for b > 0: a step
    holds from its ``upto`` down to the next step's. Below the last step every
    event still fits.
    """
    count = len(sizes)
    through = np.concatenate([[0], np.cumsum(sizes)])
    # The first event that no longer fits a batch opened at event i, then the next one that fits any batch.
    overflow = np.searchsorted(through[1:], through[:-1] + limit, side="right")
    fitting = np.append(np.where(sizes <= limit, np.arange(count), count), count)
    opener = np.minimum.accumulate(fitting[::-1])[::-1]
    # pointer doubling: from each event to the one that opens the next batch, until a batch stays open
    closes = overflow < count
    following = np.append(np.where(closes, opener[np.minimum(overflow, count)], np.arange(count)), count)
    hops = np.append(closes, False).astype(np.int64)
    while True:
        further = hops[following]
        if not further.any():
            break
        hops, following = hops + further, following[following]
    rest = (through[count] - through)[following]
    opened = hops + (following < count)
    steps: list[dict] = []
    reachable = int(np.searchsorted(through[:-1], limit, side="left"))
    if reachable:
        start = opener[:reachable]
        first = np.ones(reachable, dtype=bool)
        first[1:] = (rest[start][1:] != rest[start][:-1]) | (opened[start][1:] != opened[start][:-1])
        steps = [
            {"upto": int(limit - through[i]), "rest": int(rest[start[i]]), "opened": int(opened[start[i]])} for i in np.flatnonzero(first)
        ]
    return int(rest[opener[0]]), int(opened[opener[0]]), steps


def _summarise_block(limit: int):
    def summarise(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows.sort_values("_row")["_size"].to_numpy(dtype=np.int64)
        rest, opened, steps = _block_steps(sizes, limit)
        summary = {"_key": group[0], BLOCK: group[1], "rest": rest, "opened": opened, "total": int(sizes.sum())}
        return pd.DataFrame([{**summary, "steps": steps}])

    return summarise


def _chain_blocks(limit: int):
    def chain(group: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        held, batches, states = 0, 0, []
        for block in blocks.sort_values(BLOCK).itertuples(index=False):
            states.append({"_key": group[0], BLOCK: block[1], "_held": held, "_batches": batches})
            if held == 0:
                held, opened = block.rest, block.opened
            elif held + block.total <= limit:
                held, opened = held + block.total, 0
            else:
                step = [s for s in block.steps if s["upto"] >= held][-1]
                held, opened = step["rest"], step["opened"]
            batches += opened
        return pd.DataFrame(states)

    return chain


def _filled(sizes: np.ndarray, limit: int, held: int, number: int) -> tuple[np.ndarray, int, int]:
    """Batch numbers of the events of one key (0: too large), and the bytes open and the number at the end.

    One step for each batch and each event that is too large: running sums give
    the last event that still fits.
    """
    numbers, through = np.zeros(len(sizes), dtype=np.int64), np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        size = int(sizes[at])
        if size > limit:
            held, at = 0, at + 1
            continue
        if held == 0 or held + size > limit:
            held, number = 0, number + 1
        before = int(through[at]) - size
        end = int(np.searchsorted(through, before + limit - held, side="right"))
        numbers[at:end] = number
        held += int(through[end - 1]) - before
        at = end
    return numbers, held, number


def _fill_batches(limit: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, number, fresh = None, 0, 0, True
        for rows in batches:
            if not rows.num_rows:
                continue
            codes = rows.column("_key").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            sizes = rows.column("_size").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            numbers = []
            for lo, hi in zip(cuts, cuts[1:]):
                row_key = rows.column("_key")[lo].as_py()
                if fresh or row_key != key:
                    key, fresh = row_key, False
                    held, number = (rows.column(c)[lo].as_py() or 0 for c in ("_held", "_batches"))
                found, held, number = _filled(sizes[lo:hi], limit, held, number)
                numbers.append(found)
            batch = np.concatenate(numbers)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(batch, pa.int64(), mask=batch == 0)], names=[*rows.schema.names, "_batch"]
            )

    return fill


def size_bounded_batches(
    events: DataFrame, max_bytes: int, order: Sequence[str] = ("_event_ms", "_ord"), blocks: int | None = None
) -> DataFrame:
    """Number each key's events into batches of at most ``max_bytes``, greedily and in order.

    An event that does not fit closes the open batch; one larger than an empty
    batch is skipped and has still closed the batch before it. Adds ``_batch``,
    1-based per key and NULL for skipped events. ``order`` must not hold NULLs.

    Greedy filling depends on the past only through the bytes already open, so
    a block of a key that covers several blocks is summarised as a step function
    of that number. Chaining these steps (one row per block) gives each block
    its starting state, and all blocks are then filled independently. Only key,
    order and size are laid out and filled; bodies meet their batch afterwards.
    """
    return continued_batches(events, max_bytes, order, None, blocks)[0]


def continued_batches(
    events: DataFrame, max_bytes: int, order: Sequence[str], opened: DataFrame | None, blocks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``size_bounded_batches`` that goes on where earlier events ended, and the batches that are open after these.

    ``opened`` (_key, held, batches): bytes in a key's open batch, 0 if it is
    closed, and its number. What is held counts as a first event of that size.
    """
    ship_package()
    order = list(order)
    sized = events.select("_key", *order, F.octet_length("_body").cast("bigint").alias("_size"))
    if opened is not None:
        blank = [F.lit(None).cast(sized.schema[c].dataType).alias(c) for c in order]
        sized = sized.unionByName(opened.filter("held > 0").select("_key", *blank, F.col("held").alias("_size")))
    laid = lay_out(sized, ["_key"], order, blocks)  # rows without a place come first
    if not laid.groupBy("_key", *order).count().filter("count > 1").isEmpty():
        # rows alike in key and order are numbered, by their bodies, so that each has a place of its own
        alike = Window.partitionBy("_key", *order).orderBy(F.xxhash64("_body"), "_body")
        told = events.withColumn("_alike", F.row_number().over(alike))
        found, left = continued_batches(told, max_bytes, (*order, "_alike"), opened, blocks)
        return found.drop("_alike"), left
    numbered = _batches_of(laid, max_bytes, order)
    if opened is not None:
        # a batch that was open is the first one of these events
        earlier = opened.select("_key", (F.col("batches") - (F.col("held") > 0).cast("int")).alias("_earlier")).filter("_earlier > 0")
        numbered = _plus_earlier(numbered, earlier, order)
    numbered = cut(numbered)
    return _with_batches(events, numbered.filter(F.col(order[0]).isNotNull()), order), _left_open(numbered, opened, order)


def _plus_earlier(numbered: DataFrame, earlier: DataFrame, order: Sequence[str]) -> DataFrame:
    """Batch numbers after those a key has had already; a key's rows are spread over tasks."""
    named = F.coalesce(F.concat(F.lit("="), F.col("_key").cast("string")), F.lit(""))  # a missing key is told from an empty one
    met = attach(numbered.withColumn("_of", named), earlier.select(named.alias("_of"), "_earlier"), ["_of"], order, "left")
    return met.withColumn("_batch", F.col("_batch") + F.coalesce("_earlier", F.lit(0))).drop("_of", "_earlier")


def _left_open(numbered: DataFrame, opened: DataFrame | None, order: Sequence[str]) -> DataFrame:
    """(_key, held, batches) after all rows: the last batch, and its bytes unless an event too large has closed it."""
    place = F.struct(F.col(order[0]).isNotNull(), *order)
    batches = numbered.groupBy("_key", "_batch").agg(F.sum("_size").alias("_bytes"), F.max(place).alias("_last"))
    ends = batches.groupBy("_key").agg(
        F.max("_batch").alias("batches"), F.max_by("_bytes", "_batch").alias("_bytes"), F.max_by("_last", "_batch").alias("_at"),
        F.max(F.when(F.col("_batch").isNull(), F.col("_last"))).alias("_closed_at"),
    )
    closed = F.col("batches").isNull() | F.coalesce(F.col("_closed_at") > F.col("_at"), F.lit(False))
    now = ends.select("_key", F.when(closed, 0).otherwise(F.col("_bytes")).cast("bigint").alias("held"), F.col("batches"))
    if opened is None:
        return now.withColumn("batches", F.coalesce("batches", F.lit(0).cast("bigint")))
    had = opened.select(F.col("_key").alias("_of"), F.col("held").alias("_held"), F.col("batches").alias("_had"))
    both = now.join(had, F.col("_key").eqNullSafe(F.col("_of")), "full_outer")
    untouched = F.col("held").isNull()
    return both.select(
        F.when(untouched, F.col("_of")).otherwise(F.col("_key")).alias("_key"),
        F.coalesce("held", "_held").alias("held"),
        F.coalesce("batches", "_had", F.lit(0)).cast("bigint").alias("batches"),
    )


def _with_batches(events: DataFrame, numbered: DataFrame, order: Sequence[str]) -> DataFrame:
    """Events, bodies included, with the batch of their key and place; bodies move once, spread by key and place."""
    places = [F.col(c).alias(f"_at_{i}") for i, c in enumerate(order)]
    known = numbered.select(F.col("_key").alias("_of"), *places, "_batch")
    same = F.col("_key").eqNullSafe(F.col("_of"))
    for i, c in enumerate(order):
        same = same & (F.col(c) == F.col(f"_at_{i}"))
    return events.join(known, same).select(*events.columns, "_batch")


def _batches_of(laid: DataFrame, max_bytes: int, order: list[str]) -> DataFrame:
    """The narrow rows of a layout (key, order, size) with their ``_batch``."""
    parts = laid.groupBy("_key", BLOCK).agg(F.lit(1).alias("_one"))
    parts = parts.withColumn("_parts", F.count("_one").over(Window.partitionBy("_key"))).filter("_parts > 1")
    in_part = (laid["_key"].eqNullSafe(parts["_key"])) & (laid[BLOCK] == parts[BLOCK])
    # At most two groups per block are parts of a larger group.
    large = laid.join(F.broadcast(parts), in_part, "left_semi").select("_key", BLOCK, "_size", F.monotonically_increasing_id().alias("_row"))
    key_type = laid.schema["_key"].dataType.simpleString()
    summaries = large.groupBy("_key", BLOCK).applyInPandas(
        _summarise_block(max_bytes),
        f"_key {key_type}, {BLOCK} int, rest bigint, opened bigint, total bigint, "
        "steps array<struct<upto:bigint,rest:bigint,opened:bigint>>",
    )
    starts = summaries.groupBy("_key").applyInPandas(
        _chain_blocks(max_bytes), f"_key {key_type}, {BLOCK} int, _held bigint, _batches bigint"
    )
    at_start = (laid["_key"].eqNullSafe(starts["_key"])) & (laid[BLOCK] == starts[BLOCK])
    ready = laid.join(F.broadcast(starts), at_start, "left").select(
        *[laid[c] for c in laid.columns], "_held", "_batches"
    )
    schema = T.StructType([*ready.schema.fields, T.StructField("_batch", T.LongType())])
    filled = ready.mapInArrow(_fill_batches(max_bytes), schema)
    return filled.drop("_held", "_batches", BLOCK)


def in_log_partitions(events: DataFrame, partitions: int, order: Sequence[str] = ("_event_ms", "_ord")) -> DataFrame:
    """Assign every event its log partition: by key hash, unkeyed rows spread over all."""
    spread = F.when(F.col("_key").isNotNull(), F.xxhash64("_key")).otherwise(F.xxhash64(*order))
    return events.withColumn("log_partition", F.pmod(spread, F.lit(partitions)).cast("int"))


def write_keyed_events(
    events: DataFrame,
    path: str,
    partitions: int = 32,
    order: Sequence[str] = ("_event_ms", "_ord"),
    source_format: str = "parquet",
    mode: str = "append",
    also: Sequence[str] = (),
) -> None:
    """Write (key, body) by log partition; within one, file order then row order is event-time order.

    Rows are range-partitioned by (log partition, time), so a log partition that
    a hot key fills is written by many tasks and still reads back in order.
    """
    placed = in_log_partitions(events, partitions, order)
    columns = ["log_partition", *[F.col(c).asc_nulls_last() for c in order]]
    width = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        placed.repartitionByRange(width, *columns)
        .sortWithinPartitions(*columns)
        .select("log_partition", F.col("_key").alias("key"), F.col("_body").alias("body"), *order, *also)
        .write.mode(mode)
        .partitionBy("log_partition")
        .format(source_format)
        .save(path)
    )


def send_summary(batched: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: rows read, batches, skipped rows, distinct keys (unkeyed rows are one), success flag.

    ``batched`` is the result of size_bounded_batches, ``skipped`` the rows left out for want of a key.
    """
    per_key = batched.groupBy("_key").agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.coalesce(F.max("_batch"), F.lit(0)).alias("batches"),
        F.sum(F.col("_batch").isNull().cast("bigint")).alias("skipped"),
        F.lit(1).cast("bigint").alias("keys"),
    )
    unkeyed = skipped.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.lit(0).cast("bigint").alias("batches"),
        F.count(F.lit(1)).alias("skipped"),
        F.lit(0).cast("bigint").alias("keys"),
    )
    return (
        per_key.drop("_key")
        .unionByName(unkeyed)
        .agg(
            F.sum("rows_read").alias("rows_read"),
            F.sum("batches").alias("batches_sent"),
            F.sum("skipped").alias("rows_skipped"),
            F.sum("keys").alias("distinct_keys"),
        )
        .withColumn("ok", F.col("rows_skipped") == 0)
    )
