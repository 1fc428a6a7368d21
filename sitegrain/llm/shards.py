"""Sharding by a two-pass external shuffle.

Pass one scatters whole records by a seeded hash over as many buckets as keep one in memory. Pass two orders each bucket's records by a
seeded Fisher-Yates shuffle and writes them in that order. Buckets lie one after another, so that the records written are one shuffled sequence;
its n runs of equal length, lengths one apart at most, are the shards. ``write`` stores a folder a shard, its records in slot order, without moving a record.

The hash takes in a record's file and row, so copies and repeated ids scatter too, and the result is the same whatever the splits or lost
executors. Null text counts no bytes, a null id is hashed as null. Columns of the caller keep their names, but for ``_size``, ``_shard``
and ``_slot``, which are replaced. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from sitegrain.operators.links import PLACE, with_places
from sitegrain.session import stage

OVERHEAD = 16
BLOCK = 4096  # buckets whose sizes are added up by one task


def _fisher_yates(size: int, draw: np.random.Generator) -> np.ndarray:
    order = list(range(size))
    for i, j in zip(range(size - 1, 0, -1), draw.integers(0, np.arange(size, 1, -1)).tolist()):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _starts(counts: DataFrame) -> DataFrame:
    """(_bucket, _before): records in earlier buckets. Sums by block of buckets reach the driver: one for 256 GB of records at the usual size."""
    block = F.floor(F.col("_bucket") / BLOCK).alias("_block")
    blocks = sorted(map(tuple, counts.groupBy(block).agg(F.sum("count")).collect()))
    sums = [0, *accumulate(n for _, n in blocks)]
    earlier = counts.sparkSession.createDataFrame([(b, n) for (b, _), n in zip(blocks, sums)], "_block long, _sum long")
    within = F.sum("count").over(Window.partitionBy("_block").orderBy("_bucket")) - F.col("count") + F.col("_sum")
    return counts.select("_bucket", "count", block).join(earlier, "_block").select("_bucket", within.alias("_before"))


def shuffled(docs: DataFrame, n_shards: int = 40, seed: int = 1, bucket_bytes: int = 64 << 20) -> DataFrame:
    """All rows of ``docs`` with ``_size``, ``_shard`` and ``_slot``, read back from the buckets written."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))
    own = docs.drop("_size", "_shard", "_slot")
    row = F.struct(*[F.col(f"`{name}`") for name in own.columns])
    placed = with_places(docs.select(row.alias("_row"), size.alias("_size")))
    name = F.substring_index(PLACE[0], "/", -1)  # the same wherever the files lie
    salt = F.xxhash64(F.col("_row.doc_id"), F.lit(seed), name, F.col(PLACE[1]))
    keyed = placed.select("_row", "_size", name.alias("_file"), F.col(PLACE[1]).alias("_at"), salt.alias("_salt"), F.pmod(salt, F.lit(buckets)).cast("int").alias("_bucket"))
    schema = StructType(keyed.select("_row", "_size", "_bucket").schema.fields).add("_place", LongType())

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hold one bucket at a time, and give it out in shuffled order."""

        def done(bucket: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            picks = _fisher_yates(len(table), np.random.default_rng([seed, bucket]))
            for first in range(0, len(picks), 1000):
                part = table.take(picks[first : first + 1000])
                place = pa.array(np.arange(first, first + len(part)))
                yield from part.append_column("_place", place).combine_chunks().to_batches()

        bucket, held = None, []
        for batch in batches:
            batch = batch.select(["_row", "_size", "_bucket"])
            numbers = batch.column("_bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and numbers[a] != bucket:
                    yield from done(bucket, held)
                    held = []
                bucket = int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from done(bucket, held)

    scattered = keyed.repartition(min(buckets, 20_000), "_bucket").sortWithinPartitions("_bucket", "_salt", "_file", "_at")
    written = stage(scattered.mapInArrow(order, schema), "buckets")
    counts = stage(written.groupBy("_bucket").count(), "counts")
    rows = counts.agg(F.sum("count")).first()[0] or 0
    least, longer = divmod(rows, n_shards)  # the first ``longer`` shards hold one more
    at = F.col("_before") + F.col("_place")
    edge = longer * (least + 1)
    shard = F.when(at < edge, F.floor(at / (least + 1))).otherwise(longer + F.floor((at - edge) / max(least, 1)))
    slot = F.when(at < edge, at % (least + 1)).otherwise((at - edge) % max(least, 1))
    out = written.join(stage(_starts(counts), "starts"), "_bucket")
    return out.select("_row.*", "_size", shard.cast("int").alias("_shard"), slot.cast("long").alias("_slot"))


def write(records: DataFrame, path: str) -> None:
    """Store the result of ``shuffled`` as ``path/_shard=s``. A task holds runs of one sequence, so that a shard gets few files and each is in slot order."""
    records.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
