"""Rows laid out once by a key, so that every later join with a list of keys leaves them where they are."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.session import stage, staging_root

HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Layout:
    """Rows in a bucketed table of the staging folder.

    ``hot(key, _parts)`` lists the keys whose rows are dealt into several shares, which ``_part`` numbers; None if there are none.
    """

    rows: DataFrame
    key: str
    hot: DataFrame | None

    def joined(self, wanted: DataFrame) -> DataFrame:
        """The rows whose key is wanted, with the other columns of ``wanted``, which holds each key once.

        Only ``wanted`` is moved; a hot key goes to each of its shares.
        """
        if self.hot is None:
            return self.rows.join(wanted, self.key)
        parts = wanted.join(self.hot, self.key, "left")
        every = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
        asked = parts.select(*wanted.columns, F.explode(every).alias("_part"))
        return self.rows.join(asked, [self.key, "_part"]).drop("_part")


def lay_out(rows: DataFrame, key: str, label: str, hot_rows: int = HOT_ROWS) -> Layout:
    """Write ``rows`` in buckets of ``key``, a file a bucket; keys of more than ``hot_rows`` rows are dealt over several.

    Rows without a key are left out, as no list can ask for them. This is the only time the rows are shuffled.
    """
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.filter(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    # At most one key for every ``hot_rows`` rows.
    hot = stage(counts.select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts")), f"{label}-hot")
    by = [key]
    if hot.isEmpty():
        hot, dealt = None, rows
    else:
        by = [key, "_part"]
        share = F.pmod(F.xxhash64(*[name for name in rows.columns if name != key]), F.coalesce(F.col("_parts"), F.lit(1)))
        dealt = rows.join(hot, key, "left").withColumn("_part", share.cast("int")).drop("_parts")
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{staging_root(spark)}/{name}"
    writer = dealt.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by)
    writer.option("path", path).saveAsTable(name)
    laid = spark.table(name)
    spark.sql(f"drop table {name}")  # from the catalogue only: the files are those of the staging folder
    return Layout(laid, key, hot)
