"""The set of visited URLs, kept between crawls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from sitegrain.session import stage
from sitegrain.sources.buckets import BucketTable

VISITED = StructType([StructField("url", StringType(), False)])
_SEGMENT = 32_768  # bits of one of Spark's bitmaps
_BLOOM = StructType([StructField("segments", IntegerType()), StructField("segment", IntegerType()), StructField("bits", BinaryType())])
_PROBES = 3


@dataclass(frozen=True)
class VisitedSet(BucketTable):
    """URLs in buckets, each write with Bloom filters of its buckets beside it.

    A question is put to the filters of its URLs' buckets first; only what these may hold is compared with stored URLs, and
    only in the buckets concerned. A filter has about ``bits_per_url`` bits for each URL of its bucket, in segments of 4 kB.
    """

    schema: StructType = VISITED
    key: str = "url"
    bits_per_url: int = 12

    def _beside(self, version: int, keys: DataFrame) -> None:
        n = keys.count()
        segments = max(1, -(-n * self.bits_per_url // (self.buckets * _SEGMENT)))
        probes = keys.select("bucket", F.explode(self._slots(segments)).alias("_slot"))
        at = probes.select("bucket", *self._place(F.col("_slot")))
        filters = at.groupBy("bucket", "segment").agg(F.bitmap_construct_agg("bit").alias("bits"))
        rows = filters.select("bucket", F.lit(segments).alias("segments"), "segment", "bits")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/blooms/version={version}")

    @staticmethod
    def _slots(segments):
        """Where a URL's bits are among those of its bucket's filter."""
        bits = (F.lit(segments) if isinstance(segments, int) else segments).cast("long") * _SEGMENT
        return F.array(*[F.pmod(F.xxhash64("url", F.lit(i)), bits) for i in range(_PROBES)])

    @staticmethod
    def _place(slot):
        return F.floor(slot / _SEGMENT).cast("int").alias("segment"), F.pmod(slot, F.lit(_SEGMENT)).alias("bit")

    def add(self, urls: DataFrame, url: str = "url", tag: str = "") -> None:
        """Mark URLs as visited; those known already may be given again."""
        listed = urls.select(F.col(url).alias("url")).filter("url is not null").distinct()
        self.append(listed, tag)

    def maybe(self, asked: DataFrame) -> DataFrame:
        """Those of the distinct ``asked(url, bucket)`` that a filter lets through: all visited ones and few others."""
        buckets = sorted(r[0] for r in asked.select("bucket").distinct().collect())
        paths = self._paths("blooms", buckets)
        if not paths:
            return asked.filter("false")
        blooms = self._read("blooms", _BLOOM, paths)
        # One row for each write whose filters are asked.
        sizes = [F.struct(F.lit(r.version).alias("version"), F.lit(r.segments).alias("segments")) for r in blooms.select("version", "segments").distinct().collect()]
        each = asked.select("url", "bucket", F.explode(F.array(*sizes)).alias("_of"))
        probes = each.select("url", "bucket", F.col("_of.version").alias("version"), F.explode(self._slots(F.col("_of.segments"))).alias("_slot"))
        placed = probes.select("url", "bucket", "version", *self._place(F.col("_slot")))
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        found = placed.join(blooms, ["version", "bucket", "segment"]).filter(F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1)
        whole = found.groupBy("url", "bucket", "version").agg(F.count("*").alias("_n")).filter(F.col("_n") == _PROBES)
        return whole.select("url", "bucket").distinct()

    def visited(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """The distinct URLs among these that are in the set."""
        asked = urls.select(F.col(url).alias("url")).filter("url is not null").distinct().withColumn("bucket", self.bucket_of("url"))
        likely = stage(self.maybe(stage(asked, "asked")), "likely")
        buckets = sorted(r[0] for r in likely.select("bucket").distinct().collect())
        return stage(likely.select("url").join(self.keys(buckets).select("url"), "url", "left_semi"), "known")

    def unvisited(self, rows: DataFrame, url: str = "url") -> DataFrame:
        """Rows whose URL is not in the set."""
        return rows.join(self.visited(rows, url).select(F.col("url").alias(url)), url, "left_anti")
