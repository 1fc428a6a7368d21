"""P2 as an incremental stream over a folder of raw pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sitegrain.operators import stored
from sitegrain.plans.jobs import RECORD_ORDER, Extractor, parse_pages
from sitegrain.schemas import RAW_PAGES

CONSUMED = StructType([RAW_PAGES["url"], RAW_PAGES["fetched_at"]])


def parse_stream(
    spark: SparkSession,
    raw_path: str,
    extracted: stored.Table,
    failures_path: str,
    checkpoint: str,
    fn: Extractor,
    use_clean: bool = False,
    link_from: str = "page",
    now: Column | None = None,
    files_per_batch: int | None = None,
    raw: stored.Table | None = None,
    consumed_path: str | None = None,
    all_may_fail: bool = False,
) -> StreamingQuery:
    """Parse the files that arrived since the last run, then stop.

    The stream's checkpoint takes the place of the start date. A batch is committed under a tag of
    the query's id and its own number, and its failures overwrite a folder of that name, so a
    batch run again after a crash changes nothing.

    ``raw`` is the table that holds the arriving pages, if one does: the pages a batch has used are deleted from it, as read, after
    its records are stored. They are listed in ``consumed_path`` first, by batch, so that a batch run again deletes
    from its list, once.
    """
    if (raw is None) != (consumed_path is None):
        raise ValueError("give both raw and consumed_path, or neither")
    reader = spark.readStream.schema(RAW_PAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def apply(batch: DataFrame, batch_id: int) -> None:
        tag = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        if not extracted.has(tag):
            parsed = parse_pages(batch, fn, use_clean, link_from, all_may_fail)
            parsed.failures.write.mode("overwrite").parquet(f"{failures_path}/{tag}")
            if consumed_path is not None:
                parsed.used.write.mode("overwrite").parquet(f"{consumed_path}/{tag}")
            stored.upsert_extracted(extracted, parsed.records, RECORD_ORDER, now, tag)
        if raw is not None and not raw.has(tag):
            used = spark.read.schema(CONSUMED).parquet(f"{consumed_path}/{tag}")
            stored.delete_by_urls(raw, used, CONSUMED.names, tag)

    return (
        reader.parquet(raw_path)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
