"""A user's extractor that fails on some pages: the others are answered, the failed ones told apart."""

import pytest
from extractors import failing_on_bad, row_by_row, whole_batches, wrong_columns
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sitegrain.operators import extract
from sitegrain.plans import jobs
from sitegrain.schemas import EXTRACTED_JOBS, RAW_PAGES
from sitegrain.sources.buckets import BucketTable
from sitegrain.sources.snapshots import SnapshotTable

ANSWER = StructType([StructField("id", LongType()), StructField("answer", StringType())])


def run(spark, fn, n=95):
    rows = spark.range(n).withColumn("prompt", F.lit("p")).coalesce(2)
    return {r.id: (r.answer, r.error) for r in extract.extract_apart(rows, fn, ANSWER, ["id"]).collect()}


def test_a_failing_batch_is_halved_down_to_the_failing_rows(spark):
    got = run(spark, whole_batches)
    assert got == {i: (None, f"ValueError: bad {i}") if i % 10 == 3 else ("ok", None) for i in range(95)}


def test_answers_before_a_failure_are_kept_and_missing_ones_told(spark):
    want = {i: ("ok", None) for i in range(95)}
    want |= {i: (None, f"KeyError: {i}") for i in range(3, 95, 10)} | {i: (None, "no answer") for i in range(7, 95, 10)}
    got = run(spark, row_by_row)
    # A skipped row is seen as unanswered, or as failing beside the row that raises; both are told.
    assert {i: a for i, (a, _) in got.items()} == {i: a for i, (a, _) in want.items()}
    assert all((e is None) == (want[i][1] is None) for i, (_, e) in got.items())


def test_an_extractor_that_always_fails_and_one_without_rows(spark):
    assert all(a is None and e.startswith("KeyError") for a, e in run(spark, wrong_columns, 9).values())
    assert run(spark, whole_batches, 0) == {}


@pytest.mark.parametrize("kind", ["snapshot", "buckets"])
def test_the_job_goes_on_past_a_failing_page(spark, tmp_path, kind):
    if kind == "buckets":
        raw = BucketTable(spark, str(tmp_path / "raw"), RAW_PAGES, "url", buckets=4)
        extracted = BucketTable(spark, str(tmp_path / "jobs"), EXTRACTED_JOBS, "link", buckets=4)
    else:
        raw, extracted = SnapshotTable(spark, str(tmp_path / "raw"), RAW_PAGES), SnapshotTable(spark, str(tmp_path / "jobs"), EXTRACTED_JOBS)
    at = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    pages = spark.range(20).select(
        F.concat(F.lit("u"), "id").alias("url"), F.lit("text/html").alias("content_type"),
        F.when(F.col("id") % 6 == 1, "BAD").otherwise("fine").alias("raw_content"),
        F.when(F.col("id") < 18, at).otherwise(F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")).alias("fetched_at"),
    )
    raw.commit(pages)
    used = jobs.parse_to_extracted(raw, extracted, str(tmp_path / "failed"), failing_on_bad, at)
    bad = {f"u{i}" for i in range(18) if i % 6 == 1}
    failed = spark.read.parquet(f"{tmp_path}/failed/*").collect()
    assert used == 18 and {r.url: r.reason for r in failed} == dict.fromkeys(bad, "RuntimeError: no")
    assert {r.link for r in extracted.read().collect()} == {f"u{i}" for i in range(18)} - bad
    assert {r.url for r in raw.read().collect()} == {"u18", "u19"}  # older pages were not read and stay
