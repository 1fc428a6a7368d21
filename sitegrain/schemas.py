"""Explicit schemas of the stored tables and of records in flight."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DecimalType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)


def _text(*names: str, nullable: bool = True) -> list[StructField]:
    return [StructField(name, StringType(), nullable) for name in names]


RAW_PAGES = StructType(
    [
        *_text("url", nullable=False),
        *_text("content_type"),
        *_text("raw_content", nullable=False),
        StructField("fetched_at", TimestampNTZType(), False),
    ]
)

EXTRACTED_JOBS = StructType(
    [
        *_text("title", "company", nullable=False),
        *_text("location", "salary", "description", "link", "skills"),
        StructField("created_at", TimestampType(), False),
        StructField("updated_at", TimestampType(), False),
    ]
)

JOB_LISTINGS = StructType(
    [
        *_text("title", nullable=False),
        *_text("company", "location"),
        StructField("remote_flag", BooleanType()),
        StructField("salary_min", DecimalType(18, 4)),
        StructField("salary_max", DecimalType(18, 4)),
        *_text("currency", "description_html", "description_text"),
        StructField("posted_date", DateType()),
        StructField("expires_at", DateType()),
        *_text("source", nullable=False),
        *_text("source_id"),
        *_text("url", nullable=False),
        StructField("tags", ArrayType(StringType())),
        *_text("raw_json"),
        StructField("crawl_timestamp", TimestampNTZType(), False),
    ]
)

# One record as a model returns it.
JOB_RECORD = StructType(
    [
        *_text("job_title", "company_name", "location", "salary_range", "description"),
        StructField("required_skills", ArrayType(StringType())),
        *_text("links"),
    ]
)

DECODED_RESPONSE = StructType([*_text("status"), StructField("jobs", ArrayType(JOB_RECORD))])
