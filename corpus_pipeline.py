"""A corpus pipeline of five stages, each over all that its predecessor kept.

Language ID drops rows without a language, near-dedup keeps one row a group, decontamination drops rows that hold a benchmark item,
personal data is replaced by its kind, and the texts left are encoded and decoded. Columns that documents do not have are left out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain.llm import decontaminate, language, minhash, pieces, private
from sitegrain.operators.links import PLACE, rows_at, with_places
from sitegrain.session import configure, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark, docs, sf_dir):
    configure(spark)
    return language.identify(docs.select(*COLUMNS)).filter("lang_pred != 'und'").select(*COLUMNS)


def _text_key():
    """Tells texts apart whatever their rows' ids: a null or repeated id names no text."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return F.struct(F.xxhash64(text).alias("h"), F.crc32(text).alias("c"))


def one_of_each_group(spark, docs, sf_dir):
    """Of rows with the same text one stays, whatever their ids: one with an id if there is, the least. Rows without words all stay.

    Rows without an id are compared by whole texts only. Keys and places move, and texts do not.
    """
    configure(spark)
    kept = stage(minhash.near_duplicates(docs, size=5).filter("kept").select("doc_id").distinct(), "kept")
    placed = with_places(docs)
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = stage(placed.select("doc_id", words.alias("words"), _text_key().alias("text"), *PLACE), "texts")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *PLACE)
    left = rows.join(kept, rows["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select("words", "text", row.alias("row"))
    left = stage(left, "left")
    first = left.filter("words").groupBy("text").agg(F.min("row").alias("row")).select("row")
    stay = first.union(left.filter("not words").select("row"))
    return rows_at(placed, stay.select(*[f"row.{name}" for name in PLACE])).select(*docs.columns)


def without_benchmark(spark, docs, sf_dir):
    """Rows are judged by their texts, with or without an id."""
    configure(spark)
    keyed = docs.withColumn("_key", _text_key())
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.leaks(keyed.select(F.col("_key").alias("doc_id"), "text"), bench)
    found = stage(leaks.select(F.col("doc_id").alias("_key")).distinct(), "leaks")
    return keyed.join(found, "_key", "left_anti").select(*docs.columns)


def without_personal_data(spark, docs, sf_dir):
    configure(spark)
    clean = private.masked(private.find(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def as_pieces(spark, docs, sf_dir):
    """doc_id, ids, number of ids, and the text decoded from them."""
    configure(spark)
    coded = docs.select("doc_id", pieces.encode(F.col("text")).alias("ids"))
    return coded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), pieces.decode(F.col("ids")).alias("text"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("sentencepiece", as_pieces),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
