"""Queries of the corpus operators, each over whole tables."""

from __future__ import annotations

import hashlib
import string

import pandas as pd
from pyspark.sql import functions as F

from sitegrain.llm import article, chat, collocations, decontaminate, language, merkle, minhash, oracles, pieces, private, shards, substrings, topk, toxicity


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(texts):
    return F.sha2(texts, 256)


def op1_substring_dedup(spark, sf_dir):
    kept = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", _sha("kept").alias("kept_sha256"))


def op2_sentencepiece(spark, sf_dir):
    """Ids of every text and the text they decode to, as digests."""
    coded = _table(spark, sf_dir, "documents").select("doc_id", "text", pieces.encode(F.col("text")).alias("ids"))

    @F.pandas_udf("n_ids long, ids_sha256 string, decoded_sha256 string, same boolean")
    def back(text: pd.Series, ids: pd.Series) -> pd.DataFrame:
        coder, out = pieces.coder(pieces.VOCABULARY), []
        for t, x in zip(text, ids):
            d = coder.decode(x)
            out.append((0 if x is None else len(x), None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest(), None if d is None else hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest(), d == t))
        return pd.DataFrame(out, columns=["n_ids", "ids_sha256", "decoded_sha256", "same"])

    return coded.select("doc_id", back("text", "ids").alias("b")).select("doc_id", "b.*")


def op3_pii(spark, sf_dir):
    return private.digest(private.find(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_shards(spark, sf_dir):
    out = shards.shuffled(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return out.select("doc_id", F.col("_size").alias("size"), crc.cast("long").alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_topk(spark, sf_dir):
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op7_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    table = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(chat.pieces(table.union(more))))


def op8_minhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_article(spark, sf_dir):
    return article.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_language(spark, sf_dir):
    return language.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_merkle(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    lowered = merkle.document_leaf(F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    leaves = docs.select("doc_id", "source", merkle.document_leaf().alias("leaf"), F.when(tampered, lowered).alias("changed"))
    found = merkle.manifest(leaves).withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("proof")))
    proof = _sha(merkle.siblings(F.col("proof"))).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_toxicity(spark, sf_dir):
    return toxicity.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op13_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_sentencepiece, op3_pii, op4_decontaminate, op5_shards, op6_topk, op7_chat, op8_minhash, op9_article, op10_language, op11_merkle, op12_toxicity, op13_collocations, pipeline)}

SQL = {
    "op6_topk": """with v as (select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
        where embedding is not null and list_bool_and([x is not null and isfinite(x) for x in embedding])),
      s as (select q.vec_id as query_id, c.vec_id, cast(list_sum([a[1] * a[2] for a in list_zip(q.v, c.v)]) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
      r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
      select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20""",
    "op11_merkle": oracles.merkle(),
    "op13_collocations": oracles.collocations(),
}
