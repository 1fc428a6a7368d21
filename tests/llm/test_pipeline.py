"""The corpus pipeline on a small table whose right result is known."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    draw = random.Random(5)
    say = lambda sounds, n: " ".join("".join(draw.choice(sounds) for _ in range(3)) for _ in range(n))
    aa, bb = ["ka", "to", "mi", "re"], ["schu", "ber", "ung", "ei"]
    docs = [(i, say((aa, bb)[i % 2], 60), ("aa", "bb")[i % 2], "s", 1) for i in range(40)]
    item = say(aa, 20)
    copy = docs[3][1]
    docs += [(50, copy, "bb", "s", 1), (51, copy + " " + say(bb, 2), "bb", "s", 1), (52, f"{say(aa, 30)} {item}", "aa", "s", 1), (53, "12 34 !!", None, "s", 1), (54, None, None, None, None)]
    docs += [(55, say(aa, 50) + " mail me@here.example", "aa", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(40), 55}
    assert got[55].text == docs[-1][1].replace("me@here.example", "<EMAIL>")
    assert all(got[i].text == docs[i][1] and got[i].n_ids == len(got[i].ids) for i in range(40))


def test_repeated_and_null_ids_and_other_columns(spark, tmp_path):
    draw = random.Random(7)
    say = lambda n: " ".join("".join(draw.choice(["ka", "to", "mi", "re"]) for _ in range(3)) for _ in range(n))
    item, copy, other = say(20), say(60), say(50)
    docs = [(i, say(60), "aa", "s", 1, "x", 2, "p") for i in range(20)]
    docs += [(100, copy, "aa", "s", 1, "x", 2, "p")] * 2 + [(None, copy, "aa", "s", 1, "x", 2, "p")] * 2
    docs += [(None, other, "aa", "s", 1, "x", 2, "p")] * 3
    docs += [(None, f"{say(20)} {item}", "aa", "s", 1, "x", 2, "p"), (3, f"{item} {say(40)}", "aa", "s", 1, "x", 2, "p")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, _key int, pii string"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    want = sorted([(d[0], d[1]) for d in docs[:20]] + [(100, copy), (None, other)], key=str)
    assert got == want
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        frame = step(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_dedup_leaves_texts_where_they_lie(spark, tmp_path):
    draw = random.Random(9)
    say = lambda n: " ".join("".join(draw.choice(["ka", "to", "mi", "re"]) for _ in range(3)) for _ in range(n))
    texts = [say(6) for _ in range(3000)]
    docs = [(draw.getrandbits(60), t, "aa", "s", 1) for t in texts + texts[:50]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # less than the ids that are kept
    try:
        kept = corpus_pipeline.one_of_each_group(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.text for r in kept.collect()) == sorted(texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
