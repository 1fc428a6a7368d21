"""Corpus operators against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrain.llm import article, chat, decontaminate, language, minhash, pieces, private, shards, substrings, topk
from sitegrain.operators import links

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=1, n=40):
    """Random texts with copies, near copies, a passage that many share, and odd rows."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 4)))
    passage = [word() for _ in range(70)]
    out = []
    for i in range(n):
        w = [word() for _ in range(draw.choice([3, 30, 120, 200]))]
        if i % 3 == 0:
            at = draw.randint(0, len(w))
            w[at:at] = passage if i % 2 else passage[5:60]
        if i % 7 == 3 and out:
            w = out[draw.randrange(len(out))].split()
            if i % 2 and len(w) > 20:
                w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    return [*out, "", " \t\n", None, "one", "Two words", "x" * 30_000]


@pytest.fixture
def docs(spark):
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts())] + [(None, "null id", None, None, None), (0, texts()[0], "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substrings_equal_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - 49 if d is not None else 0):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    want = []
    for d, t in rows:
        w = split(t)
        gone = {j for i in range(len(w) - 49 if d is not None else 0) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [tuple(r) for r in substrings.without_repeats(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 500


def test_texts_without_repeats_stay_where_they_lie(spark, tmp_path):
    """Only rows of an id with a repeat are joined to their spans; null and repeated ids keep every row."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "a " + passage), (2, passage + " b"), (3, "own"), (3, passage), (None, passage), (None, None), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    made = substrings.without_repeats(spark.read.parquet(str(tmp_path / "d")))
    assert not re.search(r"Join LeftOuter, \(doc_id#", made._jdf.queryExecution().optimizedPlan().toString())
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in made.collect()), key=str)
    want = [(1, 61, 0, "a " + passage), (2, 61, 60, "b"), (3, 1, 1, ""), (3, 60, 60, ""), (None, 60, 0, passage), (None, 0, 0, ""), (4, 0, 0, ""), (5, 0, 0, "")]
    assert got == sorted(want, key=str)


def sets(t, size):
    w = split("".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def test_near_duplicates_equal_brute_force(docs):
    rows = {r.doc_id: sets(r.text, 4) for r in docs.collect() if r.doc_id is not None}
    root = {d: d for d in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and rows[a] and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(d, len(s), find(d), find(d) == d) for d, s in rows.items()}
    assert len(got) == docs.count()
    assert any(not r.kept for r in got)


def test_crowded_bands_lose_no_link(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"{i // 4}v{j}" for j in range(60 + i % 4)]), None, None, None) for i in range(60)]
    frame = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, crowd=2).collect()}
    assert got == {i: i - i % 4 for i in range(60)}


def test_unlike_members_of_a_band_are_not_paired(spark, monkeypatch):
    """Pairs whose signatures cannot agree in enough slots make no rows; of those that can none is lost."""
    draw = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"w{draw.randrange(10**9)}" for _ in range(50)])) for i in range(50)]
    frame, pairs, told = spark.createDataFrame(rows, "doc_id long, text string"), [], minhash._links

    def links(found, sigs, *rest):
        near = minhash._likely(found, sigs, 0.59)
        pairs.append((found.count(), near.count()))
        return told(found, sigs, *rest)

    monkeypatch.setattr(minhash, "_links", links)
    assert all(r.kept for r in minhash.near_duplicates(frame).collect())
    after = pairs[1:]  # the first are those with a band's least member
    assert sum(n for n, _ in after) <= 4 * sum(n for _, n in after) + 40


def test_brief_signatures_lose_no_likely_pair(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(200):
        x = draw.random(minhash.SLOTS).astype(np.float32)
        y = np.where(draw.random(minhash.SLOTS) < i / 200, x, draw.random(minhash.SLOTS)).astype(np.float32)
        rows.append((i, minhash._brief(x).tolist(), minhash._brief(y).tolist(), float((x == y).mean())))
    frame = spark.createDataFrame(rows, "i long, x array<long>, y array<long>, share double")
    got = {r.i: r.may for r in frame.select("i", minhash._may("x", "y", 0.59).alias("may")).collect()}
    assert all(got[i] for i, _, _, share in rows if share >= 0.59)
    assert not any(got[i] for i, _, _, share in rows if share < 0.4)


def test_components_joined_by_more_links_and_unchanged_without(spark):
    first, more = [(2, 1), (3, 2), (6, 5), (9, 8)], [(6, 3), (20, 9), (31, 30), (2, 1)]
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    roots = minhash.components(frame(first))
    got = minhash._joined(roots, frame(more))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, minhash.components(frame(first + more)).collect()))
    assert sorted(map(tuple, minhash._joined(roots, frame([(3, 1)])).collect())) == sorted(map(tuple, roots.collect()))


def test_rows_at_places_and_all_others(spark, tmp_path):
    spark.range(70_000).coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.range(70_000, 70_100).repartition(3).write.parquet(f"{tmp_path}/b")
    placed = links.with_places(spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b"))
    wanted = [0, 1, 7, 8, 32767, 32768, 32769, 65535, 65536, 69999, 70001, 70050]
    listed = placed.filter(F.col("id").isin(wanted)).select(*links.PLACE)
    for some in (listed, listed.union(listed)):
        assert sorted(r.id for r in links.rows_at(placed, some).collect()) == wanted
        assert sorted(r.id for r in links.rows_at(placed, some, wanted=False).collect()) == sorted(set(range(70_100)) - set(wanted))
    assert links.rows_at(placed, listed.filter("false")).count() == 0


PRIVATE = [
    "mail a.b+c@x-y.example.org, a@b.c_x@d.e and 1.2.3.4 or 1.2.3.999 or 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 not 4111 1111 1111 1112; +49 (30) 123-4567 and +1 2 +123456789012345678",
    "é😀 +1 555 010 9999 é x@y x@y.z. GB82 WEST 1234 5698 7654 32 iban GB82WEST12345698765433",
    "9" * 5000 + " " + "a" * 5000 + "@" + "a." * 2000 + "b " + "1." * 3000, "", None,
]


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_spans(t):
    t, out = t or "", []
    for no, (kind, pattern) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_private_data_equals_brute_force(spark):
    frame = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    got = {r.doc_id: r for r in private.digest(private.find(frame)).collect()}
    for i, t in enumerate(PRIVATE):
        assert got[i].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest(), i
    assert got[2].n_iban == 1 and "iban:" in got[2].spans
    clean = {r.doc_id: r.text for r in private.masked(private.find(frame)).collect()}
    assert clean[5] is None and clean[4] == "" and clean[1].startswith("card <CARD> not 4111")


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions"
    near, n = item.replace("lazy", "tired").upper(), len(item.split())
    rows = [(0, f"before. {item}, after"), (1, f"x y {near}!"), (2, "some other text of many words that has nothing in common at all"), (3, None), (4, ""), (None, item)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_equal) for r in decontaminate.leaks(frame, items).collect()) == [(0, 7, n), (1, 7, n - 1)]


def test_decontamination_of_parts(spark):
    item = [f"w{i}" for i in range(40)]
    change = lambda w, *at: [f"x{i}" if i in at else x for i, x in enumerate(w)]
    three = [f"t{i}" for i in range(15)]
    cases = {
        0: ["a", "b", *item[10:30], "c"],  # an excerpt
        1: [*item[20:27], "new", *item[27:33]],  # a word put in
        2: [*item[3:9], *item[10:17]],  # a word left out
        3: change(three, 3, 7, 11),  # never four in a row
        4: change(item, 4, 5)[:13],  # adjacent
        5: item[:12],  # too short
        6: change(item[:15], 2, 5, 8, 11),  # 73 %
        7: ["so", "tiny", "one", "item"],
        8: ["five", "other", "of", "a", "kind"],
        9: change(item[:13], 4, 9),
    }
    items = [(1, " ".join(item)), (2, " ".join(three)), (3, "tiny one"), (4, "five words of a kind")]
    got = decontaminate.leaks(spark.createDataFrame([(k, " ".join(w)) for k, w in cases.items()], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.doc_start, r.n_words, r.n_equal) for r in got.collect()) == [(0, 1, 2, 20, 20), (1, 1, 0, 14, 13), (2, 1, 0, 14, 13), (3, 2, 0, 15, 12), (4, 1, 0, 13, 11), (7, 3, 1, 2, 2), (8, 4, 0, 5, 4), (9, 1, 0, 13, 11)]


def test_pieces_equal_the_library_and_round_trip(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    own = ["Hello  world\n\n  aaaaaaa 12 345", " lead", "tail ", "", "日本語 😀 ñandú\t\x00x", "größte Änderung " * 20, "x" * 300, "\n", "a\nb"]
    odd = ["a ▁b▁", "\0\1▁\1", None]
    frame = spark.createDataFrame(list(enumerate(own + odd)), "k long, text string")
    for r in frame.select("*", pieces.encode(F.col("text")).alias("ids")).withColumn("back", pieces.decode(F.col("ids"))).collect():
        assert r.back == r.text
        if r.k < len(own):
            assert r.ids == model.encode(r.text), r.text


def test_common_words_stay_known_and_ids_do_not_change(monkeypatch):
    monkeypatch.setattr(pieces, "MANY", 40)
    coder, learnt = pieces.Coder(pieces.VOCABULARY), []
    learn = coder.learn
    monkeypatch.setattr(coder, "learn", lambda fresh: learnt.extend(fresh) or learn(fresh))
    batches = [[f"the same words \u2581{i}x\0\n {i * 7919}", None, "", " ".join(f"w{i}v{j}" for j in range(30))] for i in range(12)]
    for batch in batches:
        got = coder.encode(batch)
        fresh = pieces.Coder(pieces.VOCABULARY).encode(batch)
        assert [None if x is None else x.tolist() for x in got] == [None if x is None else x.tolist() for x in fresh]
        assert [coder.decode(x) for x in got] == batch
    assert learnt.count("\u2581same") == 1 and len(coder.known) < 120


def test_parts_of_a_batch_bound_the_table_of_words(monkeypatch):
    """What stays after a batch does not grow with it, and ids are those of an unbounded table."""
    batch = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(60)]
    batch[5:5] = [None, "", " ", "w1x1 " * 400]
    want = pieces.Coder(pieces.VOCABULARY).encode(batch)
    monkeypatch.setattr(pieces, "MANY", 100)
    monkeypatch.setattr(pieces, "PART", 500, raising=False)
    coder = pieces.Coder(pieces.VOCABULARY)
    got = coder.encode(batch)
    assert [None if x is None else x.tolist() for x in got] == [None if x is None else x.tolist() for x in want]
    assert len(coder.known) <= 100 and len(coder.encode([])) == 0


def test_pairs_of_pieces_fit_as_merging_says():
    coder = pieces.coder(pieces.VOCABULARY)
    draw = np.random.default_rng(5)
    short = np.array([k for k in range(coder.numbered) if coder.widths[k] <= 3 and coder.learnt[k]])
    of_pieces = coder.pairs[1:][:: len(coder.pairs) // 3000]
    left = np.concatenate([draw.integers(0, coder.numbered, 4000), draw.choice(short, 8000), of_pieces >> 32, draw.permutation(of_pieces >> 32), [len(coder.names) + 5]])
    right = np.concatenate([draw.integers(0, coder.numbered, 4000), draw.choice(short, 8000), *[of_pieces & 0xFFFFFFFF] * 2, [short[0]]])
    both = coder.learnt[np.minimum(left, coder.numbered)] & coder.learnt[np.minimum(right, coder.numbered)]
    left, right = left[both], right[both]
    assert both.mean() > 0.9 and coder.apart(left, right)[-1]
    names = [(coder.names[a], coder.names[b]) for a, b in zip(left[:-1].tolist(), right[:-1].tolist())]
    assert coder.apart(left, right)[:-1].tolist() == [coder.merged(a + b) == [a, b] for a, b in names]


def test_shards_hold_every_row_once(docs):
    more = docs.withColumn("_salt", F.lit("mine")).withColumn("_bucket", F.lit(None).cast("int")).withColumn("_slot", F.lit("gone"))
    frame = shards.shuffled(more, 7, bucket_bytes=2000)
    assert frame.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "_salt", "_bucket", "_size", "_shard", "_slot"]
    got = frame.toPandas()
    assert sorted(map(str, zip(got["doc_id"].fillna(-1).astype(int), got["text"], got["_salt"]))) == sorted(str((-1 if r.doc_id is None else r.doc_id, r.text, "mine")) for r in docs.collect())
    assert [r["_size"] for _, r in got.iterrows()] == [16 + len((t or "").encode()) for t in got["text"]]
    assert got.groupby("_shard")["_slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    counts = got.groupby("_shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 7


def test_shards_of_copies_few_rows_and_none(spark):
    for n in (0, 1, 3, 500):
        same = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
        got = shards.shuffled(same, 4, bucket_bytes=100).toPandas()
        assert len(got) == n and got.groupby("_shard").size().tolist() == [c for c in (n // 4 + (k < n % 4) for k in range(4)) if c]
        assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("_shard")["_slot"])


def test_shards_do_not_depend_on_splits_and_are_written_in_order(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    first = shards.shuffled(table, 5, bucket_bytes=2000)
    want = sorted(first.collect(), key=str)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert sorted(shards.shuffled(table, 5, bucket_bytes=2000).collect(), key=str) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(shards.shuffled(table, 5, seed=2, bucket_bytes=2000).collect(), key=str) != want
    shards.write(first, str(tmp_path / "out"))
    for k in range(5):
        for file in (tmp_path / "out" / f"_shard={k}").glob("*.parquet"):
            slots = [r._slot for r in spark.read.parquet(str(file)).collect()]
            assert slots == sorted(slots)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(first.columns).collect(), key=str) == want


def test_places_are_uniform(spark):
    """Each of 300 rows comes to each tenth of the sequence about as often as the others."""
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    seen = np.zeros((10, 10))
    for seed in range(3):
        for r in shards.shuffled(rows, 10, seed, bucket_bytes=1000).collect():
            seen[r.doc_id // 30, r._shard] += 1
    assert ((seen - 9) ** 2 / 9).sum() < 140  # chi square, 81 degrees


def test_search_equals_brute_force(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(0, 0.3, (150, 8)).round(2)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(200, None, 0), (220, [float("nan")] * 8, 0), (240, [None] + [1.0] * 7, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = np.floor(64 * x.astype(np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, 150, 20):
        order = sorted((-(v[q] @ v[i]), i) for i in range(150) if i != q)[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    assert sorted(map(tuple, topk.search(frame).collect())) == want


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "a<b & [INST] </turn>"), (1, 1, "assistant", "&lt; yes"), (1, 2, "user", None), (1, 3, "assistant", "é"), (2, 0, None, "x"), (1, 4, "user", "end")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.expand(chat.pieces(frame))
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    one = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in sorted((r for r in rows if r[0] == 1), key=lambda r: r[1]))
    assert got[1].n_turns == 5 and got[1].turns_sha256 == hashlib.sha256(one.encode()).hexdigest()
    assert got[1].loss_chars == 9 and got[1].loss_sha256 == hashlib.sha256("&lt; yesé".encode()).hexdigest()
    assert got[2].loss_chars == 0
    full = chat.render(made, chat.examples(made)).collect()
    assert sum(len(r.text) for r in full) == got[1].formatted_chars
    assert sorted(chat.unescape(r.text[r.loss_begin : r.loss_end]) for r in full) == ["&lt; yes", "é"]
    assert sorted((r.conv_id, r.target) for r in full) == [(1, 2), (1, 4)]
    assert all(r.context < r.loss_begin <= r.loss_end for r in full)


def test_chat_query_equals_plain_python(spark, tmp_path):
    """Null and equal turns, null ids, other columns and a long conversation, against the contract's words."""
    from sitegrain.llm import queries

    rows = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "a & b <x> [y]", 1), (2, 0, "user", None, 2), (2, 1, "assistant", None, 2), (3, 0, "assistant", "first", 3), (3, 1, "assistant", "second", 3)]
    rows += [(4, 0, "assistant", "same", 4)] * 3 + [(5, None, "user", "no turn", 5), (5, 0, None, "no role", 5), (None, 0, "user", "q", 6), (None, 1, "assistant", "r\n</turn>\n<turn=user>", 6)]
    rows += [(7, k, "assistant" if k % 2 else "user", f"turn {k} 😀", 7) for k in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at long")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    said = "</s>[INST] ok [/INST]"
    talks = {-1: [("user", said), ("assistant", said)]}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        talks.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.conv_id: r for r in queries.op7_chat(spark, str(tmp_path)).collect()}
    assert got.keys() == talks.keys()
    for conv, talk in talks.items():
        r, loss = got[conv], "".join(t for who, t in talk if who == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(talk), sha("".join(f"{who}\n{t}\n" for who, t in talk)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_article(spark):
    page = "<html><head><title>T</title><script>x</script></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head</h1><p><b>One &amp; two.<br><p>Three  <i>fo</i>ur</p></article><div id=comments>nice</div><footer>&copy; x</footer></body></html>"
    frame = spark.createDataFrame([(1, "https://a.example/1", page), (2, None, None), (3, "https://a.example/1", "")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in article.extract(frame).collect()} == {1: "Head One & two. Three four", 2: "", 3: ""}


def test_article_survives_names(spark):
    text = "<article><p>Body text</p></article>"
    wraps = ['<body class="home has-sidebar no-comments">{}</body>', '<html class="share"><body id="search">{}</body></html>', '<body><form id="form"><div class="sidebar">{}</div></form></body>', '<body><div style="overflow:hidden" aria-hidden="false" data-hidden="x" title="hidden">{}</div></body>', '<body><div class="side-by-side alert_none"><main class="search">{}</main></div></body>']
    drops = ['<div class="ad">no</div>', "<div hidden>no</div>", '<p style="color:red; display: none">no</p>', '<p aria-hidden="true">no</p>', '<section id="comments"><article class="c">no</article></section>', "<footer>no</footer>", "<span hidden>no</span>"]
    rows = [(i, f"https://x{i}.example/", w.format(text)) for i, w in enumerate(wraps)]
    rows += [(10 + i, f"https://y{i}.example/", f"<body><article><p>Body text</p>{d}</article></body>") for i, d in enumerate(drops)]
    got = article.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {r[0]: "Body text" for r in rows}


def test_article_template_by_classes(spark):
    """Few pages, a line that repeats within the article, a line that stands at changing places, copies, a host with one page."""
    own = ["alpha one", "beta two", "gamma three", "delta four"]
    page = lambda i: f"<body><div>Shop bar</div><article><p>Share this story</p><h1>{own[i]}</h1>{'<p>Wandering</p>' * (i % 2)}<h2>sub {own[i]}</h2>{'<p>Wandering</p>' * (i % 2 == 0)}</article><div>Imprint</div></body>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(4)] + [(4, "https://b.example/", page(0)), (5, "https://b.example/copy", page(0))]
    rows += [(6 + i, f"https://c.example/{i}", f"<body><div>Shop bar</div><div>{own[i]}</div><p>Imprint</p></body>") for i in range(3)]
    got = {r.page_id: r.text for r in article.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        both = [own[i], "sub " + own[i]]
        both.insert(1 if i % 2 else 2, "Wandering")
        assert got[i] == " ".join(both)
    assert got[4] == got[5] == "Share this story alpha one sub alpha one Wandering"
    assert [got[6 + i] for i in range(3)] == own[:3]
    assert article.misplaced([5, 1, 2, 3, article._RANKS + 1]) == [5]


def test_language(spark):
    draw = random.Random(2)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["schu", "ber", "ung"]}
    rows = [(i, " ".join("".join(draw.choice(sounds[k]) for _ in range(3)) for _ in range(30)), k) for i in range(120) for k in (("aa", "bb")[i % 2],)]
    rows += [(500, None, "aa"), (501, "12 34", None), (502, "", "bb")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:120])
    assert {got[i].lang_pred for i in (500, 501, 502)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    for frame in (substrings.without_repeats(none), minhash.near_duplicates(none), private.digest(private.find(none)), shards.shuffled(none), language.identify(none), decontaminate.leaks(none, spark.createDataFrame([], "item_id long, text string"))):
        assert frame.count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert article.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.read_back(chat.expand(chat.pieces(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0
