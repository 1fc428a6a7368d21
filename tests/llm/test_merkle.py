"""The manifest against a plain recomputation."""

import hashlib
import zlib

import pytest

from sitegrain.llm import merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, key string, at long"


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, lower=False):
    doc_id, text, lang, source, n_chars = row[:5]
    if lower and text is not None:
        text = "".join(c.lower() if c.isascii() else c for c in text)
    return sha(*map(told, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The last hash, and for each node its steps as (left, right) lists."""
    steps, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(own):
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            steps[i].append((run[: at % 16], run[at % 16 + 1 :]))
            own[i] = at // 16
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = [], []
    for source in order:
        mine = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        by[source] = mine
        sub, steps = climb([leaf_of(r) for r in mine])
        subs.append(sub)
        inner.append(steps)
    root, outer = climb(subs)
    out = []
    for s, source in enumerate(order):
        for row, steps in zip(by[source], inner[s]):
            proof = [*steps, *outer[s]]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            h = leaf_of(row, tampered)
            for left, right in proof:
                h = sha(*left, h, *right)
            flat = [x for left, right in proof for x in left + right]
            out.append((row[0], leaf_of(row), subs[s], root, sha(*flat), h, h == root))
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_merkle(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=repr)


def rows_of(sources):
    out = []
    for source, n in sources:
        out += [(len(out) + 7 * i, f"Text É {i} of {source}" if i % 9 else None, "en" if i % 4 else None, source, i if i % 5 else None, "x", "y", 1) for i in range(n)]
    return out


@pytest.mark.parametrize(
    "sources",
    [
        [("a", 1)],
        [("a", 16)],
        [("a", 17)],
        [("a", 300)],
        [("b", 1), (None, 3)],
        [("hot", 400), ("é", 17), ("", 2), (None, 33), ("Z", 1)],
        [(f"s{i}", 1 + i % 3) for i in range(40)] + [("hot", 280)],
    ],
)
def test_manifest_equals_plain_recomputation(spark, tmp_path, sources):
    rows = rows_of(sources)
    assert run(spark, tmp_path, rows) == sorted(brute(rows), key=repr)


def test_null_and_repeated_ids_and_rows(spark, tmp_path):
    rows = [(None, f"t{i}", None, "s", None, None, None, None) for i in range(20)]
    rows += [(5, "Same", "en", "s", 4, None, None, None)] * 18 + [(5, "other", "en", "s", 4, None, None, None)]
    rows += [(6, "", "", "s", 0, None, None, None), (7, "Long " * 50_000, "en", "s", 0, None, None, None)]
    assert run(spark, tmp_path, rows) == sorted(brute(rows), key=repr)


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_proofs_fold_to_the_root_and_other_columns_stay(spark):
    docs = spark.createDataFrame(rows_of([("a", 40), ("b", 3)]), DOCS)
    leaves = docs.select("doc_id", "source", merkle.document_leaf().alias("leaf"), "lang", "at")
    found = merkle.manifest(leaves)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof", "lang", "at"]
    assert found.filter(merkle.fold(found.leaf, found.proof) == found.root).count() == 43
    assert found.filter("at = 1").count() == 43
