"""Exact inner-product search with a bit-sliced index.

Rows are dealt into blocks. A block's index holds, for each component, a bitmap for each bit of its rows' values (two's complement). For
a batch of queries the slices of a component's multiples are made by adding shifted slices, and added, by the queries' values,
into the slices of the scores. The top rows are picked from the most significant slice downward; of the rows at the boundary,
equal in all slices, the least ids are taken.

Blocks are searched in rounds, each sixteen times as many as before. A query brings the last of its best rows from the rounds
before: of a block only rows that go before it come out, and a block whose greatest and least components can't reach it is not scored. So a
query has few candidates however many blocks there are, and none is lost.

Vectors that are null or hold null or non-finite components take no part. Vectors meet those of their own length only. Rows that repeat
an id and vector count once; an id with several vectors asks with each and may be found with several scores. Where scores might not fit
into a long, the search is refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.session import stage

ROWS, QUERIES, TOGETHER, STEP = 16_384, 512, 32, 16
_NONE = -(1 << 63)
_BLOCK = "part int, dim int, rows int, ids binary, bits int, slices binary, least binary, most binary"
_ASKED = "dim int, q_ids binary, q binary, beat binary, beat_id binary"


def slices(values: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps of the two's complement bits of each value, least first, as 64-bit words."""
    packed = np.packbits((values[None, :] >> np.arange(bits)[:, None]) & 1 == 1, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x + y, slice by slice; y has no more slices than x and its sign goes on."""
    out, carry = np.empty_like(x), np.zeros_like(x[0])
    for i in range(len(x)):
        b = y[i] if i < len(y) else y[-1]
        half = x[i] ^ b
        out[i] = half ^ carry
        carry = (x[i] & b) | (half & carry)
    return out


class Multiples(dict):
    """Slices of a component times 0, 1, 2, ..., made by shifts and additions as they are asked for."""

    def __init__(self, one: np.ndarray):
        super().__init__({0: np.zeros_like(one[:1]), 1: one})

    def __missing__(self, m: int) -> np.ndarray:
        half = self[m >> 1]
        out = np.concatenate([np.zeros_like(half[:1]), half])  # twice as much
        if m & 1:
            out = add(np.concatenate([out, out[-1:]]), self[1])
        self[m] = out
        return out


def scores(index: np.ndarray, q: np.ndarray, most: np.ndarray, tables: list[Multiples]) -> tuple[np.ndarray, np.ndarray]:
    """Slices of the scores, ``(bit, query, word)``, and what is to be added to each query's: one for each negative component.

    ``most`` is the greatest magnitude of each component in the block; it bounds the slices that sums may need.
    """
    need = [int(x).bit_length() + 1 for x in (np.abs(q) * most + 1).cumsum(axis=1).max(axis=0)]
    total = np.zeros((need[-1], len(q), index.shape[2]), np.uint64)
    half, both, reach = np.empty_like(total[0]), np.empty_like(total[0]), 1
    for c, width in enumerate(need):
        sizes, which = np.unique(np.abs(q[:, c]), return_inverse=True)
        parts = [tables[c][int(m)] for m in sizes]
        deep = max(map(len, parts))
        table = np.stack([np.concatenate([p, np.repeat(p[-1:], deep - len(p), axis=0)]) for p in parts])
        # A negative multiple is its complement and one; the ones are added at the end.
        addend = table[which].transpose(1, 0, 2) ^ np.where(q[:, c] < 0, ~np.uint64(0), np.uint64(0))[None, :, None]
        total[reach:width] = total[reach - 1]  # the sign goes on
        reach, carry = width, np.zeros_like(half)
        for i in range(width):
            a, b = total[i], addend[min(i, deep - 1)]
            np.bitwise_xor(a, b, out=half)
            np.bitwise_and(a, b, out=both)
            np.bitwise_xor(half, carry, out=a)
            np.bitwise_and(half, carry, out=carry)
            np.bitwise_or(carry, both, out=carry)
    return total, (q < 0).sum(axis=1)


def top(scores: np.ndarray, ids: np.ndarray, k: int, live: np.ndarray) -> np.ndarray:
    """Of the ``live`` rows those with the k highest scores, given as slices; the sign slice counts the other way round."""
    sure, need = np.zeros_like(live), min(k, int(np.bitwise_count(live).sum()))
    for level in range(len(scores) - 1, -1, -1):
        ones = live & (~scores[level] if level == len(scores) - 1 else scores[level])
        found = int(np.bitwise_count(ones).sum())
        if found > need:
            live = ones
        else:
            sure, need, live = sure | ones, need - found, live & ~ones
            if not need:
                break
    rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), count=len(ids)))
    edge = rows(live) if need else np.empty(0, int)
    return np.concatenate([rows(sure), edge[np.argsort(ids[edge], kind="stable")[:need]]])


def values(scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The numbers that the slices hold for some rows."""
    bits = (scores.view(np.uint8)[:, rows >> 3] >> (7 - (rows & 7))) & 1
    weight = np.int64(1) << np.arange(len(scores))
    weight[-1] = -weight[-1]
    return weight @ bits.astype(np.int64)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task as blocks, one length of vectors in each."""
    part, held = TaskContext.get().partitionId(), {}

    def block(dim: int, rows: list) -> pd.DataFrame:
        ids, x = np.array([r[0] for r in rows], np.int64), np.stack([r[1] for r in rows])
        bits = max(1, int(np.abs(x).max(initial=0)).bit_length() + 1)
        index = np.stack([slices(x[:, c], bits) for c in range(dim)]) if dim else np.zeros((0, bits, 0), np.uint64)
        row = (part, dim, len(ids), ids.tobytes(), bits, index.tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes())
        return pd.DataFrame([row], columns=["part", "dim", "rows", "ids", "bits", "slices", "least", "most"])

    for b in batches:
        for vec_id, v in zip(b["vec_id"], b["v"]):
            rows = held.setdefault(len(v), [])
            rows.append((vec_id, np.asarray(v, np.int64)))
            if len(rows) == ROWS:
                yield block(len(v), held.pop(len(v)))
    for dim, rows in held.items():
        yield block(dim, rows)


def _askers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, list] = {}

    def block(dim: int, rows: list) -> pd.DataFrame:
        ids, beat, beat_id = (np.array([r[i] for r in rows], np.int64).tobytes() for i in (0, 2, 3))
        return pd.DataFrame([(dim, ids, np.stack([r[1] for r in rows]).tobytes(), beat, beat_id)], columns=["dim", "q_ids", "q", "beat", "beat_id"])

    for b in batches:
        for q_id, v, beat, beat_id in zip(b["query_id"], b["v"], b["beat"], b["beat_id"]):
            rows = held.setdefault(len(v), [])
            rows.append((q_id, np.asarray(v, np.int64), beat, beat_id))
            if len(rows) == QUERIES:
                yield block(len(v), held.pop(len(v)))
    for dim, rows in held.items():
        yield block(dim, rows)


def _search_block(k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids, (least, most) = np.frombuffer(r.ids, np.int64), (np.frombuffer(x, np.int64) for x in (r.least, r.most))
                index = np.frombuffer(r.slices, np.uint64).reshape(r.dim, r.bits, -(-r.rows // 64))
                q_ids, beat, beat_id = (np.frombuffer(x, np.int64) for x in (r.q_ids, r.beat, r.beat_id))
                q = np.frombuffer(r.q, np.int64).reshape(len(q_ids), r.dim)
                may = np.flatnonzero(np.maximum(q * least, q * most).sum(axis=1) >= beat)
                every, out = slices(np.ones(r.rows, np.int64), 1)[0], []
                tables = [Multiples(x) for x in index]
                greatest = np.maximum(np.abs(least), np.abs(most))
                for begin in range(0, len(may), TOGETHER):
                    some = may[begin : begin + TOGETHER]
                    if r.dim:
                        total, more = scores(index, q[some], greatest, tables)
                    else:
                        total, more = np.zeros((1, len(some), len(every)), np.uint64), np.zeros(len(some), np.int64)
                    for j, i in enumerate(some):
                        own = ids == q_ids[i]
                        live = every & ~slices(own.astype(np.int64), 1)[0] if own.any() else every
                        sums = np.ascontiguousarray(total[:, j])
                        rows = top(sums, ids, k, live)
                        got = values(sums, rows) + more[j]
                        better = (got > beat[i]) | (got == beat[i]) & (ids[rows] < beat_id[i])
                        rows, got = rows[better], got[better]
                        out.append(pd.DataFrame({"query_id": np.full(len(rows), q_ids[i]), "vec_id": ids[rows], "score": got}))
                if out:
                    yield pd.concat(out)

    return search


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, its k best other rows."""
    spark = vectors.sparkSession
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = fine.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    fine = fine.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    most, dim = fine.agg(F.max(F.array_max(F.transform("e", lambda x: F.abs(x * scale)))), F.max(F.size("e"))).first()
    if most is not None and most + 1 >= (2.0**62 / max(1, dim)) ** 0.5:
        raise ValueError(f"scores of {dim} components of up to {most:g} might not fit into a long")
    whole = stage(fine.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct(), "vectors")
    # Rows of like signs lie together, so that a block's bounds tell more.
    signs = F.array_join(F.transform(F.slice("v", 1, 16), lambda x: F.when(x < 0, "0").otherwise("1")), "")
    laid = whole.repartitionByRange(max(1, -(-whole.count() // ROWS)), signs, "vec_id", F.xxhash64("v"))
    blocks = stage(laid.mapInPandas(_blocks, _BLOCK), "blocks")
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    queries = stage(whole.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), "queries")
    batches = max(1, -(-queries.count() // QUERIES))

    def within(low: int, high: int):
        """Whether a part is searched in the round of these bounds."""
        return lambda part: F.pmod(F.xxhash64(part), F.lit(1 << 20)).between(low, high - 1)

    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rounds, low = 0, 0
    while STEP**rounds < parts:
        rounds += 1
    for n in range(rounds, -1, -1):
        high = (1 << 20) // STEP**n if STEP**n < 1 << 20 else 1
        in_round = within(low, high)
        mine = blocks.filter(in_round(F.col("part")))
        here = mine.select("part").distinct().count()
        if here:
            last = F.when(F.count("*") >= k, F.min(F.struct("score", (-F.col("vec_id")).alias("less"))))
            asked = queries.join(best.groupBy("query_id").agg(last.alias("last")), "query_id", "left")
            asked = asked.withColumns({"beat": F.coalesce("last.score", F.lit(_NONE)), "beat_id": F.coalesce(-F.col("last.less"), F.lit(0))})
            asked = asked.repartition(batches).mapInPandas(_askers, _ASKED)
            # While blocks are few, each is searched by several tasks.
            shares = max(1, -(-spark.sparkContext.defaultParallelism // here))
            wanted = F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), in_round)
            asked = asked.select("*", F.pmod(F.xxhash64("q_ids"), F.lit(shares)).cast("int").alias("share"), F.explode(wanted).alias("part"))
            shared = mine.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
            keys = ["part", "share"]
            pairs = asked.repartition(here * shares, *keys).join(shared.repartition(here * shares, *keys).hint("shuffle_hash"), [*keys, "dim"])
            found = pairs.mapInPandas(_search_block(k), "query_id long, vec_id long, score long")
            ranked = best.union(found).distinct().withColumn("rank", F.row_number().over(order).cast("int"))
            best = stage(ranked.filter(F.col("rank") <= k).drop("rank"), "best")
        low = high
    return best.withColumn("rank", F.row_number().over(order).cast("int")).select("query_id", "rank", "vec_id", "score")
