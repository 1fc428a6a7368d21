"""A Merkle manifest of a table, with a proof for each row.

Each row is a leaf. The leaves of a source, ascending by doc_id, are hashed in runs of ``WIDTH``, level by level, up to the source's subroot;
the subroots, ordered by source, likewise up to the root. A proof is the list of steps from a leaf to the root; a step holds what stands
to the left and to the right of the node in its run.

Proofs are found by pointer jumping: a node starts with a pointer to its parent and the one step there. Each self-join of the pointers
doubles the distance and appends the steps of the node pointed to, until all point to the root. Only runs of leaves
and the nodes above take part; a leaf puts the step of its own run before its run's steps.

Nulls: a null source is a source of its own, first; null ids come first in their source. Rows that repeat an id go by their leaf
hash; equal rows take places of their own. A leaf without siblings and a single source need no step. An empty table has no rows and no
root. Other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.session import stage

WIDTH = 16
_TOP = "*"  # stands before sources, which are "" (null) or begin with "+"
_STEPS = "array<struct<left:string,right:string>>"


def digest(*texts: Column | str) -> Column:
    return F.sha2(F.concat(*texts), 256)


def leaf(*values: Column) -> Column:
    """Hash of a row's values: ``-`` for null, else the length in bytes, a colon and the value."""

    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(told, values))


def document_leaf(text: Column | None = None) -> Column:
    return leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars")), F.col("text") if text is None else text)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, start, lambda h, step: digest(step["left"], h, step["right"]))


def siblings(proof: Column) -> Column:
    """All hashes of a proof, from the leaf's level up, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Adds ``at``, the row's place in its ``key``, and ``n``, the rows of the key.

    Rows are laid out by ranges of key, order and, for equal ones, where they come from, so that no key has to fit into
    one task; a range's first place is the number of the key's rows in the ranges before it.
    """
    spread = rows.withColumn("_from", F.monotonically_increasing_id())
    sorted_rows = spread.repartitionByRange("key", *order, "_from").sortWithinPartitions("key", *order, "_from")
    laid = stage(sorted_rows.drop("_from").select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), label)
    ranges = laid.groupBy("key", "_part").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    of_key = Window.partitionBy("key")
    before = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranges.select("key", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(of_key).alias("n"))
    counted = stage(counted, f"{label}-ranges")
    at = F.col("_row") - F.col("_first") + F.col("_before")
    return laid.join(counted, ["key", "_part"]).select(*rows.columns, at.alias("at"), "n")


def _runs(nodes: DataFrame, level: int, label: str) -> DataFrame:
    """Runs of the nodes of the level below, of the keys that still have several: ``(key, n, at, nodes, hash)``."""
    several = nodes.filter(F.col("n") > WIDTH ** (level - 1))
    others = [name for name in nodes.columns if name not in ("key", "n", "at")]
    run = several.groupBy("key", "n", F.floor(F.col("at") / WIDTH).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", *others))).alias("nodes"))
    return stage(run.withColumn("hash", digest(F.array_join("nodes.hash", ""))), f"{label}-{level}")


def _step(hashes: Column, i: Column) -> Column:
    left, right = F.slice(hashes, 1, i), F.slice(hashes, i + 2, WIDTH)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _pointers(runs: DataFrame, level: int, last: bool, node: list[Column], sub: Column) -> DataFrame:
    """A row for each node of the runs: its pointer to the run (null if that is the root) and the step there."""
    run = runs.select("key", "at", F.col("nodes.hash").alias("_hashes"), F.posexplode("nodes").alias("i", "_node"))
    up = [F.lit(None).cast(kind) if last else value for value, kind in ((F.col("key"), "string"), (F.lit(level), "int"), (F.col("at"), "bigint"))]
    return run.select(
        *[value.alias(name) for value, name in zip(node, ("key", "level", "at"))],
        *[value.alias(name) for value, name in zip(up, ("up_key", "up_level", "up_at"))],
        F.array(_step(F.col("_hashes"), F.col("i"))).alias("steps"),
        sub.alias("sub"),
    )


def _jumped(pointers: DataFrame, turn: int) -> DataFrame:
    """All pointers after a self-join: those that had not reached the root go twice as far."""
    # A pointer goes 2 ** turn levels up, or out of its source.
    target = pointers.filter((F.col("level") > 2**turn) | (F.col("key") == _TOP)).select(
        *[F.col(name).alias(f"up_{name}") for name in ("key", "level", "at")],
        *[F.col(name).alias(f"next_{name}") for name in ("up_key", "up_level", "up_at", "steps", "sub")],
    )
    on = ["up_key", "up_level", "up_at"]
    moved = pointers.filter("up_key is not null").join(target, on).select(
        "key", "level", "at",
        *[F.col(f"next_{name}").alias(name) for name in on],
        F.concat("steps", "next_steps").alias("steps"),
        F.coalesce("sub", "next_sub").alias("sub"),
    )
    return stage(pointers.filter("up_key is null").unionByName(moved), f"pointers-{turn}")


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves(doc_id, source, leaf, ...)`` with ``subroot``, ``root`` and ``proof``; other columns are passed on."""
    others = [name for name in leaves.columns if name not in ("doc_id", "source", "leaf")]
    source = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    rows = leaves.select(source.alias("key"), F.col("leaf").alias("hash"), "doc_id", F.struct(*others, F.lit(0).alias("_")).alias("_more"))
    placed = stage(_placed(rows, ["doc_id", "hash"], "leaves"), "places")
    most = placed.agg(F.max("n")).first()[0] or 0
    levels = [_runs(placed, 1, "runs")]
    alone = placed.filter("n = 1").select("key", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("at"), "hash")
    subroots = [alone]
    while True:
        k = len(levels)
        done = levels[-1].filter((F.col("n") <= WIDTH**k)).select("key", F.lit(k).alias("level"), F.col("at").cast("bigint").alias("at"), "hash")
        subroots.append(done)
        if most <= WIDTH**k:
            break
        levels.append(_runs(levels[-1].select("key", "n", "at", "hash"), k + 1, "runs"))

    found = reduce(DataFrame.unionByName, subroots).select(F.lit(_TOP).alias("key"), "hash", F.col("key").alias("of"), F.col("level").alias("of_level"))
    tops = [stage(_placed(found, ["of"], "subroots"), "sources")]
    sources = tops[0].agg(F.max("n")).first()[0] or 0
    while sources > WIDTH ** (len(tops) - 1):
        below = tops[-1] if len(tops) == 1 else tops[-1].select("key", "n", "at", "hash")
        tops.append(_runs(below, len(tops), "tops"))
    last = tops[-1].select("hash").first()
    root = F.lit(last[0] if last else None).cast("string")

    none, top = F.lit(None).cast("string"), len(tops) - 1
    pointers = []
    for k, runs in enumerate(levels[1:], 2):
        # With one source its subroot is the root.
        node = [F.col("key"), F.lit(k - 1), F.col("_node.at").cast("bigint")]
        pointers.append(_pointers(runs, k, top == 0 and k == len(levels), node, none))
    for k, runs in enumerate(tops[1:], 1):
        first = k == 1
        node = [F.col("_node.of") if first else F.lit(_TOP), F.col("_node.of_level") if first else F.lit(k - 1), F.lit(0).cast("bigint") if first else F.col("_node.at").cast("bigint")]
        pointers.append(_pointers(runs, k, k == top, node, F.col("_node.hash") if first else none))
    runs = levels[0].select("key", F.lit(1).alias("level"), F.col("at").cast("bigint").alias("at"), "n", "nodes")
    # Alone, a leaf is its source's subroot and has no run.
    one = F.array(F.struct("at", "hash", "doc_id", "_more"))
    single = placed.filter("n = 1").select("key", F.lit(0).alias("level"), F.col("at").cast("bigint").alias("at"), "n", one.alias("nodes"))
    runs = runs.unionByName(single)
    if pointers:
        reach = stage(reduce(DataFrame.unionByName, pointers), "pointers")
        for turn in range(max(0, len(levels) - 1 + top - 1).bit_length()):
            reach = _jumped(reach, turn)
        runs = runs.join(reach.select("key", "level", "at", "steps", "sub"), ["key", "level", "at"], "left")
    else:
        runs = runs.withColumns({"steps": F.lit(None).cast(_STEPS), "sub": none})
    each = runs.select("n", "sub", F.coalesce("steps", F.array().cast(_STEPS)).alias("steps"), F.col("nodes.hash").alias("_hashes"), F.posexplode("nodes").alias("i", "_node"))
    step = F.when(F.col("n") > 1, F.array(_step(F.col("_hashes"), F.col("i")))).otherwise(F.array().cast(_STEPS))
    return each.select(
        F.col("_node.doc_id").alias("doc_id"),
        F.col("_node.hash").alias("leaf"),
        F.coalesce("sub", root).alias("subroot"),
        root.alias("root"),
        F.concat(step, "steps").alias("proof"),
        *[F.col(f"_node._more.{name}").alias(name) for name in others],
    )
