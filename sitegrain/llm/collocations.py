"""Phrases of words that keep together, from sorted streams of exact counts.

Counting goes by length: a phrase that occurs ``least`` times is made of parts that do, so of each length only those occurrences are
counted whose two parts without the last and without the first word passed a filter of the frequent ones. A filter is a bitmap of 2^25
bits whatever the input; it may let rare phrases through, which are then counted and dropped, but holds back no frequent one. A task counts
a few megabytes of text at a time, by ranks of neighbouring words, before anything is shuffled.

The frequent counts are then laid out twice, as a language model's estimation does on disk: sorted by their words from the first on, and
from the last on. In the first stream the beginnings of a phrase stand right before it, in the second its endings, and after it
what it is extended to; a scan with a stack of open phrases gives all of them without a lookup. Both streams, brought into one order, are
merged in lockstep. A range of a stream that begins within the extensions of a phrase is given that phrase's counts to start with.

Null text: empty. Null lang: ``und``. Counts are exact, products are taken in whole numbers of any size. Rows count as often as they
occur, whatever their id. An empty table, or no frequent phrase: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.llm.words import bitmap, fingerprints, is_set, mix, windows
from sitegrain.session import stage

LONGEST = 5
_BITS = 25
_STEP = 4 << 20
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _cut(raw: bytes, step: int) -> Iterator[bytes]:
    """A text in parts of about ``step`` bytes, cut where pieces end."""
    begin = 0
    while len(raw) - begin > step:
        at = raw.rfind(b".", begin, begin + step)
        if at < 0:
            at = raw.find(b".", begin + step)
        if at < 0:
            break
        yield raw[begin : at + 1]
        begin = at + 1
    yield raw[begin:]


def tokens(batches: Iterator[pa.RecordBatch], step: int = _STEP) -> Iterator[tuple[str, list[bytes]]]:
    """``(lang, words)`` of about ``step`` bytes of text; between pieces stands a ``.``."""
    waiting: dict[str, list] = {}

    def words(parts: list[bytes]) -> list[bytes]:
        return b".".join(parts).replace(b".", b" . ").split()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            for part in _cut(text.lower().translate(_ENDS), step):
                held = waiting.setdefault(lang, [0])
                held.append(part)
                held[0] += len(part) + 1
                if held[0] >= step:
                    yield lang, words(waiting.pop(lang)[1:])
    for lang, held in waiting.items():
        yield lang, words(held[1:])


def _slots(lang: str, values: np.ndarray) -> np.ndarray:
    return mix(values ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))) >> np.uint64(64 - _BITS)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _grams(lang: str, words: list[bytes], sizes: tuple[int, ...], passed: np.ndarray | None) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Phrases of ``sizes`` words and their counts; of those that ``passed``, the filter of one word less than the first size, allows."""
    number = _Numbers({b".": 0})
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    names = list(number)
    if sizes[0] == 1:
        counts = np.bincount(ids, minlength=len(names))
        yield names[1:], counts[1:]
        return
    part = sizes[0] - 1
    inside = ids != 0
    fine = inside[: max(0, len(ids) - part + 1)]
    for k in range(1, part):
        fine = fine & inside[k : len(fine) + k]
    prints = windows(fingerprints(names)[ids], part)
    slots = _slots(lang, prints)
    fine = fine[: len(slots)] & is_set(passed, slots)
    # Equal numbers in ``rank`` are equal words up to the length reached.
    rank = ids
    for size in range(2, sizes[-1] + 1):
        if len(ids) < size:
            return
        if size < sizes[0]:
            rank = np.unique(rank[:-1] * len(names) + ids[size - 1 :], return_inverse=True)[1]
            continue
        whole = fine[:-1] & fine[1:] if size == sizes[0] else whole[:-1] & whole[1:]
        rank = rank[:-1] * len(names) + ids[size - 1 :]
        at = np.flatnonzero(whole)
        _, first, same, counts = np.unique(rank[at], return_index=True, return_inverse=True, return_counts=True)
        yield [b" ".join(words[i : i + size]) for i in at[first].tolist()], counts
        rank = np.zeros(len(rank), np.int64)
        rank[at] = same


def _counted(docs: DataFrame, sizes: tuple[int, ...], passed, least: int) -> DataFrame:
    """``(lang, phrase, f)`` of the frequent phrases of these lengths; with the words, all of a language's words under an empty phrase."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in tokens(batches):
            for phrases, counts in _grams(lang, words, sizes, None if passed is None else passed.value):
                if sizes[0] == 1:
                    phrases, counts = [b"", *phrases], np.concatenate([[counts.sum()], counts])
                for i in range(0, len(phrases), 50_000):
                    some = phrases[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array(counts[i : i + 50_000], pa.int64())], schema=_COUNTS)

    sums = docs.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return stage(sums.filter((F.col("f") >= least) | (F.col("phrase") == "")), f"phrases-{sizes[0]}")


def _filter(frequent: DataFrame, size: int) -> np.ndarray:
    """Bitmap of the phrases of ``size`` words."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_slots(lang, windows(fingerprints(phrase.encode("utf-8", "surrogatepass").split(b" ")), size))[0] for lang, phrase in zip(b["lang"], b["phrase"])]
            yield pd.DataFrame({"slot": np.array(found, np.int64)})

    return bitmap(frequent.filter("phrase != ''").select("lang", "phrase").mapInPandas(number, "slot long"), _BITS)


def frequent_phrases(docs: DataFrame, least: int = 100) -> DataFrame:
    """``(lang, words, f)`` of all phrases of 1 to 5 words that occur ``least`` times, and each language's number of words under no words."""
    rows = docs.select(
        F.coalesce(F.make_valid_utf8(F.col("lang").cast("string")), F.lit("und")).alias("lang"),
        F.coalesce(F.make_valid_utf8(F.col("text").cast("string")), F.lit("")).alias("text"),
    )
    found, passed = [], None
    for sizes in ((1,), (2,), (3,), (4, 5)):
        if found:
            bits = _filter(found[-1], sizes[0] - 1)
            if not bits.any():
                break
            passed = docs.sparkSession.sparkContext.broadcast(bits)
        found.append(_counted(rows, sizes, passed, least))
    every = reduce(DataFrame.unionByName, found)
    return every.select("lang", F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " ")).alias("words"), "f")


_SCANNED = "lang string, words array<string>, f long, beginnings array<long>, covered boolean"


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each phrase, in sorted order, the counts of its beginnings (of no word, one, ...) and whether an extension occurs as often.

    A given phrase, which another range holds, is told only if covered here.
    """
    stack: list[list] = []
    at, out = None, []

    def close() -> None:
        words, f, covered, given = stack.pop()
        if len(words) > 1 and (covered or not given):
            out.append((at[1], list(words), None if given else f, None if given else [x[1] for x in stack], covered))

    for b in batches:
        for part, lang, words, f, given in zip(b["_part"], b["lang"], b["words"], b["f"], b["given"]):
            words = tuple(words)
            if at != (part, lang):
                while stack:
                    close()
                at = (part, lang)
            while stack and words[: len(stack[-1][0])] != stack[-1][0]:
                close()
            if stack and len(stack[-1][0]) == len(words) - 1 and stack[-1][1] == f:
                stack[-1][2] = True
            stack.append([words, f, False, given])
        yield pd.DataFrame(out, columns=["lang", "words", "f", "beginnings", "covered"]).astype({"f": "Int64"})
        out.clear()
    while stack:
        close()
    yield pd.DataFrame(out, columns=["lang", "words", "f", "beginnings", "covered"]).astype({"f": "Int64"})


def _stream(counts: DataFrame, label: str) -> DataFrame:
    """Scans ``(lang, words, f)`` in sorted order, a range a task."""
    laid = counts.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words").withColumn("_part", F.spark_partition_id())
    laid = stage(laid, label)
    first = laid.groupBy("_part").agg(F.min(F.struct("lang", "words")).alias("_first"))  # a row a range
    n = F.size("_first.words")
    begun = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice("_first.words", 1, k)))
    open_ones = first.select("_part", "_first.lang", F.explode(begun).alias("words"))
    given = open_ones.join(laid.select("lang", "words", "f"), ["lang", "words"]).withColumn("given", F.lit(True))
    ranges = laid.withColumn("given", F.lit(False)).unionByName(given)
    return ranges.repartitionByRange("_part").sortWithinPartitions("_part", "lang", "words").mapInPandas(_scanned, _SCANNED)


def _merged(top: int):
    """Lockstep merge of both scans, sorted by phrase: of each phrase its least cut, and of these a task's best of each language."""

    def best(rows: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(rows, ignore_index=True)
        every = every.sort_values(["score", "a", "phrase"], ascending=[False, False, True], kind="stable")
        return every.groupby("lang", sort=False).head(top)

    def cut(words: list[str], a: int, left: list[int], right: list[int]) -> tuple:
        total, n = left[0], len(words)
        cuts = [(1000 * a * total // (left[k] * right[n - k]), k) for k in range(1, n)]
        score, k = min(cuts)
        return " ".join(words), a, left[k], right[n - k], total, score

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        out: list[tuple] = []
        key, held = None, [None, None, None, False]

        def close() -> None:
            if key and not held[3]:
                out.append((key[0], *cut(list(key[1]), *map(lambda x: x if isinstance(x, int) else list(map(int, x)), held[:3]))))

        for b in batches:
            for lang, words, f, beginnings, covered, backward in zip(b["lang"], b["words"], b["f"], b["beginnings"], b["covered"], b["backward"]):
                if key != (lang, tuple(words)):
                    close()
                    key, held = (lang, tuple(words)), [None, None, None, False]
                if beginnings is not None:
                    held[0] = int(f)
                    held[2 if backward else 1] = beginnings
                held[3] |= bool(covered)
            if len(out) > 4 * top:
                kept = [best([*kept, _frame(out)])]
                out.clear()
        close()
        if out or kept:
            yield best([*kept, _frame(out)])

    return merge


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["lang", "phrase", "a", "l", "r", "n", "score"]
    return pd.DataFrame(rows, columns=names).astype(dict.fromkeys(names[2:], "int64"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 5 words by score."""
    counts = stage(frequent_phrases(docs, least), "frequent")

    turned = F.reverse("words")
    forward = _stream(counts, "prefix-order")
    backward = _stream(counts.withColumn("words", turned), "suffix-order").withColumn("words", turned)
    both = forward.withColumn("backward", F.lit(False)).unionByName(backward.withColumn("backward", F.lit(True)))
    merged = both.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    found = merged.mapInPandas(_merged(top), "lang string, phrase string, a long, l long, r long, n long, score long")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # A language's best come from each range; before one task ranks them, 64 tasks leave out what can't be among them.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
