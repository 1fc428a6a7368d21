"""Words of a text and fingerprints of word sequences, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Fingerprints(dict):
    """64-bit fingerprint of each word met by this worker; emptied when full, so that it stays small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value = value - (1 << 64) if value >> 63 else value
        return value


_fingerprints = _Fingerprints()


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and the controls 9 to 13, as UTF-8; ``bytes.split`` cuts at just these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def fingerprints(tokens: list[bytes]) -> np.ndarray:
    """One 64-bit number a word."""
    return np.fromiter(map(_fingerprints.__getitem__, tokens), np.int64, len(tokens)).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` consecutive words; empty if there are fewer words.

    Runs of twice the length are joined from two shorter ones, so a run of 50 takes seven steps, not 50.
    """
    if len(values) < size:
        return np.empty(0, np.uint64)
    done, total, part, width, power = None, 0, values, 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                if done is None:
                    done = part
                else:
                    n = len(values) - total - width + 1
                    done = done[:n] * power + part[total : total + n]
                total += width
            if width * 2 > size:
                return mix(done + np.uint64(size))
            n = len(part) - width
            part = part[:n] * power + part[width : width + n]
            width *= 2
            power = power * power


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of 2^``bits`` bits of the numbers in the column ``slot``, by bytes: parts of 4 kB reach the driver, 2^(bits - 15) at most."""
    one = slots.select((F.col("slot") + 1).alias("slot"))  # Spark counts positions from one
    parts = one.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.collect():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def is_set(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = slots.astype(np.uint64)
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1
