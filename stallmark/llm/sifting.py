"""A bit map of 64-bit keys by which tasks sift rows before a shuffle: a false hit costs time, never changes a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 15  # bits of a piece: 4 KB each


def bits_for(keys: int, each: int, most: int) -> int:
    """Exponent of a map of ``each`` bits a key, at least 16, at most ``most`` (2**most bits are sent to every task)."""
    return int(min(most, max(16, np.ceil(np.log2(max(1, keys * each))))))


def build(keys: DataFrame, bits: int) -> bytes:
    """Map of the highest ``bits`` bits of the column ``key``: pieces are built by tasks, 2**bits / 8 bytes in all."""

    chunk = min(CHUNK, bits)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for piece, at in pdf.groupby("piece")["at"]:
                m = np.zeros(1 << chunk, dtype=np.uint8)
                m[at.to_numpy()] = 1
                out.append((piece, np.packbits(m, bitorder="little").tobytes()))
            yield pd.DataFrame(out, columns=["piece", "bits"])

    top = F.shiftrightunsigned("key", 64 - bits)
    at = keys.select(F.shiftright(top, chunk).cast("int").alias("piece"), top.bitwiseAND(F.lit((1 << chunk) - 1)).cast("int").alias("at")).distinct().repartition("piece")
    whole = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in at.mapInPandas(pieces, "piece int, bits binary").toLocalIterator():
        start = row.piece << (chunk - 3)
        whole[start : start + (1 << (chunk - 3))] |= np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return whole.tobytes()


def held(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which of the (unsigned) keys may be in the map."""
    at = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
