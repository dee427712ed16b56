"""Blocked Bloom filter: each key sets eight bits in one block of eight 32-bit words; built by a grouped bit_or."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)  # fixed values: odd multipliers of the split-block filter in the Parquet format
#: 32 bytes a block: the filter that is broadcast never exceeds 16 MB; beyond about 13 million keys more false hits pass.
MAX_BLOCKS = 1 << 19
KEYS_PER_BLOCK = 16


def key_hash(column: Column | str) -> Column:
    return F.xxhash64(column)


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(blocks - 1))


def build(keys: DataFrame, column: str) -> np.ndarray:
    """Words of the filter (blocks x 8) for the hashes of column; at most MAX_BLOCKS rows reach the driver."""
    n = keys.count()
    blocks = 1
    while blocks * KEYS_PER_BLOCK < n and blocks < MAX_BLOCKS:
        blocks *= 2
    h = key_hash(column)
    # The low half times a 32-bit number, modulo 2**32, in two parts that don't overflow a long.
    product = "((h & 65535L) * {0}L + (((shiftrightunsigned(h, 16) & 65535L) * {0}L & 65535L) << 16)) & 4294967295L"
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({product.format(int(s))}, 27) as int))") for s in _SALTS]
    rows = keys.select(h.alias("h")).select(_block(F.col("h"), blocks).alias("block"), *(b.alias(f"w{k}") for k, b in enumerate(bits))).groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8))).toPandas()
    out = np.zeros((blocks, 8), np.uint32)
    if len(rows):
        out[rows["block"].to_numpy()] = rows[[f"w{k}" for k in range(8)]].to_numpy().astype(np.int64).astype(np.uint32)
    return out


def probe(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (int64, by key_hash) may be among the keys."""
    h = hashes.astype(np.int64).view(np.uint64)
    block = (h >> np.uint64(32)).astype(np.int64) & (len(words) - 1)
    low = h.astype(np.uint32)
    ok = np.ones(len(h), bool)
    for k in range(8):
        ok &= (words[block, k] >> (low * _SALTS[k] >> np.uint32(27))) & 1 == 1
    return ok
