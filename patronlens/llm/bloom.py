"""Blocked Bloom filters as small tables: 256-bit blocks of four words, one bit set in each word.

A filter has at most ``max_blocks`` rows of five longs (``MAX_BLOCKS`` rows are about 10 MB of data), whatever the
number of keys, so it may always be broadcast; more keys only raise the share of false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import unused

WORDS = 4
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 18


def _position(key: str, word: int) -> str:
    return f"CAST(shiftrightunsigned(xxhash64({key}, 17), {6 * word}) & 63 AS INT)"


def _block(key: str, blocks: int) -> Column:
    return F.expr(f"xxhash64({key}) & {blocks - 1}L")


def blocks_for(n_keys: int, bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS) -> int:
    wanted = max(1, n_keys * bits_per_key / (64 * WORDS))
    return min(max_blocks, 1 << math.ceil(math.log2(wanted)))


def build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block`` and its four words for the keys; ``blocks`` is a power of two."""
    words = [F.bit_or(F.expr(f"shiftleft(1L, {_position(key, i)})")).alias(f"w{i}") for i in range(WORDS)]
    return keys.groupBy(_block(key, blocks).alias("block")).agg(*words)


def probe(rows: DataFrame, key: str, keys: DataFrame, keys_column: str, flag: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``rows`` with a boolean ``flag``: false where ``key`` is surely not among the keys (or null)."""
    blocks = blocks_for(keys.count(), max_blocks=max_blocks)
    block, *words, own = unused(rows, "block", *[f"w{i}" for i in range(WORDS)], "block_of")
    made = build(keys, keys_column, blocks).toDF(block, *words)
    bits = " AND ".join(f"(shiftright({word}, {_position(key, i)}) & 1) = 1" for i, word in enumerate(words))
    probed = rows.withColumn(own, _block(key, blocks)).join(F.broadcast(made), F.col(own) == F.col(block), "left")
    probed = probed.withColumn(flag, F.coalesce(F.expr(f"{key} IS NOT NULL AND {bits}"), F.lit(False)))
    return probed.drop(block, own, *words)
