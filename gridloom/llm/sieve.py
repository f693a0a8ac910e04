"""A Bloom filter of bounded size, built by aggregates and tested where rows are read, so that rows it does not know never shuffle.

The filter is cut into blocks of 32,768 bits; a hash marks two bits of one block. It grows with the number of hashes up to MOST bytes and is
broadcast in slices of at most BROADCAST_BYTES each. Beyond MOST it only lets more rows through in vain: it never misses a hash it was given.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = 32_768
#: Filter bits for a hash (1.4 % false alarms), and the largest filter in bytes.
BITS, MOST = 16, 256 << 20


def _marks(h: Column) -> tuple[Column, Column]:
    return h.bitwiseAND(BLOCK - 1).cast("int"), F.shiftrightunsigned(h, 15).bitwiseAND(BLOCK - 1).cast("int")


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit.bitwiseAND(7)) == 1


class Sieve:
    def __init__(self, hashes: DataFrame, count: int, slice_bytes: int = C.BROADCAST_BYTES, most: int = MOST):
        """hashes: a long column h of mixed hashes; count: about how many."""
        blocks = min(max(1, -(-count * BITS // BLOCK)), most // (BLOCK // 8))
        self.blocks = 1 << (blocks - 1).bit_length()
        one, two = _marks(F.col("h"))
        marks = hashes.select(self._block(F.col("h")).alias("block"), F.explode(F.array(one.cast("long"), two.cast("long"))).alias("bit"))
        self.table = C.staged(marks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "sieve")
        per = max(1, slice_bytes // (BLOCK // 8 + 64))  # blocks in a slice
        self.slices = [self.table.filter(F.col("block").between(at, at + per - 1)) for at in range(0, self.blocks, per)] if count else []

    def _block(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 30).bitwiseAND(self.blocks - 1).cast("int")

    def marked(self, rows: DataFrame, h: Column, flag: str = "again") -> DataFrame:
        """rows and a boolean column: false only where the filter does not have h."""
        carried, found = rows.columns, []
        out = rows.withColumns({"sieved": h, "block": self._block(h)})
        for i, part in enumerate(self.slices):
            found.append(F.col(f"bitmap{i}"))
            out = out.join(F.broadcast(part.withColumnRenamed("bitmap", f"bitmap{i}")), "block", "left")
        one, two = _marks(F.col("sieved"))
        bitmap = F.coalesce(*found) if found else F.lit(None).cast("binary")
        return out.select(*carried, F.coalesce(_is_set(bitmap, one) & _is_set(bitmap, two), F.lit(False)).alias(flag))

    def bits(self) -> Bits:
        """The filter for numpy code in tasks; at most MOST bytes."""
        rows = self.table.toArrow()
        table = np.zeros((self.blocks, BLOCK // 8), np.uint8)
        for block, bitmap in zip(rows.column("block").to_pylist(), rows.column("bitmap").to_pylist(), strict=True):
            table[block] = np.frombuffer(bitmap, np.uint8)
        return Bits(table)


class Bits:
    def __init__(self, table: np.ndarray):
        self.flat, self.blocks = table.ravel(), np.uint64(len(table) - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        begin = (h >> np.uint64(30) & self.blocks) << np.uint64(15)
        low = np.uint64(BLOCK - 1)
        return self._set(begin | h & low) & self._set(begin | h >> np.uint64(15) & low)

    def _set(self, bit: np.ndarray) -> np.ndarray:
        return (self.flat[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
