"""Counts of hashes in a fixed number of slots: which ones several rows may share, in tables that don't grow with the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Slots of a table, and slots in a block; a bit for each slot is 16 MB.
SLOTS, BLOCK = 1 << 27, 1 << 19
COUNTS = "block int, counts binary, n int"


def slot_of(hashes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The high bits of 64-bit hashes."""
    return (hashes.view(np.uint64) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def slots_of(hashes: np.ndarray, tables: int = 1) -> list[np.ndarray]:
    """A hash's slot in each table; the second table follows the first, with the hashes mixed anew."""
    found = [slot_of(hashes)]
    if tables == 2:
        mixed = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found.append(SLOTS + slot_of(mixed ^ mixed >> np.uint64(32)))
    return found


class SlotCounter:
    """Counts the slots of a task's rows; settle() gives compressed (slot, count) lists, block by block."""

    def __init__(self, tables: int = 1, most: int = 1 << 21) -> None:
        self.waiting: list[np.ndarray] = []
        self.tables, self.held, self.most = tables, 0, most

    def add(self, hashes: np.ndarray) -> None:
        """The distinct hashes of one row."""
        self.waiting += [np.unique(s).astype(np.uint32) for s in slots_of(hashes, self.tables)]
        self.held += self.tables * len(hashes)

    def full(self) -> bool:
        return self.held >= self.most

    def settle(self) -> pa.RecordBatch:
        slots, n = np.unique(np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32), return_counts=True)
        self.waiting, self.held = [], 0
        slots = slots.astype(np.int64)
        edges = np.searchsorted(slots, np.arange(0, self.tables * SLOTS + 1, BLOCK))
        made = []
        for i in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[i], edges[i + 1]
            both = np.concatenate([np.diff(slots[a:b], prepend=i * BLOCK), n[a:b]]).astype(np.uint32)
            made.append((i, pa.compress(both.tobytes(), "zstd", asbytes=True), int(b - a)))
        kinds = (("block", pa.int32()), ("counts", pa.binary()), ("n", pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


def shared_slots(counted: DataFrame, crowded: int = 0, tables: int = 1, most: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(bits, crowds) from SlotCounter's rows: a bit for every slot that two rows or more hold, and the crowded slots.

    Crowded ones are held by `crowded` rows or more, the `most` most crowded of
    each block, so both tables are bounded. A slot that holds several hashes only
    looks more shared than each of them is.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block."""
        now, whole = None, np.zeros(BLOCK, np.int64)

        def summed() -> pa.RecordBatch:
            many = np.flatnonzero(whole >= crowded) if crowded else np.zeros(0, np.int64)
            many = many[np.argsort(-whole[many], kind="stable")[:most]] + now * BLOCK
            bits = np.packbits(whole > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([bits], pa.binary()), pa.array([many.tolist()], pa.list_(pa.int64()))], names=["block", "bits", "crowded"]
            )

        for batch in batches:
            for i, data, n in zip(*(batch.column(c).to_pylist() for c in ("block", "counts", "n"))):
                if i != now:
                    if now is not None:
                        yield summed()
                    now = i
                    whole[:] = 0
                both = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint32).astype(np.int64)
                whole[np.cumsum(both[:n])] += both[n:]
        if now is not None:
            yield summed()

    bits, crowds = np.zeros(tables * SLOTS // 8, np.uint8), []
    for r in counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, bits binary, crowded array<long>").collect():
        bits[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
        crowds += r.crowded
    return bits, np.array(sorted(crowds), dtype=np.int64)


def held(bits: np.ndarray, hashes: np.ndarray, tables: int = 1) -> np.ndarray:
    """Whether the bits of the hashes' slots are set, in every table."""
    found = [(bits[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool) for s in slots_of(hashes, tables)]
    return found[0] & found[-1]
