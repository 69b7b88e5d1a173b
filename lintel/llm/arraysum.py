"""Sums of numpy arrays over tasks, with every group bounded."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lintel.llm.common import shuffles_freed

BLOCK = 4096
SALTS = 64
SCHEMA = "key string, block int, salt int, values binary"


def to_blocks(arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One task's arrays as rows for summed(): float64, cut in blocks, under one salt."""
    salt = TaskContext.get().partitionId() % SALTS  # a task that is repeated must deal the same
    rows = [
        (key, at // BLOCK, salt, np.ascontiguousarray(x.reshape(-1)[at : at + BLOCK], np.float64).tobytes())
        for key, x in arrays.items()
        for at in range(0, x.size, BLOCK)
    ]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "block", "salt", "values"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table.column("values"))
    return pa.table({"key": table.column("key")[:1], "block": table.column("block")[:1], "salt": pa.array([0], pa.int32()), "values": [total.tobytes()]})


def summed(blocks: DataFrame) -> dict[str, np.ndarray]:
    """The sums by key. First per salt, then over salts; the driver gets one array a key."""
    total = blocks.groupBy("key", "block", "salt").applyInArrow(_add, SCHEMA).groupBy("key", "block").applyInArrow(_add, SCHEMA)
    found: dict[str, dict[int, bytes]] = {}
    with shuffles_freed(blocks.sparkSession):
        rows = total.collect()
    for r in rows:
        found.setdefault(r["key"], {})[r["block"]] = bytes(r["values"])
    return {k: np.frombuffer(b"".join(v[i] for i in sorted(v)), np.float64).copy() for k, v in found.items()}
