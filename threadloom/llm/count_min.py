"""Count-min sketches: filled within tasks, merged in a tree, handed back to tasks as saturated bytes or as they are.

A sketch has `depth` rows of 2**bits counters, so its size is set by its parameters and not by the data.  A count read
from it is never below the true one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Odd multipliers, one for each row.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Counters that travel together, and sketches that one group of the merge adds up.
PIECE = 1 << 16
FAN = 64


def cells(hashes, row: int, bits: int):
    """The counters of a row that 64-bit hashes fall on."""
    import numpy as np

    return (hashes * np.uint64(MIX[row]) >> np.uint64(64 - bits)).astype(np.int64)


def merged_sketch(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator], bits: int, depth: int, most: int = 255):
    """A sketch of all that `hashes` yields (arrays of uint64) for the batches of df: depth x 2**bits counts.

    Counts above `most` are that, in the smallest unsigned type that holds it.  Every task sends its own sketch once, packed; FAN of them are added at a time, so neither
    a task nor the driver holds more than FAN pieces.  Without rows all counts are zero.
    """
    import numpy as np

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((depth, 1 << bits), np.uint32)
        for batch in batches:
            for found in hashes(batch):
                for row in range(depth):
                    at = cells(found, row, bits)
                    if len(at) > 1 << (bits - 3):
                        counts[row] += np.bincount(at, minlength=1 << bits).astype(np.uint32)
                    else:
                        np.add.at(counts[row], at, np.uint32(1))
        for k, piece in enumerate(counts.reshape(-1, min(PIECE, 1 << bits))):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)])], names=["piece", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(min(PIECE, 1 << bits), np.uint64)
        for packed in group.column("counts"):
            total += np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
        total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({"piece": group.column("piece")[:1], "part": group.column("part")[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = df.mapInArrow(fill, "piece int, counts binary").withColumn("part", F.spark_partition_id())
    for _ in range(max(1, math.ceil(math.log(max(2, df.rdd.getNumPartitions()), FAN)))):
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        parts = parts.groupBy("piece", "part").applyInArrow(add, "piece int, part int, counts binary")
    out = np.zeros((depth << bits) // min(PIECE, 1 << bits) * min(PIECE, 1 << bits), np.min_scalar_type(most)).reshape(-1, min(PIECE, 1 << bits))
    for piece, _, packed in parts.toLocalIterator():
        out[piece] = np.minimum(np.frombuffer(zlib.decompress(bytes(packed)), np.uint32), most)
    return out.reshape(depth, 1 << bits)


def counts_of(sketch, hashes):
    """The least of each hash's counters: at least its true count, up to the sketch's most."""
    import numpy as np

    depth, bits = len(sketch), int(sketch.shape[1]).bit_length() - 1
    out = sketch[0][cells(hashes, 0, bits)]
    for row in range(1, depth):
        out = np.minimum(out, sketch[row][cells(hashes, row, bits)])
    return out
