"""A fixed-size table of hash counts, whose size does not grow with the data.

It tells hashes that no other row can share. Hashes of one residue share a count, so rows it does not tell apart, copies or
not, are compared by the exact step that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, BLOCK = 22, 12


def counts_of(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """How often each residue of a LONG column occurs, at most 255: a byte per residue, 4 MB by default.

    Residues are counted in the JVM and packed into blocks of bytes, so the driver gets at most 2**(bits - 12) rows.
    """
    col = F.col(hashes.columns[0])
    counted = hashes.where(col.isNotNull()).groupBy(col.bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("at")).agg(F.least(F.count("*"), F.lit(255)).cast("int").alias("n"))
    blocks = counted.groupBy(F.shiftright("at", BLOCK).alias("block")).agg(F.collect_list(F.col("at").bitwiseAND(F.lit((1 << BLOCK) - 1))).alias("at"), F.collect_list("n").alias("n"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for block, at, n in zip(b["block"], b["at"], b["n"]):
                x = np.zeros(1 << BLOCK, np.uint8)
                x[np.asarray(at)] = np.asarray(n)
                rows.append((block, x.tobytes()))
            yield pd.DataFrame(rows, columns=["block", "bytes"])

    out = np.zeros((1 << (bits - BLOCK), 1 << BLOCK), np.uint8)
    for r in blocks.mapInPandas(pack, "block int, bytes binary").collect():
        out[r["block"]] = np.frombuffer(r["bytes"], np.uint8)
    return out.ravel()
