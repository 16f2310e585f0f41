"""Usable vectors in unit length, as packed 32-bit components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64


def unit_vectors(df: DataFrame, key: str, vector: str, model: Column | None = None, dim: int = DIM) -> DataFrame:
    """``id, model, unit`` of the usable vectors: ``dim`` finite components that aren't all zero.

    Vectors that are null, of another length, all zero, or hold null, NaN or
    infinity are left out, and so are rows without a key or with a null model.
    """

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(2)), -1).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(lengths == dim))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ok = np.isfinite(x).all(1)
            top = np.abs(np.where(np.isfinite(x), x, 0)).max(1) if len(x) else np.zeros(0)
            ok &= top > 0
            x = x[ok] / top[ok, None]
            x /= np.sqrt((x * x).sum(1))[:, None]
            data = x.astype(np.float32).tobytes()
            units = [data[i : i + 4 * dim] for i in range(0, len(data), 4 * dim)]
            batch = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], names=["id", "model", "unit"])

    rows = df.select(F.col(key).cast("bigint").alias("id"), (F.lit("") if model is None else model.cast("string")).alias("model"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("id is not null and model is not null and v is not null").mapInArrow(scaled, "id bigint, model string, unit binary")


def matrix(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """The vectors of a packed column as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)
