"""Row-major bytes and self-contained frames, for arrays that fit the driver."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..array import NDArray
from ..meta import ArrayError, ArrayMeta, DType, dtype

_MAGIC = b"ARSP\x01"


def from_buffer(spark: SparkSession, buffer: bytes, kind: str | DType, shape: Sequence[int], **storage) -> NDArray:
    """An array of the first cells of ``buffer``."""
    meta = ArrayMeta(dtype(kind), tuple(shape), **storage)
    if len(buffer) < meta.nbytes:
        raise ArrayError(f"{len(buffer)} bytes are too few for {meta.nbytes}")
    cells = np.frombuffer(buffer, meta.dtype.numpy, meta.size)
    if meta.size == 0:
        df = spark.createDataFrame([], f"flat long, v {meta.dtype.spark}")
    elif meta.dtype.name == "u64":
        df = spark.createDataFrame(pd.DataFrame({"flat": np.arange(meta.size), "s": [str(x) for x in cells]})).select("flat", F.col("s").cast(meta.dtype.spark).alias("v"))
    else:
        wide = cells.astype({"u32": "int64", "u16": "int32", "u8": "int16"}.get(meta.dtype.name, meta.dtype.numpy))
        df = spark.createDataFrame(pa.table({"flat": np.arange(meta.size), "v": wide})).select("flat", F.col("v").cast(meta.dtype.spark).alias("v"))
    flat = F.col("flat")
    coords = [(F.expr(f"flat div {s}L") if s != 1 else flat) % F.lit(n) for s, n in zip(meta.strides, meta.shape, strict=True)]
    return NDArray(df, tuple(coords), F.col("v"), meta)


def to_buffer(a: NDArray, buflen: int | None = None) -> bytes:
    if buflen is not None and buflen < a.meta.nbytes:
        raise ArrayError(f"{buflen} bytes are too few for {a.meta.nbytes}")
    return a.to_numpy().tobytes()


def to_cframe(a: NDArray) -> bytes:
    """One block of bytes with everything: a header of JSON and the cells as an Arrow stream."""
    body = io.BytesIO()
    table = pa.table({"v": a.to_numpy().ravel()})
    with pa.ipc.new_stream(body, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    head = a.meta.to_json().encode()
    return _MAGIC + struct.pack("<I", len(head)) + head + body.getvalue()


def from_cframe(spark: SparkSession, frame: bytes) -> NDArray:
    if frame[:5] != _MAGIC:
        raise ArrayError("this isn't a frame")
    (n,) = struct.unpack_from("<I", frame, 5)
    try:
        meta = ArrayMeta.from_json(frame[9 : 9 + n].decode())
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ArrayError("the frame's header is damaged") from e
    cells = pa.ipc.open_stream(frame[9 + n :]).read_all().column("v").to_numpy()
    out = from_buffer(spark, np.ascontiguousarray(cells.astype(meta.dtype.numpy)).tobytes(), meta.dtype, meta.shape)
    return NDArray(out.origin, out.coords, out.value, meta)
