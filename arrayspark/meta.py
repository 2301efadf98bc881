"""What is known of an array besides its cells: element type, shape, chunk and block shape, attributes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from math import prod

import numpy as np

MAX_DIM = 8


class ArrayError(ValueError):
    """An argument that no array operation accepts; ``code`` is a key of ``errors.MESSAGES``."""

    def __init__(self, message: str, code: str = "INVALID_ARGUMENT"):
        super().__init__(message)
        self.code = code

    def __reduce__(self):
        return type(self), (str(self), self.code)


@dataclass(frozen=True)
class DType:
    name: str
    kind: str  # f, i, u or b
    bits: int
    spark: str
    numpy: str

    @property
    def itemsize(self) -> int:
        return max(1, self.bits // 8)

    @property
    def floating(self) -> bool:
        return self.kind == "f"


#: Unsigned types widen one step; a 64-bit one is a decimal.
DTYPES = {
    d.name: d
    for d in (
        DType("f64", "f", 64, "double", "float64"), DType("f32", "f", 32, "float", "float32"),
        DType("i64", "i", 64, "bigint", "int64"), DType("i32", "i", 32, "int", "int32"), DType("i16", "i", 16, "smallint", "int16"), DType("i8", "i", 8, "tinyint", "int8"),
        DType("u64", "u", 64, "decimal(20,0)", "uint64"), DType("u32", "u", 32, "bigint", "uint32"), DType("u16", "u", 16, "int", "uint16"), DType("u8", "u", 8, "smallint", "uint8"),
        DType("bool", "b", 8, "boolean", "bool"),
    )
}


def dtype(name: str | DType) -> DType:
    try:
        return name if isinstance(name, DType) else DTYPES[name]
    except KeyError:
        raise ArrayError(f"no such element type: {name}", "INVALID_DTYPE") from None


def of_numpy(kind: np.dtype) -> DType:
    for d in DTYPES.values():
        if d.numpy == np.dtype(kind).name:
            return d
    raise ArrayError(f"no element type for {kind}", "INVALID_DTYPE")


@dataclass(frozen=True)
class Config:
    """How an array is written: Parquet codec and its level (0: uncompressed; other levels are zstd's), mantissa bits
    that floats keep (0: all), and how many tasks write at once at most (0: as many as the array's bytes ask for)."""

    codec: str = "zstd"
    level: int = 3
    mantissa_bits: int = 0
    max_tasks: int = 0

    def __post_init__(self) -> None:
        if self.codec not in ("zstd", "lz4_raw", "snappy", "gzip", "uncompressed") or not 0 <= self.level <= 22 or self.mantissa_bits < 0 or self.max_tasks < 0:
            raise ArrayError(f"no such configuration: {self}", "INVALID_STORAGE")

    def options(self) -> dict[str, str]:
        """Options of the Parquet writer."""
        if not self.level or self.codec == "uncompressed":
            return {"compression": "uncompressed"}
        return {"compression": self.codec} | ({"parquet.compression.codec.zstd.level": str(self.level)} if self.codec == "zstd" else {})


@dataclass(frozen=True)
class ArrayMeta:
    dtype: DType
    shape: tuple[int, ...]
    chunkshape: tuple[int, ...] | None = None
    blockshape: tuple[int, ...] | None = None
    view: bool = False
    urlpath: str | None = None
    attrs: dict[str, bytes] = field(default_factory=dict, compare=False)
    config: Config | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "dtype", dtype(self.dtype))
        object.__setattr__(self, "shape", tuple(int(n) for n in self.shape))
        if len(self.shape) > MAX_DIM:
            raise ArrayError(f"at most {MAX_DIM} dimensions, not {len(self.shape)}", "INVALID_NDIM")
        if any(n < 0 for n in self.shape):
            raise ArrayError(f"negative length in {self.shape}", "INVALID_SHAPE")
        for name in ("chunkshape", "blockshape"):
            if (s := getattr(self, name)) is not None:
                object.__setattr__(self, name, tuple(int(n) for n in s))
                if len(s) != len(self.shape) or any(n < 1 for n in s):
                    raise ArrayError(f"{name} {s} doesn't fit {self.shape}", "INVALID_CHUNKSHAPE" if name == "chunkshape" else "INVALID_BLOCKSHAPE")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def nbytes(self) -> int:
        return self.size * self.dtype.itemsize

    @property
    def strides(self) -> tuple[int, ...]:
        """Cells between neighbours along each axis, in row-major order."""
        return tuple(prod(self.shape[k + 1 :]) for k in range(self.ndim))

    @property
    def chunks(self) -> tuple[int, ...]:
        """The chunk shape, or one that holds about a million cells at most."""
        if self.chunkshape:
            return self.chunkshape
        from .plans.advice import advise

        return advise(self.dtype, self.shape)[0]

    @property
    def grid(self) -> tuple[int, ...]:
        """Chunks along each axis."""
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True))

    def axis(self, k: int) -> int:
        if not -self.ndim <= k < self.ndim:
            raise ArrayError(f"no axis {k} in {self.ndim} dimensions", "INVALID_AXIS")
        return k % self.ndim

    def same_shape(self, other: ArrayMeta) -> bool:
        return self.dtype == other.dtype and self.shape == other.shape

    def but(self, **changes) -> ArrayMeta:
        """A copy with changes; chunk and block shape go if the shape changes and they aren't given."""
        if "shape" in changes and tuple(changes["shape"]) != self.shape:
            changes = {"chunkshape": None, "blockshape": None} | changes
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps({"dtype": self.dtype.name, "shape": self.shape, "chunkshape": self.chunkshape, "blockshape": self.blockshape, "attrs": {k: v.hex() for k, v in self.attrs.items()}, "config": self.config and asdict(self.config)})

    @classmethod
    def from_json(cls, text: str, urlpath: str | None = None) -> ArrayMeta:
        x = json.loads(text)
        return cls(x["dtype"], tuple(x["shape"]), x["chunkshape"] and tuple(x["chunkshape"]), x["blockshape"] and tuple(x["blockshape"]), urlpath=urlpath, attrs={k: bytes.fromhex(v) for k, v in x["attrs"].items()}, config=Config(**x["config"]) if x.get("config") else None)
