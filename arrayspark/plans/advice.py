"""Chunk and block shapes from an array's shape and bounds in bytes."""

from __future__ import annotations

from itertools import cycle
from math import prod
from pathlib import Path

from ..meta import ArrayError, DType, dtype

CHUNK_BYTES = (256 << 10, 16 << 20)
BLOCK_BYTES = (1 << 10, 128 << 10)


def _box(lengths: tuple[int, ...], itemsize: int, least: int, most: int) -> tuple[int, ...]:
    """A box of powers of two: halved along one axis after the other until it takes ``most`` bytes.

    Where it then covers nearly a whole axis (nine tenths) it is halved there too, lest a sliver remain.
    """
    box = [1 << n.bit_length() - 1 for n in lengths]
    axes = cycle(range(len(box)))
    while itemsize * prod(box) > most:
        k = next(axes)
        box[k] = max(1, box[k] // 2)
    for k, n in enumerate(lengths):
        if itemsize * prod(box) < max(least, most // 2 + 1):
            break
        if box[k] > 1 and n - box[k] < 0.1 * box[k]:
            box[k] //= 2
    return tuple(box)


def advise(kind: str | DType, shape: tuple[int, ...], min_chunk: int = 0, max_chunk: int = 0, min_block: int = 0, max_block: int = 0) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(chunkshape, blockshape) for ``shape``; a bound of 0 is the default. An axis without cells counts as one."""
    size = dtype(kind).itemsize
    low, high = min_chunk or CHUNK_BYTES[0], max_chunk or CHUNK_BYTES[1]
    if high < size or (max_block and max_block < size):
        raise ArrayError("a chunk and a block must hold a cell", "INVALID_CHUNKSHAPE")
    chunk = _box(tuple(max(1, n) for n in shape), size, low, high)
    return chunk, _box(chunk, size, min_block or BLOCK_BYTES[0], min(max_block or BLOCK_BYTES[1], size * prod(chunk)))


def partitions(nbytes: int, each: int = 128 << 20) -> int:
    """How many partitions hold ``nbytes`` in parts of ``each``."""
    return max(1, -(-nbytes // each))


def ncores(spark, most: int | None = None) -> int:
    """The tasks that run at once, ``most`` at most."""
    n = spark.sparkContext.defaultParallelism
    return min(n, most) if most else n


#: What a core's second-level cache is taken for where the system doesn't tell.
L2_BYTES = 256 << 10


def l2_size(cpu: str = "/sys/devices/system/cpu/cpu0") -> int:
    """Bytes of a core's second-level cache on the driver's machine."""
    for cache in sorted(Path(cpu).glob("cache/index*")):
        try:
            if (cache / "level").read_text().strip() != "2":
                continue
            size = (cache / "size").read_text().strip()
            return int(size.rstrip("KM")) << {"K": 10, "M": 20}.get(size[-1], 0)
        except (OSError, ValueError):
            continue
    return L2_BYTES
