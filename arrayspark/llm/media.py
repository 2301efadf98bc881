"""Media columns by signature sniffing: find magic bytes, confirm structure and length, carve.

An Aho-Corasick automaton reads a blob once and reports where any format's magic bytes stand. At each
such place the format's validator walks the structure and returns the length it proves, or nothing. Of
overlapping finds the leftmost stays. A blob that is one confirmed format from its first byte to its
last has that type, whatever was declared; finds elsewhere are embedded media.

A validator that ran to the end of a blob in vain tells the next ones so, so that many false magic
bytes don't each cost a walk to the end (but for gzip, where each costs what it inflates).

Defined results: null counts as an empty blob, which has no media and keeps its declared type;
repeated rows have equal results; a very long blob is one task's, in time and memory proportional to
it; an empty table gives an empty result; columns named in ``carry`` are kept, others ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_batches
from .textblocks import buffers, slices

# ---------------------------------------------------------------- validators: length from the first byte, or None
# ``vain`` belongs to the blob and keeps what is known to lead nowhere


def _wav(b: bytes, at: int, vain: dict) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    spot, seen = at + 12, set()
    while spot + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, spot)
        seen.add(name)
        spot += 8 + n + n % 2
    return end - at if spot >= end and spot - end <= 1 and {b"fmt ", b"data"} <= seen else None


def _bmp(b: bytes, at: int, vain: dict) -> int | None:
    if len(b) < at + 54:
        return None
    size, _, start, header, w, h, planes, depth, method, image = struct.unpack_from("<IIIIiiHHII", b, at + 2)
    if header < 40 or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or method or w <= 0 or h == 0 or start < 54:
        return None
    need = start + (w * depth + 31) // 32 * 4 * abs(h)
    return size if need <= size <= len(b) - at and image in (0, need - start) else None


def _png(b: bytes, at: int, vain: dict) -> int | None:
    spot, first = at + 8, True
    while spot + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, spot)
        if spot + 12 + n > len(b) or (first and name != b"IHDR") or zlib.crc32(b[spot + 4 : spot + 8 + n]) != struct.unpack_from(">I", b, spot + 8 + n)[0]:
            return None
        spot, first = spot + 12 + n, False
        if name == b"IEND":
            return spot - at
    return None


def _gif(b: bytes, at: int, vain: dict) -> int | None:
    ends, walked = vain.setdefault("gif", set()), []  # blocks of a chain without an end
    try:
        flags = b[at + 10]
        spot = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        while b[spot] != 0x3B:
            if b[spot] == 0x21:
                spot += 2
            elif b[spot] == 0x2C:
                flags = b[spot + 9]
                spot += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
            else:
                return None
            while b[spot]:
                if spot in ends:
                    return None
                walked.append(spot)
                spot += b[spot] + 1
            walked.clear()
            spot += 1
        return spot + 1 - at
    except IndexError:
        ends.update(walked)
        return None


def _jpeg(b: bytes, at: int, vain: dict) -> int | None:
    spot = at + 2
    while spot + 4 <= len(b) and b[spot] == 0xFF:
        mark, n = b[spot + 1], int.from_bytes(b[spot + 2 : spot + 4], "big")
        if n < 2:
            return None
        spot += 2 + n
        if mark == 0xDA:
            if spot >= vain.get("jpeg", len(b)):
                return None  # from here on there is no mark
            begin = spot
            while (spot := b.find(b"\xff", spot)) >= 0 and spot + 1 < len(b):
                if b[spot + 1] == 0xD9:
                    return spot + 2 - at
                if b[spot + 1] and not 0xD0 <= b[spot + 1] <= 0xD7:
                    break
                spot += 2
            else:
                vain["jpeg"] = begin
                return None
    return None


def _gzip(b: bytes, at: int, vain: dict) -> int | None:
    unpack = zlib.decompressobj(31)
    try:
        spot = at
        while not unpack.eof and spot < len(b):  # in steps, and what comes out is dropped
            unpack.decompress(b[spot : spot + 65536])
            spot += 65536
    except zlib.error:
        return None
    return min(spot, len(b)) - at - len(unpack.unused_data) if unpack.eof else None


#: Magic bytes, the type they announce, and its validator.
MAGIC = (
    (b"RIFF", "wav", _wav),
    (b"BM", "bmp", _bmp),
    (b"\x89PNG\r\n\x1a\n", "png", _png),
    (b"GIF87a", "gif", _gif),
    (b"GIF89a", "gif", _gif),
    (b"\xff\xd8\xff", "jpeg", _jpeg),
    (b"\x1f\x8b\x08", "gzip", _gzip),
)


def automaton():
    a = ahocorasick.Automaton()
    for magic, kind, check in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic), kind, check))
    a.make_automaton()
    return a


def segments(blob: bytes, auto) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the confirmed media in ``blob``, from the left and without overlap."""
    places = sorted((end + 1 - n, kind, check) for end, (n, kind, check) in auto.iter(blob.decode("latin-1")))
    out, free, vain = [], 0, {}
    for at, kind, check in places:
        if at >= free and (n := check(blob, at, vain)):
            out.append((kind, at, n))
            free = at + n
    return out


def sniff(blobs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(*carry, declared, actual, media: array of (type, at, length)) of ``blobs`` (blob, declared).

    ``actual`` is the type of a blob that is one confirmed medium, else what was declared.
    """
    kind = pa.list_(pa.struct([("type", pa.string()), ("at", pa.int64()), ("length", pa.int64())]))
    item = T.StructType().add("type", "string").add("at", "long").add("length", "long")
    schema = blobs.select(*carry, "declared").schema.add("actual", "string").add("media", T.ArrayType(item))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for batch in slices(batches, "blob"):
            declared = batch.column(len(carry)).to_pylist()
            found = [segments(b.as_py() or b"", auto) for b in batch.column(len(carry) + 1)]
            sizes = [len(b.as_py() or b"") for b in batch.column(len(carry) + 1)]
            actual = [f[0][0] if len(f) == 1 and f[0][1:] == (0, n) else d for f, n, d in zip(found, sizes, declared, strict=True)]
            media = pa.array([[{"type": t, "at": a, "length": n} for t, a, n in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(actual, pa.string()), media], names=[*carry, "declared", "actual", "media"])

    return map_batches(blobs.select(*carry, "declared", "blob"), look, schema)


# ---------------------------------------------------------------- texts as media

WIDTH = 192


def payload_of(text: bytes) -> bytes:
    """``text`` with blanks up to a positive multiple of 192 bytes."""
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


def store(payload: bytes, kind: str) -> bytes:
    """``payload`` as the 8-bit samples of a sound (wav) or a grey picture 192 samples wide (bmp, png)."""
    n = len(payload)
    if kind == "wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    height = n // WIDTH
    if kind == "bmp":
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + n, 0, 1078, 40, WIDTH, -height, 1, 8, 0, n, 2835, 2835, 256, 0) + grey + payload
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # filter 0 in front of each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def read_back(blob: bytes, kind: str) -> bytes:
    """The samples in ``blob``, found from its own headers."""
    if kind == "wav":
        spot = 12
        while blob[spot : spot + 4] != b"data":
            n = struct.unpack_from("<I", blob, spot + 4)[0]
            spot += 8 + n + n % 2
        return blob[spot + 8 : spot + 8 + struct.unpack_from("<I", blob, spot + 4)[0]]
    if kind == "bmp":
        start, (w, h) = struct.unpack_from("<I", blob, 10)[0], struct.unpack_from("<ii", blob, 18)
        rows = np.frombuffer(blob, np.uint8, (w + 3) // 4 * 4 * abs(h), start).reshape(abs(h), -1)[:, :w]
        return (rows if h < 0 else rows[::-1]).tobytes()
    w, h = struct.unpack_from(">II", blob, 16)
    spot, data = 8, []
    while spot < len(blob):
        n, name = struct.unpack_from(">I4s", blob, spot)
        if name == b"IDAT":
            data.append(blob[spot + 8 : spot + 8 + n])
        spot += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, w + 1)[:, 1:].tobytes()


def carve(blobs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(*carry, declared, actual, type, at, length, medium: binary): a row for each confirmed medium in ``blobs``."""
    found = sniff(blobs.select(*carry, "declared", "blob", F.struct("blob").alias("whole")), (*carry, "whole"))
    rows = found.select(*carry, "declared", "actual", "whole", F.explode("media").alias("m"))
    cut = F.expr("substring(whole.blob, cast(m.at + 1 as int), cast(m.length as int))")
    return rows.select(*carry, "declared", "actual", "m.type", "m.at", "m.length", cut.alias("medium"))


def wrapped(medium: bytes) -> bytes:
    """``medium`` amid bytes of another file, with magic bytes that announce nothing before and after it."""
    return b"PART\x00\x01RIFF----BM\x00GIF89a\x00" + medium + b"\x00BMRIFF\x89PNG\r\n\x1a\n" + medium[:20]


def media_digests(docs: DataFrame) -> DataFrame:
    """A row of digests for each text of ``docs`` (doc_id, text), stored as media, sniffed, carved and read back.

    The format follows from the payload's checksum. Half of the media stand alone, under a declared type that is
    wrong and gets corrected; the others are embedded in a larger blob, from which they are carved. What
    is read back is what sniffing finds. No text or blob leaves the task.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for part in slices(batches, "text"):
            buf, off = buffers(part.column(1))
            rows = []
            for i in range(part.num_rows):
                text = buf[off[i] : off[i + 1]].tobytes()
                payload = payload_of(text)
                sum32 = zlib.crc32(payload)
                blob = store(payload, ("wav", "bmp", "png")[sum32 % 3])
                declared = "bin"
                if sum32 // 3 % 2:
                    blob = wrapped(blob)
                else:
                    declared = ("jpg", "wav", "gif")[sum32 % 3]
                found = segments(blob, auto)
                kind, at, n = found[0]
                actual = kind if (at, n) == (0, len(blob)) else declared
                medium = blob[at : at + n]
                back = read_back(medium, kind)
                samples = np.frombuffer(back, np.uint8)
                feature = f"declared={declared};actual={actual};medium={kind};at={at};length={n};of={len(blob)};segments={len(found)};sum={int(samples.sum(dtype=np.int64))};min={samples.min()};max={samples.max()};rows={len(back) // WIDTH}"
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), n, hashlib.sha256(medium).hexdigest(), feature))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(docs.select("doc_id", "text"), digest, schema)
