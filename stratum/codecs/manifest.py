"""The binary manifest of a snapshot, for exchange; the engine's own tables are Parquet."""

from __future__ import annotations

import struct
import zlib

MAGIC = b"MCBK"


class BadManifest(ValueError):
    """Malformed input."""


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _text(s: str) -> bytes:
    raw = s.encode()
    return _varint(len(raw)) + raw


def encode(header: dict, dimensions: dict, files: list) -> bytes:
    """header: timestamp_ms, label, world_name, mc_version, data_version, last_played_ms, original_timestamp_ms.

    dimensions: key -> regions (rx, rz, cells (cx, cz, compression, timestamp, hash of 16 bytes)); files: (path, sha256).
    """
    body = bytearray(struct.pack(">Q", header["timestamp_ms"]))
    for k in ("label", "world_name", "mc_version"):
        body += _text(header.get(k) or "")
    body += struct.pack(">i", header.get("data_version") or 0) + _varint(len(dimensions))
    for key in sorted(dimensions):
        body += _text(key) + _varint(len(dimensions[key]))
        for rx, rz, cells in dimensions[key]:
            body += struct.pack(">iiH", rx, rz, len(cells))
            for cx, cz, scheme, when, digest in cells:
                if not (0 <= cx < 32 and 0 <= cz < 32) or len(digest) != 16:
                    raise BadManifest(f"bad cell {cx},{cz}")
                body += struct.pack(">BBBi", cx, cz, scheme, when) + digest
    body += _varint(len(files))
    for path, sha in files:
        if len(sha) != 32:
            raise BadManifest(f"bad hash of {path}")
        body += _text(path) + sha
    body += struct.pack(">QQ", header.get("last_played_ms") or 0, header.get("original_timestamp_ms") or 0)
    packed = zlib.compress(bytes(body), 6)
    return MAGIC + struct.pack(">BI", 2, len(packed)) + packed


def decode(data: bytes) -> tuple[dict, dict, list]:
    """What encode was given; 0 and "" come back as None where they mean unknown."""
    if data[:4] != MAGIC or len(data) < 9:
        raise BadManifest("no manifest")
    version, size = struct.unpack(">BI", data[4:9])
    if version not in (1, 2):
        raise BadManifest(f"version {version}")
    if len(data) != 9 + size:
        raise BadManifest("wrong length")
    try:
        body = zlib.decompress(data[9:])
    except zlib.error as e:
        raise BadManifest(str(e)) from e
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(body):
            raise BadManifest("ends too soon")
        at += n
        return body[at - n : at]

    def number() -> int:
        out = shift = 0
        while True:
            b = take(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7
            if shift > 63:
                raise BadManifest("number too long")

    def text() -> str:
        return take(number()).decode("utf-8", "replace")

    header: dict = {"timestamp_ms": struct.unpack(">Q", take(8))[0], "label": text() or None, "world_name": text(), "mc_version": text() or None}
    header["data_version"] = struct.unpack(">i", take(4))[0] or None
    dimensions: dict = {}
    for _ in range(number()):
        regions = dimensions.setdefault(text(), [])
        for _ in range(number()):
            rx, rz, n = struct.unpack(">iiH", take(10))
            cells = []
            for _ in range(n):
                cells.append((*struct.unpack(">BBBi", take(7)), take(16)))
            regions.append((rx, rz, cells))
    files = [(text(), take(32)) for _ in range(number())]
    played, original = struct.unpack(">QQ", take(16)) if version == 2 and at < len(body) else (0, 0)
    return header | {"last_played_ms": played or None, "original_timestamp_ms": original or None}, dimensions, files
