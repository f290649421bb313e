"""Region files: a grid of 32 x 32 cells, each a record of whole 4 KiB sectors behind two header tables."""

from __future__ import annotations

import hashlib

SECTOR = 4096
EXTERNAL = 0x80


def chunk_hash(compression: int, payload: bytes) -> bytes:
    """16 bytes over the scheme, without its external bit, and the payload; place and time don't count."""
    return hashlib.blake2b(bytes([compression & 0x7F]) + payload, digest_size=16).digest()


def scan(data: bytes) -> tuple[list[tuple[int, int, int, int, bytes, bool]], str | None]:
    """Cells (cx, cz, timestamp, compression, payload, external) in header order, or no cells and an error.

    One bad record makes the whole file unreadable. An empty file has no cells.
    """
    if not data:
        return [], None
    if len(data) < 2 * SECTOR:
        return [], f"truncated header: {len(data)} bytes"
    cells = []
    for slot in range(1024):
        entry = data[4 * slot : 4 * slot + 4]
        where, sectors = int.from_bytes(entry[:3], "big"), entry[3]
        if not where and not sectors:
            continue
        cz, cx = divmod(slot, 32)
        begin = where * SECTOR
        if where < 2:
            return [], f"corrupt header: cell {cx},{cz} overlaps it"
        if begin + 5 > len(data):
            return [], f"truncated: cell {cx},{cz} starts beyond the end"
        size = int.from_bytes(data[begin : begin + 4], "big")
        if size < 1:
            return [], f"bad record: cell {cx},{cz} has no scheme"
        if begin + 4 + size > len(data):
            return [], f"truncated: cell {cx},{cz} runs beyond the end"
        scheme, when = data[begin + 4], int.from_bytes(data[SECTOR + 4 * slot : SECTOR + 4 * slot + 4], "big")
        outside = bool(scheme & EXTERNAL)
        cells.append((cx, cz, when, scheme, b"" if outside else data[begin + 5 : begin + 4 + size], outside))
    return cells, None


def pack(cells) -> bytes:
    """A region file of cells (cx, cz, timestamp, compression, payload), in their order from the third sector on."""
    header, body = bytearray(2 * SECTOR), bytearray()
    for cx, cz, when, scheme, payload in cells:
        if not (0 <= cx < 32 and 0 <= cz < 32):
            raise ValueError(f"cell {cx},{cz} is outside the grid")
        record = (len(payload) + 1).to_bytes(4, "big") + bytes([scheme]) + payload
        sectors = -(-len(record) // SECTOR)
        if sectors > 255:
            raise ValueError(f"cell {cx},{cz} needs {sectors} sectors; 255 fit")
        slot, where = 4 * (cx + 32 * cz), 2 + len(body) // SECTOR
        header[slot : slot + 4] = where.to_bytes(3, "big") + bytes([sectors])
        header[SECTOR + slot : SECTOR + slot + 4] = when.to_bytes(4, "big")
        body += record.ljust(sectors * SECTOR, b"\0")
    return bytes(header + body)
