"""Named binary tags: big-endian, thirteen kinds."""

from __future__ import annotations

import gzip
import struct
import zlib

END, BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, BYTES, STRING, LIST, COMPOUND, INTS, LONGS = range(13)
#: Fixed formats of the scalar kinds.
SCALARS = {BYTE: ">b", SHORT: ">h", INT: ">i", LONG: ">q", FLOAT: ">f", DOUBLE: ">d"}


class BadTag(ValueError):
    """Malformed input."""


def decompress(scheme: int, payload: bytes) -> bytes:
    """1 gzip, 2 zlib, 3 as is; 4 isn't supported."""
    scheme &= 0x7F
    if scheme == 3:
        return payload
    if scheme == 4:
        raise NotImplementedError("lz4 payloads")
    try:
        if scheme == 1:
            return gzip.decompress(payload)
        if scheme == 2:
            return zlib.decompress(payload)
    except (OSError, EOFError, zlib.error) as e:
        raise BadTag(str(e)) from e
    raise BadTag(f"unknown scheme {scheme}")


class Tag:
    """A typed value: compounds hold a dict of name to Tag, lists a list of Tags."""

    __slots__ = ("kind", "value")

    def __init__(self, kind: int, value):
        self.kind, self.value = kind, value

    def plain(self):
        if self.kind == COMPOUND:
            return {k: v.plain() for k, v in self.value.items()}
        return [v.plain() for v in self.value] if self.kind == LIST else self.value


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise BadTag("ends too soon")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def text(self) -> str:
        return self.take(self.number(">H")).decode("utf-8", "replace")

    def body(self, kind: int) -> Tag:
        if kind in SCALARS:
            return Tag(kind, self.number(SCALARS[kind]))
        if kind == BYTES:
            return Tag(kind, self.take(self.number(">i")))
        if kind == STRING:
            return Tag(kind, self.text())
        if kind == LIST:
            inner, n = self.number(">B"), self.number(">i")
            return Tag(kind, [self.body(inner) for _ in range(max(0, n))])
        if kind == COMPOUND:
            out = {}
            while inner := self.number(">B"):
                name = self.text()
                out[name] = self.body(inner)
            return Tag(kind, out)
        if kind in (INTS, LONGS):
            n, (form, width) = self.number(">i"), (("i", 4) if kind == INTS else ("q", 8))
            return Tag(kind, list(struct.unpack(f">{max(0, n)}{form}", self.take(max(0, n) * width))))
        raise BadTag(f"unknown kind {kind}")


def parse(data: bytes) -> Tag:
    """The root compound, its name dropped."""
    r = _Reader(data)
    kind = r.number(">B")
    if kind != COMPOUND:
        raise BadTag("the root is no compound")
    r.text()
    return r.body(kind)


def build(tag: Tag, name: str = "") -> bytes:
    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">H", len(raw)) + raw

    def body(t: Tag) -> bytes:
        if t.kind in SCALARS:
            return struct.pack(SCALARS[t.kind], t.value)
        if t.kind == BYTES:
            return struct.pack(">i", len(t.value)) + t.value
        if t.kind == STRING:
            return text(t.value)
        if t.kind == LIST:
            return struct.pack(">Bi", t.value[0].kind if t.value else END, len(t.value)) + b"".join(map(body, t.value))
        if t.kind == COMPOUND:
            return b"".join(bytes([v.kind]) + text(k) + body(v) for k, v in t.value.items()) + b"\0"
        return struct.pack(f">i{len(t.value)}{'i' if t.kind == INTS else 'q'}", len(t.value), *t.value)

    return bytes([tag.kind]) + text(name) + body(tag)


def first(root: Tag, fits, depth: int):
    """The first value, in document order and down to ``depth`` compounds, that fits(name, tag) gives; else None."""
    for name, tag in root.value.items():
        if (found := fits(name, tag)) is not None:
            return found
        if tag.kind == COMPOUND and depth > 0 and (found := first(tag, fits, depth - 1)) is not None:
            return found
    return None


def _safely(data: bytes, fits, depth: int):
    try:
        return first(parse(data), fits, depth)
    except (BadTag, RecursionError):
        return None


def data_version(data: bytes) -> int | None:
    return _safely(data, lambda n, t: t.value if n == "DataVersion" and t.kind == INT else None, 2)


def last_played(data: bytes) -> int | None:
    return _safely(data, lambda n, t: t.value if n == "LastPlayed" and t.kind == LONG else None, 3)


def version_info(data: bytes) -> tuple[str | None, int | None] | None:
    """(name, id) of the first Version compound or bare DataVersion."""

    def fits(name, tag):
        if name == "Version" and tag.kind == COMPOUND:
            title, number = tag.value.get("Name"), tag.value.get("Id")
            return (title.value if title and title.kind == STRING else None, number.value if number and number.kind == INT else None)
        return (None, tag.value) if name == "DataVersion" and tag.kind == INT else None

    return _safely(data, fits, 3)


def palette(data: bytes) -> list[str]:
    """Distinct names in any list called Palette or palette; nothing if the data is malformed."""
    out: dict[str, None] = {}

    def walk(tag: Tag, name: str) -> None:
        if tag.kind == COMPOUND:
            for k, v in tag.value.items():
                walk(v, k)
        elif tag.kind == LIST:
            for v in tag.value:
                if name in ("Palette", "palette") and v.kind == COMPOUND and "Name" in v.value and v.value["Name"].kind == STRING:
                    out[v.value["Name"].value] = None
                walk(v, "")

    try:
        walk(parse(data), "")
    except (BadTag, RecursionError):
        return []
    return sorted(out)


def unpack_bits(longs: list[int], width: int, count: int, spanning: bool) -> list[int]:
    """``count`` values of ``width`` bits from signed longs; values cross longs only if spanning. Missing ones are 0."""
    mask, out = (1 << width) - 1, []
    words = [x & 0xFFFFFFFFFFFFFFFF for x in longs]
    if spanning:
        whole = sum(w << (64 * i) for i, w in enumerate(words))
        return [(whole >> (i * width)) & mask for i in range(count)]
    per = 64 // width
    for i in range(count):
        out.append((words[i // per] >> (i % per * width)) & mask if i // per < len(words) else 0)
    return out
