"""Pictures of cells and of differences: 16 x 16 tiles, heat maps, and a PNG writer."""

from __future__ import annotations

import html
import json
import struct
import zlib

from stratum.codecs import nbt

SIDE = 16
#: Fixed values.
UNMAPPED, AIR, BACKGROUND = (255, 0, 255), (12, 12, 16), (32, 32, 32)
AIR_NAMES = ("minecraft:air", "minecraft:cave_air", "minecraft:void_air")
KIND_COLOURS = {"added": (80, 200, 120), "removed": (220, 80, 80), "modified": (230, 190, 70)}
#: The base colours of maps, by number.
BASE_COLOURS = (
    (0, 0, 0), (127, 178, 56), (247, 233, 163), (199, 199, 199), (255, 0, 0), (160, 160, 255), (167, 167, 167), (0, 124, 0), (255, 255, 255), (164, 168, 184),
    (151, 109, 77), (112, 112, 112), (64, 64, 255), (143, 119, 72), (255, 252, 245), (216, 127, 51), (178, 76, 216), (102, 153, 216), (229, 229, 51), (127, 204, 25),
    (242, 127, 165), (76, 76, 76), (153, 153, 153), (76, 127, 153), (127, 63, 178), (51, 76, 178), (102, 76, 51), (102, 127, 51), (153, 51, 51), (25, 25, 25),
    (250, 238, 77), (92, 219, 213), (74, 128, 255), (0, 217, 58), (129, 86, 49), (112, 2, 0), (209, 177, 161), (159, 82, 36), (149, 87, 108), (112, 108, 138),
    (186, 133, 36), (103, 117, 53), (160, 77, 78), (57, 41, 35), (135, 107, 98), (87, 92, 92), (122, 73, 88), (76, 62, 92), (76, 50, 35), (76, 82, 42),
    (142, 60, 46), (37, 22, 16), (189, 48, 49), (148, 63, 97), (92, 25, 29), (22, 126, 134), (58, 142, 140), (86, 44, 62), (20, 180, 133), (100, 100, 100),
    (216, 175, 147), (127, 167, 150),
)
SCAN_FROM = {"nether-floor": 80, "nether-roof": 125}
NO_SPANNING, FLAT_ROOT = 2566, 2825  # data versions from which values don't cross longs, and the root is flat


def base_colour(number: int) -> tuple[int, int, int]:
    """The colour of a number of the table; others stand out."""
    return BASE_COLOURS[number] if 0 <= number < len(BASE_COLOURS) else UNMAPPED


def colours_of(numbers: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """Block name to colour, from block name to number; number 0 is air. Names that aren't in it come out as unmapped."""
    return {name: AIR if n == 0 else base_colour(n) for name, n in numbers.items()}


def is_air(name: str) -> bool:
    return name in AIR_NAMES


def png(width: int, height: int, rgb: bytes) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


class _Blocks:
    """Block names of one cell by (x, y, z)."""

    def __init__(self, root: dict):
        self.version = root.get("DataVersion", 0)
        body = root if self.version >= FLAT_ROOT else root.get("Level", root)
        self.low = min(root.get("yPos", 0) * 16, -64) if self.version >= FLAT_ROOT else 0
        self.sections = {}
        for s in body.get("sections", body.get("Sections", [])):
            states = s.get("block_states", {"palette": s.get("Palette", []), "data": s.get("BlockStates")})
            names = [p["Name"] for p in states.get("palette", [])]
            if names:
                width = max(4, (len(names) - 1).bit_length())
                at = nbt.unpack_bits(states["data"], width, 4096, self.version < NO_SPANNING) if len(names) > 1 and states.get("data") else None
                self.sections[s["Y"]] = (names, at)
        longs = body.get("Heightmaps", {}).get("WORLD_SURFACE")
        self.heights = [h + self.low for h in nbt.unpack_bits(longs, 9, 256, self.version < NO_SPANNING)] if longs else None

    def at(self, x: int, y: int, z: int) -> str | None:
        names, index = self.sections.get(y >> 4, ((), None))
        k = index[(y & 15) * 256 + z * SIDE + x] if index else 0
        return names[k] if k < len(names) else None


def tile(data: bytes, colours: dict[str, tuple[int, int, int]], mode: str = "topdown") -> bytes:
    """768 bytes of a decompressed cell seen from above, row by row: the top block, or the first below the mode's height."""
    blocks, out = _Blocks(nbt.parse(data).plain()), bytearray()
    top = max(blocks.sections, default=-5) * 16 + 15
    start = min(SCAN_FROM[mode], top) if mode in SCAN_FROM else top
    use_heights = mode == "topdown" and blocks.heights is not None
    for z in range(SIDE):
        for x in range(SIDE):
            if use_heights:
                y = blocks.heights[z * SIDE + x] - 1
                name = blocks.at(x, y, z) if y >= blocks.low else None
            else:
                seen = (blocks.at(x, y, z) for y in range(start, blocks.low - 1, -1))
                name = next((n for n in seen if n is not None and n not in AIR_NAMES), None)
            out += bytes(AIR if name is None or name in AIR_NAMES else colours.get(name, UNMAPPED))
    return bytes(out)


def png_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, or None."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR" or len(data) < 24:
        return None
    return struct.unpack(">II", data[16:24])


def _bounds(points) -> tuple[int, int, int, int]:
    """Least x and z, width and height, of (x, z, ...); of nothing, one cell."""
    x, z = ([p[k] for p in points] or [0] for k in (0, 1))
    return min(x), min(z), max(x) - min(x) + 1, max(z) - min(z) + 1


def mosaic(tiles: list[tuple[int, int, bytes]], bounds: tuple[int, int, int, int] | None = None) -> bytes:
    """A PNG of tiles (cx, cz, 768 bytes), each at its place in the bounds (default: their own); gaps stay the colour of air."""
    x0, z0, across, down = bounds or _bounds(tiles)
    width = across * SIDE
    image = bytearray(bytes(AIR) * (width * down * SIDE))
    for cx, cz, rgb in tiles:
        for row in range(SIDE):
            at = 3 * (((cz - z0) * SIDE + row) * width + (cx - x0) * SIDE)
            image[at : at + 3 * SIDE] = rgb[3 * SIDE * row : 3 * SIDE * (row + 1)]
    return png(width, down * SIDE, bytes(image))


def heat_map(changes: list[tuple[int, int, str]], scale: int = 8, bounds: tuple[int, int, int, int] | None = None) -> bytes:
    """A PNG of changes (wx, wz, kind), one square of ``scale`` pixels each."""
    x0, z0, across, down = bounds or _bounds(changes)
    width = across * scale
    image = bytearray(bytes(BACKGROUND) * (width * down * scale))
    for wx, wz, kind in changes:
        for row in range(scale):
            at = 3 * (((wz - z0) * scale + row) * width + (wx - x0) * scale)
            image[at : at + 3 * scale] = bytes(KIND_COLOURS[kind]) * scale
    return png(width, down * scale, bytes(image))


#: Draws every dimension's changes on a canvas of its own; the boxes show and hide dimensions.
_DRAW = """
for (const [dim, cells] of Object.entries(changes.features)) {
  const box = document.createElement('label'), tick = document.createElement('input'), canvas = document.createElement('canvas');
  const xs = cells.map(c => c.cx), zs = cells.map(c => c.cz), low = a => a.reduce((m, v) => Math.min(m, v), Infinity), high = a => a.reduce((m, v) => Math.max(m, v), -Infinity);
  const x0 = low(xs), z0 = low(zs), w = high(xs) - x0 + 1, h = high(zs) - z0 + 1, s = Math.max(1, Math.min(16, Math.floor(1000 / Math.max(w, h))));
  tick.type = 'checkbox'; tick.checked = true; tick.onchange = () => canvas.hidden = !tick.checked;
  box.append(tick, ' ' + dim + ' (' + cells.length + ')'); document.body.append(box, canvas);
  canvas.width = w * s; canvas.height = h * s; canvas.title = dim + ' from ' + x0 + ',' + z0;
  const pen = canvas.getContext('2d');
  const draw = () => { for (const c of cells) { pen.fillStyle = colours[c.kind]; pen.fillRect((c.cx - x0) * s, (c.cz - z0) * s, s, s); } };
  if (tiles) { const image = new Image(); image.onload = () => { pen.drawImage(image, 0, 0, w * s, h * s); pen.globalAlpha = 0.6; draw(); }; image.src = tiles.replace('{dimension}', encodeURIComponent(dim)); }
  draw();
}
"""


def map_page(title: str, changes: list[tuple], versions: dict | None = None, errors: int = 0, tiles_url: str | None = None) -> str:
    """An HTML page that draws the changes (dimension, wx, wz, kind[, old hash, new hash]) and holds them as JSON, with their counts."""
    features: dict[str, list] = {}
    for dim, wx, wz, kind, *hashes in sorted(changes, key=lambda c: c[:4]):
        features.setdefault(dim, []).append({"cx": wx, "cz": wz, "kind": kind} | dict(zip(("old", "new"), hashes, strict=False)))
    counts = {k: sum(c[3] == k for c in changes) for k in KIND_COLOURS}
    summary = counts | {"errors": errors, "dimensions": sorted(features)} | ({"versions": versions} if versions else {})
    plain = lambda x: json.dumps(x).replace("<", "\\u003c")
    colours = {k: f"rgb{v}" for k, v in KIND_COLOURS.items()}
    script = f"const changes = {plain({'summary': summary, 'features': features})}, colours = {plain(colours)}, tiles = {plain(tiles_url)};{_DRAW}"
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><pre id=counts>{html.escape(json.dumps(counts))}</pre><script>{script}</script>\n"
