import struct
import zlib

from stratum.codecs import nbt, raster


def cell(version=3700, heights=True):
    palette = nbt.Tag(nbt.LIST, [nbt.Tag(nbt.COMPOUND, {"Name": nbt.Tag(nbt.STRING, n)}) for n in ("minecraft:air", "stone", "odd")])
    longs = [0] * 256
    longs[16 * 0] = 0x21  # y 1 of the section: x 0 stone, x 1 odd
    section = nbt.Tag(nbt.COMPOUND, {"Y": nbt.Tag(nbt.BYTE, 0), "block_states": nbt.Tag(nbt.COMPOUND, {"palette": palette, "data": nbt.Tag(nbt.LONGS, longs)})})
    surface = [0] * 37
    surface[0] = 65 | 65 << 9
    root = {"DataVersion": nbt.Tag(nbt.INT, version), "yPos": nbt.Tag(nbt.INT, -4), "sections": nbt.Tag(nbt.LIST, [section])}
    if heights:
        root["Heightmaps"] = nbt.Tag(nbt.COMPOUND, {"WORLD_SURFACE": nbt.Tag(nbt.LONGS, surface)})
    return nbt.build(nbt.Tag(nbt.COMPOUND, root))


def test_tile():
    for heights in (True, False):
        rgb = raster.tile(cell(heights=heights), {"stone": (1, 2, 3)})
        assert len(rgb) == 768 and rgb[:3] == b"\1\2\3" and rgb[3:6] == bytes(raster.UNMAPPED) and rgb[6:9] == bytes(raster.AIR)


def pixels(data):
    width, height = struct.unpack(">II", data[16:24])
    at = data.index(b"IDAT")
    size = struct.unpack(">I", data[at - 4 : at])[0]
    raw = zlib.decompress(data[at + 4 : at + 4 + size])
    return width, height, [raw[(3 * width + 1) * y + 1 : (3 * width + 1) * (y + 1)] for y in range(height)]


def test_pictures():
    w, h, rows = pixels(raster.heat_map([(-1, 0, "added"), (1, 2, "removed")], 2))
    assert (w, h) == (6, 6) and rows[0][:3] == bytes(raster.KIND_COLOURS["added"]) and rows[5][15:] == bytes(raster.KIND_COLOURS["removed"]) and rows[0][6:9] == bytes(raster.BACKGROUND)
    assert pixels(raster.heat_map([], 8))[:2] == (8, 8)
    w, h, rows = pixels(raster.mosaic([(0, 0, b"\1" * 768), (1, 1, b"\2" * 768)]))
    assert (w, h) == (32, 32) and rows[0][0] == 1 and rows[31][95] == 2 and rows[0][95] == 32
    page = raster.map_page("a<b", [("region", 1, 2, "added")])
    assert "a&lt;b" in page and '"added": 1' in page


def test_tiles_of_a_snapshot(spark, tmp_path):
    import os

    from stratum.codecs import region
    from stratum.plans.vault import Vault

    for rel in ("region", "DIM-1/region"):
        os.makedirs(tmp_path / "w" / rel)
        (tmp_path / "w" / rel / "r.0.0.mca").write_bytes(region.pack([(0, 0, 1, 2, zlib.compress(cell())), (1, 0, 1, 2, b"broken")]))
    v = Vault(spark, str(tmp_path / "vault"))
    rows = v.tiles(v.snapshot(str(tmp_path / "w")), {"stone": (1, 2, 3)}).collect()
    assert sorted((r["mode"], r["rgb"] is not None) for r in rows) == sorted((m, ok) for m in ("topdown", "nether-floor", "nether-roof") for ok in (True, False))
