import gzip
import zlib

import pytest

from stratum.codecs import manifest, nbt, region


def test_region_round_trip_and_hash():
    cells = [(0, 0, 5, 2, b"a"), (31, 31, 4_000_000_000, 1, b"b" * 5000), (3, 4, 0, 0x82, b"")]
    got, error = region.scan(region.pack(cells))
    assert error is None and {(c[0], c[1]): c for c in got} == {(c[0], c[1]): (*c, bool(c[3] & 128)) for c in cells}
    assert region.chunk_hash(0x82, b"x") == region.chunk_hash(2, b"x") != region.chunk_hash(3, b"x")
    with pytest.raises(ValueError):
        region.pack([(32, 0, 0, 2, b"")])
    with pytest.raises(ValueError):
        region.pack([(0, 0, 0, 2, b"x" * 255 * 4096)])


@pytest.mark.parametrize("entry, word", [(b"\0\0\1\1", "overlaps"), (b"\0\1\0\1", "beyond the end"), (b"\0\0\2\1", "no scheme")])
def test_region_corruption(entry, word):
    data = bytearray(3 * 4096)
    data[:4] = entry
    cells, error = region.scan(bytes(data))
    assert cells == [] and word in error


def test_region_edges():
    assert region.scan(b"") == ([], None)
    assert "truncated" in region.scan(b"x" * 100)[1]
    data = bytearray(region.pack([(0, 0, 0, 2, b"abc"), (1, 0, 0, 2, b"d")]))
    data[2 * 4096 : 2 * 4096 + 4] = (99999).to_bytes(4, "big")
    assert region.scan(bytes(data))[0] == []


def test_tags():
    inner = nbt.Tag(nbt.COMPOUND, {"DataVersion": nbt.Tag(nbt.INT, 7)})
    tree = nbt.Tag(nbt.COMPOUND, {"a": inner, "DataVersion": nbt.Tag(nbt.INT, 9), "l": nbt.Tag(nbt.LIST, [nbt.Tag(nbt.LONG, -1)]), "d": nbt.Tag(nbt.DOUBLE, 0.5), "n": nbt.Tag(nbt.LONGS, [1, -2]), "b": nbt.Tag(nbt.BYTES, b"xy")})
    data = nbt.build(tree)
    assert nbt.parse(data).plain() == tree.plain()
    assert nbt.data_version(data) == 7  # document order
    assert nbt.data_version(data[:-3]) is None and nbt.last_played(data) is None
    names = nbt.Tag(nbt.LIST, [nbt.Tag(nbt.COMPOUND, {"Name": nbt.Tag(nbt.STRING, n)}) for n in ("stone", "dirt", "stone")])
    assert nbt.palette(nbt.build(nbt.Tag(nbt.COMPOUND, {"s": nbt.Tag(nbt.COMPOUND, {"palette": names})}))) == ["dirt", "stone"]
    assert nbt.decompress(1, gzip.compress(b"q")) == nbt.decompress(2, zlib.compress(b"q")) == nbt.decompress(3, b"q")
    with pytest.raises(NotImplementedError):
        nbt.decompress(4, b"")
    with pytest.raises(nbt.BadTag):
        nbt.decompress(9, b"")
    assert nbt.unpack_bits([0b0010_0001], 4, 3, False) == [1, 2, 0]
    assert nbt.unpack_bits([-1, 1], 9, 8, True)[7] == 0b11


def test_manifest_round_trip():
    header = {"timestamp_ms": 12, "label": None, "world_name": "w", "mc_version": "1.20", "data_version": 3, "last_played_ms": None, "original_timestamp_ms": 4}
    dims = {"region": [(0, 0, [(5, 7, 0x82, 9, b"h" * 16)]), (-1, 2, [(31, 31, 2, 1, b"i" * 16)])], "DIM-1/region": [(0, 0, [])]}
    data = manifest.encode(header, dims, [("level.dat", b"s" * 32)])
    assert manifest.decode(data) == (header, dims, [("level.dat", b"s" * 32)])
    for bad in (b"XXXX" + data[4:], data[:4] + b"\7" + data[5:], data[:-1], data[:9] + b"z" * (len(data) - 9)):
        with pytest.raises(manifest.BadManifest):
            manifest.decode(bad)
