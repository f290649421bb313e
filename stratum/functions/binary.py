"""Arrow functions around the codecs: the only Python in the engine's plans, where bytes must be read or made."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from stratum.codecs import manifest, nbt, raster, region



def arrow(ddl: str):
    """A pandas UDF made when it is first applied: types can be named before there is a session."""

    def wrap(f):
        def apply(*columns):
            return F.pandas_udf(f, ddl)(*columns)

        return apply

    return wrap


CELLS = "array<struct<cx:int,cz:int,timestamp:bigint,compression:smallint,payload:binary,external:boolean>>"


@arrow("binary")
def chunk_hash(compression: pd.Series, payload: pd.Series) -> pd.Series:
    return pd.Series([region.chunk_hash(int(c), p or b"") for c, p in zip(compression, payload, strict=True)])


@arrow(f"struct<cells:{CELLS},error:string>")
def scan_region(data: pd.Series) -> pd.DataFrame:
    names = ("cx", "cz", "timestamp", "compression", "payload", "external")
    rows = [region.scan(bytes(d)) for d in data]
    return pd.DataFrame({"cells": [[dict(zip(names, c, strict=True)) for c in cells] for cells, _ in rows], "error": [e for _, e in rows]})


REFS = "array<struct<cx:int,cz:int,compression:smallint,timestamp:bigint,external:boolean,content_hash:binary>>"


@arrow(f"struct<cells:{REFS},error:string>")
def scan_refs(data: pd.Series) -> pd.DataFrame:
    """Like scan_region, with each cell's hash in place of its payload; null for a payload that lies outside."""

    def one(c):
        cx, cz, when, scheme, payload, outside = c
        return {"cx": cx, "cz": cz, "compression": scheme, "timestamp": when, "external": outside, "content_hash": None if outside else region.chunk_hash(scheme, payload)}

    rows = [region.scan(bytes(d)) for d in data]
    return pd.DataFrame({"cells": [[one(c) for c in cells] for cells, _ in rows], "error": [e for _, e in rows]})


@arrow("binary")
def pack_region(cells: pd.Series) -> pd.Series:
    """From arrays of structs cx, cz, timestamp, compression, payload, packed in the order of (cz, cx)."""
    return pd.Series([region.pack(sorted(((int(c["cx"]), int(c["cz"]), int(c["timestamp"]), int(c["compression"]), bytes(c["payload"])) for c in cs), key=lambda c: (c[1], c[0]))) for cs in cells])


@arrow("binary")
def decompress(compression: pd.Series, payload: pd.Series) -> pd.Series:
    """Null where the payload is malformed or its scheme unknown."""

    def one(c, p):
        try:
            return nbt.decompress(int(c), bytes(p))
        except (nbt.BadTag, NotImplementedError):
            return None

    return pd.Series([one(c, p) for c, p in zip(compression, payload, strict=True)])


@arrow("struct<mc_version:string,data_version:int,last_played_ms:bigint>")
def world_info(data: pd.Series) -> pd.DataFrame:
    rows = []
    for d in data:
        name, number = nbt.version_info(bytes(d)) or (None, None)
        rows.append((name, number, nbt.last_played(bytes(d))))
    return pd.DataFrame({"mc_version": [r[0] for r in rows], "data_version": pd.array([r[1] for r in rows], "Int32"), "last_played_ms": pd.array([r[2] for r in rows], "Int64")})


@arrow("array<string>")
def palette(data: pd.Series) -> pd.Series:
    return pd.Series([nbt.palette(bytes(d)) for d in data])


@arrow("binary")
def build_world_info(name: pd.Series, number: pd.Series, played: pd.Series) -> pd.Series:
    """The tags that world_info reads: for tests and exchange."""

    def one(n, v, p):
        version = nbt.Tag(nbt.COMPOUND, {"Name": nbt.Tag(nbt.STRING, n), "Id": nbt.Tag(nbt.INT, int(v))})
        data = nbt.Tag(nbt.COMPOUND, {"Version": version, "LastPlayed": nbt.Tag(nbt.LONG, int(p))})
        return nbt.build(nbt.Tag(nbt.COMPOUND, {"Data": data}))

    return pd.Series([one(*x) for x in zip(name, number, played, strict=True)])


@arrow("binary")
def encode_manifest(rows: pd.Series) -> pd.Series:
    """From arrays of structs dimension, rx, rz, cx, cz, compression, timestamp, content_hash."""

    def one(cells):
        dims: dict = {}
        for c in sorted(cells, key=lambda c: (c["dimension"], c["rx"], c["rz"], c["cx"], c["cz"])):
            dims.setdefault(c["dimension"], {}).setdefault((int(c["rx"]), int(c["rz"])), []).append((int(c["cx"]), int(c["cz"]), int(c["compression"]), int(c["timestamp"]), bytes(c["content_hash"])))
        return manifest.encode({"timestamp_ms": 0}, {k: [(*at, cs) for at, cs in v.items()] for k, v in dims.items()}, [])

    return pd.Series([one(r) for r in rows])


@arrow("array<struct<dimension:string,rx:int,rz:int,cx:int,cz:int,compression:int,timestamp:bigint,content_hash:binary>>")
def decode_manifest(data: pd.Series) -> pd.Series:
    def one(d):
        _, dims, _ = manifest.decode(bytes(d))
        return [dict(dimension=k, rx=rx, rz=rz, cx=c[0], cz=c[1], compression=c[2], timestamp=c[3], content_hash=c[4]) for k, regions in dims.items() for rx, rz, cells in regions for c in cells]

    return pd.Series([one(d) for d in data])


def render_tile(payload, colours: dict, mode: str = "topdown"):
    """768 bytes of each decompressed cell; null where it can't be read."""

    def run(data: pd.Series) -> pd.Series:
        def one(d):
            try:
                return raster.tile(bytes(d), colours, mode)
            except (nbt.BadTag, KeyError, TypeError, RecursionError):
                return None

        return pd.Series([None if d is None else one(d) for d in data])

    return F.pandas_udf(run, "binary")(payload)
