"""Names, paths, coordinates and labels as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File patterns that a snapshot leaves out unless told otherwise.
DEFAULT_EXCLUDES = ("session.lock", "logs/**", "crash-reports/**", "*.log", "usercache.json")
#: Archive suffixes.
ARCHIVE_SUFFIXES = (".zip", ".tar", ".tar.gz", ".tar.bz2", ".tar.xz", ".tgz", ".tbz2", ".txz")
#: How names carry times and region coordinates, and what labels may hold.
TIMESTAMP_FORMAT = "yyyy-MM-dd-HH-mm-ss"
TIMESTAMP_PATTERN = r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})"
LABEL_PATTERN = r"[^A-Za-z0-9._-]+"
REGION_PATTERN = r"(?:^|/)r\.(-?\d+)\.(-?\d+)\.mc[ar]$"


def world_coord(region: Column, local: Column) -> Column:
    return region * 32 + local


def region_coord(world: Column) -> Column:
    """Floor division by 32, below zero too."""
    return F.shiftright(world, 5)


def local_coord(world: Column) -> Column:
    return world.bitwiseAND(F.lit(31))


def masked_compression(scheme: Column) -> Column:
    """The scheme without the bit that says the payload is elsewhere."""
    return scheme.bitwiseAND(F.lit(127))


def glob_regex(pattern: str) -> str:
    """A whole-string regex for a shell pattern: * and ? cross slashes, [!x] negates."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))
            if end < 0:
                out.append(r"\[")
            else:
                inner = pattern[i:end].replace("\\", "\\\\")
                out.append("[^" + inner[1:] + "]" if inner[0] == "!" else "[" + inner.replace("^", r"\^") + "]")
                i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def matches_any(path: Column, patterns) -> Column:
    """X/** is X and all below it from the root; a pattern with a slash meets the whole path; others the last part."""
    hit = F.lit(False)
    for p in patterns:
        if p.endswith("/**"):
            hit |= (path == p[:-3]) | path.startswith(p[:-3] + "/")
        else:
            hit |= (path if "/" in p else F.substring_index(path, "/", -1)).rlike(glob_regex(p))
    return hit


def under_any(path: Column, roots) -> Column:
    """The path is one of the roots (strings or columns), or below one."""
    hit = F.lit(False)
    for r in roots:
        below = F.concat(F.rtrim(r, F.lit("/")), F.lit("/")) if isinstance(r, Column) else r.rstrip("/") + "/"
        hit |= (path == r) | path.startswith(below)
    return hit


def prefix_suffix(path: Column, prefix: str = "", suffix: str = "") -> Column:
    return path.startswith(prefix) & path.endswith(suffix)


def known_and_different(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (a != b)


def timestamp_of_name(name: Column) -> Column:
    """Milliseconds since the epoch of the first time stamp in a name; null if there is none or it is no date."""
    return F.unix_millis(F.try_to_timestamp(F.nullif(F.regexp_extract(name, TIMESTAMP_PATTERN, 1), F.lit("")), F.lit(TIMESTAMP_FORMAT)))


def time_label(world: Column, millis: Column) -> Column:
    return F.concat(world, F.lit("-"), F.date_format(F.timestamp_millis(millis), TIMESTAMP_FORMAT))


def retitled(label: Column, world: Column, old: Column, new: Column) -> Column:
    """The label for the new time if it was the generated one for the old time; any other label stays."""
    return F.when(label == time_label(world, old), time_label(world, new)).otherwise(label)


def short_id(id_: Column) -> Column:
    return F.substring(id_.cast("string"), 1, 12)


def clean_label(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(label, LABEL_PATTERN, "-"), r"^-+|-+$", "")


def without_archive_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"(\.tar\.gz|\.tar\.bz2|\.tar\.xz|\.tgz|\.tbz2|\.txz|\.tar|\.zip)$", "")


def shard_path(hex_hash: Column) -> Column:
    return F.concat_ws("/", F.substring(hex_hash, 1, 2), F.substring(hex_hash, 3, 2), hex_hash.substr(F.lit(5), F.length(hex_hash)))


def hash_of_path(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit(""))


def safe_dimension(key: Column) -> Column:
    return F.translate(key, "/\\", "--")


def render_modes(dimension: Column) -> Column:
    return F.when(dimension.startswith("DIM-1"), F.array(F.lit("nether-roof"), F.lit("nether-floor"))).otherwise(F.array(F.lit("topdown")))


def archive_kind(path: Column) -> Column:
    low = F.lower(path)
    tar = F.lit(False)
    for s in ARCHIVE_SUFFIXES[1:]:
        tar |= low.endswith(s)
    return F.when(low.endswith(".zip"), "zip").when(tar, "tar")


def entry_kind(rel: Column) -> Column:
    """What an archive entry is, its top folder already taken off; the first rule that fits holds."""
    parts = F.size(F.split(rel, "/"))
    return (
        F.when(rel.rlike(r"(^|/)level\.dat$") & (parts <= 3), "level")
        .when(rel.rlike(r"(^|/)region/r\.-?\d+\.-?\d+\.mc[ar]$"), "region")
        .when(rel.rlike(r"(^|/)c\.-?\d+\.-?\d+\.mcc$"), "external")
        .when(rel.startswith("logs/"), "log")
        .when(rel.startswith("crash-reports/"), "crash")
        .otherwise("other")
    )


def is_temporary(path: Column) -> Column:
    return path.contains(".tmp.")
