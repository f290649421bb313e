"""Words, hashes of stretches and exact names of shingles, over arrays of bytes."""

from __future__ import annotations

import re

WHITE = re.compile(rb"[\x20\x09-\x0D]")
LONG = 512  # bytes of a stretch that is hashed by hashlib


def mix64(x):
    """A finalizer that spreads every bit of uint64 values (splitmix64's constants)."""
    import numpy as np

    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def eights(data):
    """uint64 view: the eight bytes from each place of ``data`` (a uint8 array) on, with zeros beyond its end."""
    import numpy as np

    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def span_hashes(data, start, end, seed: int = 0):
    """64-bit hashes of stretches: eight bytes at a time through a non-linear mixer, long ones by blake2b.

    Every step is a bijection of the state, so stretches of up to eight bytes and one length never collide.
    """
    import hashlib

    import numpy as np

    size = end - start
    out = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & (1 << 64) - 1))
    view, masks = eights(data), np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    place, left = start[live], size[live]
    while len(live):
        out[live] = mix64((out[live] ^ (view[place] & masks[np.minimum(left, 8)])) * np.uint64(0x9FB21C651E98DF25))
        more = left > 8
        live, place, left = live[more], place[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


def word_spans(raw: list[bytes]):
    """(data, doc, start, end) of every word in order: runs of bytes other than white space (32, 9 to 13), A-Z lower-cased."""
    import numpy as np

    data = np.frombuffer(b"\n".join([b"", *(r.lower() for r in raw), b""]), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="left")
    return data, doc, start, end


def word_hashes(raw: list[bytes]):
    """(doc, hash) of every word in order."""
    data, doc, start, end = word_spans(raw)
    return doc, span_hashes(data, start, end)


def stretches(raw: bytes, size: int, overlap: int):
    """Parts of a long text, cut at white space; the last ``overlap`` words of a part begin the next one as well.

    So any overlap + 1 words in a row lie within some part. A part has more words than that, unless it is the whole text.
    """
    begin, stop = 0, size
    while stop < len(raw) and (space := WHITE.search(raw, stop)):
        stop = space.start()
        part = raw[begin:stop]
        if overlap and len(part.rsplit(None, overlap + 1)) < overlap + 2:
            stop += size
            continue
        yield part
        begin = begin + len(part.rsplit(None, overlap)[0]) if overlap else stop
        stop = begin + size
    yield raw[begin:]


def named_shingles(raw: list[bytes], width: int):
    """(doc, name) sorted by both: distinct runs of ``width`` words by name. Equal names mean equal words, byte by byte.

    A text with fewer words is one run. Names come from the words themselves, step by step over pairs, never from hashes.
    """
    import numpy as np

    known: dict[bytes, int] = {}
    ids = []
    for r in raw:
        parts = [np.fromiter((known.setdefault(w, len(known)) for w in part.lower().split()), np.int64) for part in stretches(r, 4_000_000, 0)]
        ids.append(np.concatenate(parts) if len(parts) > 1 else parts[0])
    word, doc = np.concatenate(ids), np.repeat(np.arange(len(raw)), [len(i) for i in ids])
    name, have = word, 1
    while have < width and len(name) > (step := min(have, width - have)):
        # Two overlapping names of ``have`` words name the have + step words that they cover together.
        pair = name[:-step] * (int(name.max()) + 1) + name[step:]
        name, have = np.unique(pair, return_inverse=True)[1], have + step
    whole = np.arange(len(word)) + width <= len(word)
    whole[whole] = doc[: whole.sum()] == doc[width - 1 :][: whole.sum()]
    docs, names = [doc[whole]], [name[np.flatnonzero(whole)] if whole.any() else np.zeros(0, np.int64)]
    few: dict[tuple, int] = {}
    for d, i in enumerate(ids):
        if 0 < len(i) < width:
            docs.append(np.array([d]))
            names.append(np.array([-1 - few.setdefault(tuple(i.tolist()), len(few))]))
    doc, name = np.concatenate(docs), np.concatenate(names)
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    new = np.concatenate((np.ones(min(1, len(name)), bool), (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])))
    return doc[new], name[new]


def distinct(values):
    """Sorted distinct values and how often each occurs."""
    import numpy as np

    values = np.sort(values)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
    return values[at], np.diff(np.concatenate((at, [len(values)])))
