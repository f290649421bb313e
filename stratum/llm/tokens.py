"""Token ids by a tokenizer file, as little-endian unsigned 32-bit bytes: those of tokenizers with add_special_tokens=False."""

from __future__ import annotations

import json
import re
from array import array

from stratum.llm.workers import worker_memo

#: White space that is not one lone space inside a text: there, a text can't be cut before each space.
_RUNS = re.compile(r"\s | \s")
_LONE = re.compile(r"\S(?= \S)")
RUN = 10_000  # characters of white space in a row that tiktoken's pattern can't always take
_RUN = re.compile(rf"\s{{{RUN}}}")
STRETCH = 1_000_000  # characters of a long text that are encoded at once
CACHED_PIECES = 200_000


class _Pieces(dict):
    """Ids of ' ' + piece; pieces beyond the bound are encoded each time."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.encode(" " + piece)).tobytes()
        if len(self) < CACHED_PIECES and len(piece) < 64:
            self[piece] = ids
        return ids


class IdBytes:
    """text -> its ids, without special tokens around it; the string of an added token inside it is that token.

    A byte-level BPE whose ids are its merge ranks is run by tiktoken, which gives the same ids. Its pattern never
    joins a lone space to what stands before, so texts without runs of white space are cut before each space and the
    pieces, which repeat, are looked up; longer texts go through in stretches cut at such a space. Texts that hold an added
    token's string or very much white space in a row, and any other tokenizer file, are run by tokenizers.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = self._ranks(spec)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))).search if added and ranks else lambda text: None
        self.path, self.own = path, None
        if ranks:
            import public_tokenizers
            import tiktoken

            self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.pieces = _Pieces(self.encode)
        else:
            self.encode, self.pieces = self.exactly, None

    def exactly(self, text: str) -> list[int]:
        if self.own is None:
            import tokenizers

            self.own = tokenizers.Tokenizer.from_file(self.path)
        return self.own.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if model.get("type") != "BPE" or not plain:
            return None
        vocab = model["vocab"]
        for i, pair in enumerate(model["merges"]):
            if vocab["".join(pair if isinstance(pair, list) else pair.split(" "))] != 256 + i:
                return None
        # Byte-level files spell a byte as a printable character: itself, or one from 256 on for the others, in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}

    def _plain(self, text: str) -> bytes:
        if _RUNS.search(text):
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        head = array("I", self.encode(first)).tobytes()
        return head + b"".join(map(self.pieces.__getitem__, rest)) if rest else head

    def __call__(self, text: str) -> bytes:
        if self.pieces is None or self.added(text) or (len(text) >= RUN and _RUN.search(text)):
            return array("I", self.exactly(text)).tobytes()
        if len(text) <= STRETCH:
            return self._plain(text)
        out, begin = [], 0
        while cut := _LONE.search(text, begin + STRETCH):
            out.append(self._plain(text[begin : cut.start() + 1]))
            begin = cut.start() + 1
        return b"".join([*out, self._plain(text[begin:])])


def id_bytes(path: str) -> IdBytes:
    memo = worker_memo()
    if ("ids", path) not in memo:
        memo["ids", path] = IdBytes(path)
    return memo["ids", path]
