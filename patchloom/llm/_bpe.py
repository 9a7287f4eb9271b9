"""Byte-level BPE ids of a tokenizers file, for many texts at once.

Texts are cut into the file's pieces (words with the space before them, numbers, runs of other
signs, white space) by comparing character classes in numpy. The distinct pieces of a chunk are
found by hash; each is looked up among the pieces met before or else encoded from the file's
vocabulary, where ids are merge ranks. Texts with characters outside ``CLASSES`` or with special
tokens in them, and files of another kind, go to the tokenizers library itself.
"""

from __future__ import annotations

import array
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from . import _hashing as H

#: Pieces kept, and the longest that is.
KEPT, LONGEST = 150_000, 24
CHUNK = 1 << 19
LETTER, NUMBER, SPACE, OTHER, STOP = range(5)
#: Between texts; no text that holds it is cut here.
STOP_SIGN = "⁣"
#: What this module cuts: Latin, and general punctuation from the first hyphen on.
PLAIN = re.compile("[^\x00-ɏ‐-‧‰-⁞]")
_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 0x2064, dtype=np.uint64)


def _class(c: int) -> int:
    kind = unicodedata.category(chr(c))[0]
    if c == ord(STOP_SIGN):
        return STOP
    return LETTER if kind == "L" else NUMBER if kind == "N" else SPACE if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x205F) or 0x2000 <= c <= 0x200A else OTHER


CLASSES = np.array([_class(c) for c in range(0x2064)], np.uint8)


def cut(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts that each end in STOP_SIGN."""
    kind = CLASSES[code]
    n = len(kind)
    at = np.ones(n + 1, bool)
    at[1:n] = kind[1:] != kind[:-1]
    # White space before something: its last sign stands apart, and goes to what follows if it is a space.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != STOP))
    at[last] = True
    at[last[code[last] == 32] + 1] = False
    # An apostrophe that stands alone before s, t, re, ve, m, ll or d goes with it.
    one = np.flatnonzero((code == 39) & at[:n] & at[1:])
    one = one[one + 1 < n]
    if len(one):
        a, b = code[one + 1], code[np.minimum(one + 2, n - 1)]
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        taken = short | long
        at[one[taken] + 1] = False
        at[one[taken] + 2 + long[taken]] = True
    start = np.flatnonzero(at[:n])
    end = np.append(start[1:], n)
    keep = kind[start] != STOP
    return start[keep], end[keep]


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible Latin-1 as itself, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pieces(dict):
    """Ids of pieces, as bytes of unsigned 32-bit numbers."""

    def __init__(self, core) -> None:
        super().__init__()
        self.core = core

    def __missing__(self, piece: str) -> bytes:
        out = array.array("I", self.core.encode_single_piece(piece.encode())).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, cutter, added = _byte_letters(), spec.get("pre_tokenizer") or {}, spec["added_tokens"]
        self.special = [x["content"] for x in added]
        own = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
        own = own and spec["model"]["type"] == "BPE" and not spec["normalizer"] and not spec["model"].get("ignore_merges")
        self.pieces = None
        if own:
            ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
            self.pieces = Pieces(tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe)

    @staticmethod
    @lru_cache(maxsize=2)
    def at(path: str) -> Encoder:
        return Encoder(path)

    def _chunk(self, texts: list[str]) -> list[bytes]:
        joined = STOP_SIGN.join(texts) + STOP_SIGN
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        start, end = cut(code)
        _, shown, place = np.unique(H.spans(code, _CODES, start, end), return_index=True, return_inverse=True)
        found = list(map(self.pieces.__getitem__, [joined[a:b] for a, b in zip(start[shown].tolist(), end[shown].tolist(), strict=True)]))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes
        each = sizes[place]
        to = np.cumsum(each)
        ids = flat[np.repeat(begin[place] - to + each, each) + np.arange(int(to[-1]) if len(to) else 0)]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.concatenate(([0], np.concatenate(([0], to))[np.searchsorted(start, text_ends)])).tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(upto[:-1], upto[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit, without special tokens added."""
        out: list[bytes] = [b""] * len(texts)
        mine, rest, size = [], [], 0

        def flush() -> None:
            for i, ids in zip(mine, self._chunk([texts[i] for i in mine]) if mine else (), strict=True):
                out[i] = ids
            mine.clear()

        for i, text in enumerate(texts):
            if self.pieces is None or any(s in text for s in self.special) or not (text.isascii() or not PLAIN.search(text)):
                rest.append(i)
                continue
            mine.append(i)
            size += len(text)
            if size > CHUNK:
                flush()
                size = 0
        flush()
        for i, e in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else (), strict=True):
            out[i] = array.array("I", e.ids).tobytes()
        return out
