"""Splits texts as public_tokenizers.PATTERN does, for many texts at once.

The pattern only looks at the kind of each character (letter, number, space, other), at single spaces before a run, and at
English contractions after a lone apostrophe, so the ends of all matches follow from comparisons of neighbouring characters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import accumulate, chain

import numpy as np

OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)


def _members(what: str, library: str, every: str) -> list[int]:
    """The code points of a class as a library's own Unicode tables have it."""
    if library == "tokenizers":
        from tokenizers import Regex, normalizers

        rest = normalizers.Replace(Regex(what), "").normalize_str(every)
        return list(set(map(ord, every)) - set(map(ord, rest)))
    import tiktoken

    single = tiktoken.Encoding("class", pat_str=what, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return [*map(ord, bytes(single.encode_ordinary(every)).decode())]  # what the pattern does not match has no tokens


@cache
def kinds(library: str = "tiktoken") -> np.ndarray:
    """The kind of every code point."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.zeros(0x110000, np.uint8)
    for kind, what in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        table[_members(what, library, every)] = kind
    return table


def places(texts: list[str], library: str = "tiktoken") -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts, each with a zero after it, as one string and as code points; where each match of the pattern starts and ends in
    them; the n + 1 bounds of each text's matches."""
    big = "\0".join(texts) + "\0"
    codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = kinds(library)[codes]
    kind[breaks] = BREAK
    n = len(kind)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[breaks] = True
    word = kind <= NUMBER
    # a space run before a word: its last character stands alone, or goes with the word if it is U+0020
    after = np.flatnonzero(word[1:] & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[codes[after - 1] == 0x20]] = False
    # contractions: a lone apostrophe without a space before it
    mark = np.flatnonzero((codes[:-2] == 0x27) & (kind[:-2] == OTHER)) if n > 2 else np.zeros(0, np.int64)
    if len(mark):
        mark = mark[start[mark] & (kind[mark + 1] == LETTER)]
        one, two = codes[mark + 1], codes[np.minimum(mark + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((mark[short], 2), (mark[long & ~short], 3)):
            start[hit + 1] = False
            start[hit + size] = True
    at = np.flatnonzero(start)
    end = np.append(at[1:], n)
    keep = kind[at] != BREAK
    at, end = at[keep], end[keep]
    bounds = np.concatenate([[0], np.searchsorted(at, breaks)])
    return big, codes, at, end, bounds


def split(texts: list[str], library: str = "tiktoken") -> tuple[list[str], np.ndarray]:
    """All matches of the pattern in all texts in order, and the n + 1 bounds of each text's matches."""
    if not texts:
        return [], np.zeros(1, np.int64)
    big, _, at, end, bounds = places(texts, library)
    return [big[a:b] for a, b in zip(at.tolist(), end.tolist(), strict=True)], bounds


@cache
def _factors(n: int = 1024) -> np.ndarray:
    """Odd factors, the same in every process."""
    return np.random.default_rng(7).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def same(codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the runs of codes (none of them empty) stand for all, and for each run the number of its own among those. Runs meet
    by a hash, and each is compared with what stands for it; one that differs stands for itself."""
    low = np.cumsum(size) - size
    inside = np.arange(size.sum(), dtype=np.int32) - np.repeat(low.astype(np.int32), size)
    flat = codes[np.repeat(at.astype(np.int32), size) + inside]
    factor = _factors()
    value = np.add.reduceat(flat * factor[np.minimum(inside, len(factor) - 1)], low)
    _, own = np.unique(value ^ (value >> np.uint64(32)), return_inverse=True)
    first = np.empty(own.max() + 1, np.int64)
    first[own] = np.arange(len(own))
    all_ = first[own]
    differs = codes[np.minimum(np.repeat(at[all_].astype(np.int32), size) + inside, len(codes) - 1)] != flat
    bad = np.flatnonzero((np.add.reduceat(differs, low) > 0) | (size != size[all_]))
    own[bad] = len(first) + np.arange(len(bad))
    return np.concatenate([first, bad]), own


class Pieces:
    """Encodes texts through a bounded cache from match to ids. Equal matches of a call are looked up once; misses are encoded
    together."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], library: str = "tiktoken", most: int = 300_000):
        self.encode, self.library, self.most, self.known = encode, library, most, {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        big, codes, at, end, bounds = places(texts, self.library)
        if not len(at):
            return [b""] * len(texts)
        if len(self.known) > self.most:
            self.known.clear()
        first, own = same(codes, at, end - at)
        parts = [big[a:b] for a, b in zip(at[first].tolist(), end[first].tolist(), strict=True)]
        got = list(map(self.known.get, parts))
        if new := list({p for p, g in zip(parts, got, strict=True) if g is None}):
            ids = self.encode(new)
            ends = [0, *accumulate(4 * len(x) for x in ids)]
            flat = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1] // 4).tobytes()
            self.known.update(zip(new, map(flat.__getitem__, map(slice, ends, ends[1:])), strict=True))
            got = [self.known[p] if g is None else g for p, g in zip(parts, got, strict=True)]
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat, start, size = np.frombuffer(b"".join(got), "<u4"), (np.cumsum(size) - size)[own], size[own]
        ends = np.concatenate([[0], np.cumsum(size)])
        every = flat[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)].tobytes()
        b = (4 * ends[bounds]).tolist()
        return [every[x:y] for x, y in zip(b, b[1:])]  # noqa: B905


@cache
def ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def rank_pieces(path: str, library: str = "tokenizers") -> Pieces:
    """Encodes by the ranks in a file of the public tokenizers, which every executor has beside the library; library: whose
    Unicode tables split the text."""
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    one = enc._core_bpe.encode_single_piece
    return Pieces(lambda parts: [one(p.encode("utf-8", "replace")) for p in parts], library)
