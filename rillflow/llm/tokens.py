"""Words of a whole Arrow batch as arrays: spans, hashes and window hashes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of one pass; documents are cut only between words.
CHUNK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_R = np.uint64(0xD6E8FEB86659FD93)


def _powers(r: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.cumprod(np.full(n - 1, r, np.uint64))
    return out


_POW = _powers(int(_R), CHUNK + 1)
_INV = _powers(pow(int(_R), -1, 1 << 64), CHUNK + 1)


def byte_class(pattern_not: str) -> np.ndarray:
    """256 flags: bytes that are not among the given characters (all of them ASCII)."""
    flags = np.ones(256, bool)
    flags[np.frombuffer(pattern_not.encode(), np.uint8)] = False
    return flags


#: Bytes that the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] keeps once A-Z are lower case.
ALNUM = byte_class("".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def _spans(buf: np.ndarray, edges: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes, cut at edges (document starts and ends)."""
    inside = keep[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edges[edges < len(buf)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def _hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; words of equal bytes get equal hashes wherever they stand."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _POW[: len(buf)], out=total[1:])
    return _mix((total[ends] - total[starts]) * _INV[starts])


class Words:
    """Lower-case bytes of some documents, their words (start, end, hash) and each word's document."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, keep: np.ndarray = ALNUM):
        self.buf, self.offsets = LOWER[buf], offsets
        starts, ends, hashes, at = [], [], [], 0
        while at < len(buf):
            stop = min(len(buf), at + CHUNK)
            if stop < len(buf):  # back to where a word may end: after a byte outside words, or between documents
                gap = np.flatnonzero(~keep[self.buf[at:stop]])
                edge = offsets[np.searchsorted(offsets, stop, "right") - 1]
                stop = max(at + int(gap[-1]) + 1 if len(gap) else at, int(edge))
            if stop > at:
                part = self.buf[at:stop]
                lo, hi = np.searchsorted(offsets, (at, stop + 1))
                s, e = _spans(part, offsets[lo:hi] - at, keep)
                starts.append(s + at)
                ends.append(e + at)
                hashes.append(_hash(part, s, e))
            else:  # one word longer than a pass
                gap = np.flatnonzero(~keep[self.buf[at:]])
                stop = min(at + int(gap[0]) if len(gap) else len(buf), int(offsets[np.searchsorted(offsets, at, "right")]))
                starts.append(np.array([at]))
                ends.append(np.array([stop]))
                hashes.append(np.array([xxhash.xxh64_intdigest(self.buf[at:stop].tobytes())], np.uint64))
            at = stop
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.start, self.end, self.hash = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1

    def text(self, word: int, n: int) -> bytes:
        """Words from ``word`` on, joined by single spaces."""
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.start[word : word + n], self.end[word : word + n]))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of n words, and whether it lies in one document."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        out, factor = np.zeros(m, np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(n):
                factor = factor * _ODD
                out += self.hash[k : k + m] * factor
        return _mix(out), self.doc[:m] == self.doc[n - 1 :]


def chunks(texts: pa.Array, most: int = 4 * CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows of about ``most`` bytes; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words_of(text: str | None, keep: np.ndarray = ALNUM) -> Words:
    buf = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return Words(buf, np.array([0, len(buf)]), keep)
