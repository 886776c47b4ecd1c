"""Words and their 64-bit codes for operators that work on Arrow batches."""

from __future__ import annotations

import numpy as np

_P, _M64 = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INVERSE = pow(_P, -1, 1 << 64)
_ALL = np.arange(256)
#: Bytes that belong to words: the contract's alphanumeric kind (all bytes beyond ASCII count, so
#: characters do), and what is not white space.
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
NONSPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Texts longer than this are cut between words first, so that the tables of powers stay small.
PIECE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit codes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return h ^ (h >> np.uint64(32))


_BYTE = mixed(_ALL.astype(np.uint64) + np.uint64(0x51ED270B))
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, n)
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; ``bytes.lower`` changes nothing else."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def coded(data: bytes, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of the words in ``data``, and where they start and end in it.

    A code depends on the word's bytes alone: it is the word's polynomial in ``_P``, got for all
    words at once from running sums, shifted to the word's place and mixed.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = kind[raw]
    if len(raw) > PIECE:
        gaps = np.flatnonzero(~inside[len(raw) // 2 :])
        if len(gaps) and (cut := len(raw) // 2 + int(gaps[0])) < len(raw):
            a, b = coded(data[:cut], kind), coded(data[cut + 1 :], kind)
            shift = cut + 1
            return tuple(np.concatenate([x, y + y.dtype.type(s)]) for x, y, s in zip(a, b, (0, shift, shift), strict=True))
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers_of(_P, len(raw)), out=sums[1:])
    codes = (sums[ends] - sums[starts]) * _powers_of(_INVERSE, len(raw) + 1)[starts]
    return mixed(codes + (ends - starts).astype(np.uint64)), starts, ends


def said(data: bytes, starts: np.ndarray, ends: np.ndarray, at: int, length: int) -> str:
    """The words from place ``at`` on, separated by blanks."""
    found = [data[starts[i] : ends[i]] for i in range(at, at + length)]
    return b" ".join(found).decode("utf-8", "surrogatepass")


def windows(codes: np.ndarray, length: int) -> np.ndarray:
    """The code of every run of ``length`` consecutive words, in order."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = codes[:n].copy()
    for k in range(1, length):
        h *= np.uint64(_P)
        h += codes[k : k + n]
    return mixed(h)
