"""Content-defined chunking with a gear rolling hash.

The hash of a place is the sum of the table entries of the last ``window``
bytes, each shifted by its distance; a chunk ends where the top bits of the hash
are zero.  It depends on those bytes alone, so an insertion moves cuts only
near itself.  The whole array is hashed at once, by doubling the window.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: 256 random 32-bit numbers, from a rule.
TABLE = np.frombuffer(b"".join(hashlib.sha256(b"gear %d" % i).digest() for i in range(32)), "<u4")[:256].copy()


@dataclass(frozen=True)
class Chunker:
    """bits: a place is a cut with probability 2**-bits.  window: 1, 2, 4, ... 32 bytes."""

    bits: int
    least: int
    most: int
    window: int = 32

    def hashes(self, data: np.ndarray) -> np.ndarray:
        h, width = TABLE[data], 1
        while width < self.window:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
            width *= 2
        return h

    def ends(self, data: bytes) -> list[int]:
        """Ends of the chunks; the last is the end of the data.  No data, no chunk."""
        n = len(data)
        if n <= self.least:
            return [n] if n else []
        places = np.flatnonzero(self.hashes(np.frombuffer(data, np.uint8)) >> np.uint32(32 - self.bits) == 0) + 1
        out, last, least, most = [], 0, self.least, self.most
        for at in places.tolist():
            while at - last > most:
                last += most
                out.append(last)
            if at - last >= least:
                out.append(at)
                last = at
        while n - last > most:
            last += most
            out.append(last)
        if last < n:
            out.append(n)
        return out
