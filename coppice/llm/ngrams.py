"""Hashed character n-grams of whole texts, vectorised over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from coppice.llm.bytescan import BLANK, LOWER, slices, text_buffers

_FACTOR = np.uint32(0x9E3779B1)


def gram_buckets(column: pa.Array, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Pieces of whole rows: the first row, and for each order the row (from there) and bucket below 2**bits of every n-gram.

    A-Z is lower-cased and each run of blanks counts as one space. An n-gram is a run of
    whole UTF-8 characters and never spans two rows; a shorter text has none.
    """
    data, offsets = text_buffers(column)
    for i, j in slices(offsets):
        raw = LOWER[data[offsets[i] : offsets[j]]]
        own = offsets[i : j + 1] - offsets[i]
        lead = (raw & 0xC0) != 0x80
        blank = BLANK[raw]
        keep = lead
        first = keep[own[:-1][own[:-1] < len(raw)]].copy()
        keep[1:] &= ~(blank[1:] & blank[:-1])
        keep[own[:-1][own[:-1] < len(raw)]] |= first
        at = np.flatnonzero(keep)
        if not len(at):
            continue
        # A character's code: its bytes, folded from the lead byte on.
        code = np.where(blank[at], np.uint32(32), raw[at]).astype(np.uint32)
        wide = np.flatnonzero(code >= 0xC0)
        if len(wide):
            spot = at[wide]
            follow = np.zeros((3, len(wide)), np.uint32)
            for k in (1, 2, 3):
                inside = spot + k < len(raw)
                byte = np.zeros(len(wide), np.uint32)
                byte[inside] = raw[spot[inside] + k]
                follow[k - 1] = np.where((byte & 0xC0) == 0x80, byte, 0)
            code[wide] = code[wide] + follow[0] * np.uint32(257) + follow[1] * np.uint32(66049) + follow[2] * np.uint32(16974593)
        rows = (np.searchsorted(own, at, side="right") - 1).astype(np.int32)
        found = []
        for n in orders:
            m = len(code) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h *= _FACTOR
                h ^= code[k : k + m]
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            h >>= np.uint32(32 - bits)
            inside = rows[:m] == rows[n - 1 :]
            found.append((rows[:m][inside], h[inside]))
        yield i, found
