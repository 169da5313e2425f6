"""Baseline JPEG files from pictures, for thumbnails: 8 bits deep, no subsampling, Huffman tables made for each picture."""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

# Quantisation steps of the JPEG standard's example table for brightness, row by row.
STEPS = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""

#: Of an 8x8 block, row by row, the places in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_X, _U = np.meshgrid(np.arange(8), np.arange(8))
_BASIS = np.cos((2 * _X + 1) * _U * np.pi / 16) / 2 * np.where(_U == 0, np.sqrt(0.5), 1.0)


def steps(quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(STEPS.split(), int) * scale + 50) // 100, 1, 255).astype(int)


def ycc(rgb: np.ndarray) -> np.ndarray:
    """Brightness and colour differences of an RGB picture, around 0."""
    r, g, b = np.moveaxis(rgb.astype(float), -1, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y - 128, (b - y) / 1.772, (r - y) / 1.402], -1)


def code_lengths(counts: Counter) -> dict[int, int]:
    """Huffman code lengths of symbols, up to 16; the code of all ones stays free."""
    heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, [])]
    heapq.heapify(heap)
    lengths = dict.fromkeys(counts, 0)
    serial = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            lengths[s] += 1
        heapq.heappush(heap, (n + m, serial, a + b))
        serial += 1
    # the free code is one of the longest; where some are too long, codes of equal length do
    return lengths if max(lengths.values()) <= 16 else dict.fromkeys(counts, 8)


def codes(lengths: dict[int, int]) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Symbols in the order of their codes, and each one's code and length."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    out, code, before = {}, 0, 0
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        out[s] = code, before
        code += 1
    return order, out


def _symbols(block: np.ndarray, last: int) -> list[tuple[int, int, int, int]]:
    """(table, symbol, further bits, their number) of a block's coefficients in zigzag order; table 0 is for the first."""

    def bits(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return (v if v > 0 else v + (1 << n) - 1), n

    extra, n = bits(int(block[0]) - last)
    out = [(0, n, extra, n)]
    run = 0
    for k in np.flatnonzero(block[1:]).tolist():
        zeros = k - run
        run = k + 1
        while zeros > 15:
            out.append((1, 0xF0, 0, 0))
            zeros -= 16
        extra, n = bits(int(block[k + 1]))
        out.append((1, zeros << 4 | n, extra, n))
    if run < 63:
        out.append((1, 0, 0, 0))
    return out


def jpeg(picture: np.ndarray, quality: int = 85) -> bytes:
    """A file of a picture: height x width (grey) or height x width x 3 (RGB) bytes."""
    h, w = picture.shape[:2]
    planes = ycc(picture) if picture.ndim == 3 else picture[:, :, None].astype(float) - 128
    padded = np.pad(planes, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    n = padded.shape[2]
    blocks = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8, n).transpose(0, 2, 4, 1, 3)
    q = steps(quality)
    found = np.rint((_BASIS @ blocks @ _BASIS.T).reshape(-1, n, 64) / q).astype(int)[:, :, ZIGZAG]
    last, stream = [0] * n, []
    for mcu in found:
        for c in range(n):
            stream += _symbols(mcu[c], last[c])
            last[c] = int(mcu[c][0])
    tables = [codes(code_lengths(Counter(s for t, s, _, _ in stream if t == k))) for k in (0, 1)]
    text = []
    for table, symbol, extra, size in stream:
        code, length = tables[table][1][symbol]
        text.append(f"{code:0{length}b}")
        if size:
            text.append(f"{extra:0{size}b}")
    joined = "".join(text)
    joined += "1" * (-len(joined) % 8)
    data = int(joined, 2).to_bytes(len(joined) // 8, "big").replace(b"\xff", b"\xff\x00")

    def part(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body

    def huffman(k: int) -> bytes:
        order, known = tables[k]
        sizes = Counter(known[s][1] for s in order)
        return part(0xC4, bytes([k << 4, *(sizes[i] for i in range(1, 17)), *order]))

    frame = struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(n))
    scan = bytes([n, *(x for c in range(n) for x in (c + 1, 0x00)), 0, 63, 0])
    head = part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, bytes([0, *q[ZIGZAG].tolist()])) + part(0xC0, frame)
    return b"\xff\xd8" + head + huffman(0) + huffman(1) + part(0xDA, scan) + data + b"\xff\xd9"
