"""JPEG files of images, baseline and without loss but for quantisation, in numpy: cosine transform of 8 by 8 blocks, quantised
coefficients in runs, Huffman codes made for each image. Colours keep their resolution, or have half of it."""

from __future__ import annotations

import struct

import numpy as np

QUALITY = 95
#: The quantisers of quality 50 of brightness and of colour, row by row.
BRIGHTNESS = [
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
]
COLOUR = [
    [17, 18, 24, 47, 99, 99, 99, 99],
    [18, 21, 26, 66, 99, 99, 99, 99],
    [24, 26, 56, 99, 99, 99, 99, 99],
    [47, 66, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
]
#: Diagonals from the upper left corner, in turns upwards and downwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Symbols of the end of a block, and of 16 zeros.
_END, _ZEROS = 0, 0xF0


def quantisers(quality: int) -> tuple[np.ndarray, np.ndarray]:
    """8 by 8 quantisers of brightness and colour for a quality from 1 to 100."""
    if not 1 <= quality <= 100:
        raise ValueError("the quality must be from 1 to 100")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((np.array(base) * scale + 50) // 100, 1, 255) for base in (BRIGHTNESS, COLOUR))


def _planes(image: np.ndarray) -> list[np.ndarray]:
    """Brightness and two colours around 0 of blue, green and red."""
    b, g, r = (image[..., k].astype(float) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return [y - 128, (b - y) / 1.772, (r - y) / 1.402]


def _blocks(plane: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Quantised coefficients (rows of blocks, blocks, 64 in zigzag order) of a plane of whole blocks."""
    h, w = plane.shape
    tiles = plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)
    found = np.rint(_COSINES @ tiles @ _COSINES.T / quantiser).astype(np.int64)
    return found.reshape(h // 8, w // 8, 64)[..., ZIGZAG]


def _padded(plane: np.ndarray, to: int) -> np.ndarray:
    h, w = plane.shape
    return np.pad(plane, ((0, -h % to), (0, -w % to)), mode="edge")


def code_lengths(counts: np.ndarray, longest: int = 16) -> np.ndarray:
    """Lengths of the best prefix code for symbols that occur so often, none above ``longest``; a symbol that never occurs has
    none. Coins of the two sides of a pair are packed together level by level; a symbol's length is in how many packs it is."""
    lengths = np.zeros(len(counts), np.int64)
    coins = sorted((int(counts[k]), (k,)) for k in np.flatnonzero(counts))
    if len(coins) == 1:
        lengths[coins[0][1][0]] = 1
        return lengths
    packs: list = []
    for _ in range(longest):
        level = sorted(coins + packs)
        packs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
    for _, members in packs[: len(coins) - 1]:
        np.add.at(lengths, list(members), 1)
    return lengths


class Code:
    """A Huffman code of bytes that occur so often; no code has ones alone, for one more symbol of no use takes that."""

    def __init__(self, symbols: np.ndarray) -> None:
        # Doubled, so that the one more is rarer than all.
        counts = np.append(2 * np.bincount(symbols, minlength=256), 1)
        lengths = code_lengths(counts)
        used = [k for k in np.lexsort((np.arange(257), lengths)) if lengths[k]]
        self.values = np.array([k for k in used if k < 256], np.int64)
        self.per_length = np.bincount(lengths[self.values], minlength=17)[1:]
        self.code, self.length, code = np.zeros(256, np.int64), lengths[:256], 0
        for last, k in zip([None, *used], used, strict=False):
            code = 0 if last is None else (code + 1) << int(lengths[k] - lengths[last])
            if k < 256:
                self.code[k] = code

    def table(self, at: int) -> bytes:
        return bytes([at, *self.per_length.tolist(), *self.values.tolist()])


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of whole numbers without their signs."""
    return np.frexp(np.abs(values).astype(float))[1].astype(np.int64)


def _events(blocks: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a scan of blocks (n, 64) says, in its order: block, whether it is of a mean, symbol, size and bits of the value."""
    step = blocks[:, 0] - before
    n = len(blocks)
    block, z = np.nonzero(blocks[:, 1:])
    value, z = blocks[block, z + 1], z + 1
    # Zeros since the value before it in its block.
    begins = np.ones(len(block), bool)
    begins[1:] = block[1:] != block[:-1]
    last = np.where(begins, 0, np.roll(z, 1))
    gap = z - last - 1
    long, size = gap // 16, _sizes(value)
    open_ = np.ones(n, bool)
    open_[block[z == 63]] = False
    ends = np.flatnonzero(open_)
    runs = np.repeat(np.arange(len(block)), long)
    where = np.concatenate([np.arange(n) * 256, block[runs] * 256 + z[runs] * 2, block * 256 + z * 2 + 1, ends * 256 + 255])
    mean = np.concatenate([np.ones(n, bool), np.zeros(len(runs) + len(block) + len(ends), bool)])
    symbol = np.concatenate([_sizes(step), np.full(len(runs), _ZEROS), gap % 16 << 4 | size, np.full(len(ends), _END)])
    bits = np.concatenate([_sizes(step), np.zeros(len(runs), np.int64), size, np.zeros(len(ends), np.int64)])
    amount = np.concatenate([step, np.zeros(len(runs), np.int64), value, np.zeros(len(ends), np.int64)])
    order = np.argsort(where, kind="stable")
    amount = np.where(amount < 0, amount + (1 << bits) - 1, amount)
    return where[order] // 256, mean[order], symbol[order], bits[order], amount[order]


def _packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Numbers of so many bits (up to 32) one after the other, filled up with ones; a byte of ones is followed by an empty one."""
    fill = -int(lengths.sum()) % 8
    values, lengths = np.append(values, (1 << fill) - 1), np.append(lengths, fill)
    at = np.cumsum(lengths) - lengths
    shifted = values << (40 - lengths - at % 8)
    total = np.zeros(int(lengths.sum()) // 8 + 5)
    for k in range(5):
        total += np.bincount(at // 8 + k, (shifted >> (32 - 8 * k)) & 255, len(total))[: len(total)]
    return total[:-5].astype(np.uint8).tobytes().replace(b"\xff", b"\xff\x00")


def jpeg(image: np.ndarray, quality: int = QUALITY, halved: bool = False) -> bytes:
    """The image (height, width, 3 bytes: blue, green, red) as a JPEG file; ``halved`` gives colours half the resolution."""
    h, w = image.shape[:2]
    if not (0 < h < 65536 and 0 < w < 65536):
        raise ValueError("a JPEG file has from 1 to 65535 rows and columns")
    step = 2 if halved else 1
    tables = quantisers(quality)
    planes = [_padded(plane, 8 * step) for plane in _planes(image)]
    if halved:
        planes[1:] = [p.reshape(p.shape[0] // 2, 2, -1, 2).mean((1, 3)) for p in planes[1:]]
    found = [_blocks(plane, tables[k > 0]) for k, plane in enumerate(planes)]
    rows, columns = found[1].shape[:2]
    # Units of a scan: the blocks of brightness of a square, row by row, then one of each colour.
    units = [found[0].reshape(rows, step, columns, step, 64).swapaxes(1, 2).reshape(rows * columns, step * step, 64), *(p.reshape(rows * columns, 1, 64) for p in found[1:])]
    before = []
    for unit in units:
        means = unit[..., 0].ravel()
        before.append(np.append(0, means[:-1]).reshape(unit.shape[:2]))
    blocks, before = np.concatenate(units, 1).reshape(-1, 64), np.concatenate(before, 1).ravel()
    coloured = np.tile(np.arange(step * step + 2) >= step * step, rows * columns)
    block, mean, symbol, bits, amount = _events(blocks, before)
    kind = coloured[block] * 2 + ~mean  # 0 and 1: means and others of brightness; 2 and 3: of colour
    codes = [Code(symbol[kind == k]) for k in range(4)]
    code, length = (np.stack([getattr(c, name) for c in codes])[kind, symbol] for name in ("code", "length"))
    data = _packed(code << bits | amount, length + bits)
    part = lambda mark, body: struct.pack(">BBH", 255, mark, len(body) + 2) + body
    shape = struct.pack(">BHHB", 8, h, w, 3) + bytes([1, step * 16 + step, 0, 2, 0x11, 1, 3, 0x11, 1])
    return b"".join([
        b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), *(part(0xDB, bytes([k, *table.ravel()[ZIGZAG].tolist()])) for k, table in enumerate(tables)), part(0xC0, shape),
        *(part(0xC4, codes[k].table(at)) for k, at in enumerate((0x00, 0x10, 0x01, 0x11))), part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])), data, b"\xff\xd9",
    ])
