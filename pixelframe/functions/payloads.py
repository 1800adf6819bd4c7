"""What the bytes of an image file say of themselves, without decoding it: kind, size, how it is turned, and whether it is whole."""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

#: Bytes of a compressed stream that are expanded together.
_PART = 1 << 16


class Told(NamedTuple):
    """``reason`` is null where nothing is wrong; ``orientation`` is 1 (upright) to 8."""

    kind: str | None = None
    width: int | None = None
    height: int | None = None
    orientation: int = 1
    reason: str | None = None


class Damage(Exception):
    pass


def probe(data: bytes | None) -> Told:
    """Reasons: ``empty``, ``unknown kind``, ``cut short``, ``damaged``."""
    if not data:
        return Told(reason="empty")
    for kind, (begin, look) in KINDS.items():
        if data.startswith(begin):
            try:
                return Told(kind, *look(data))
            except Damage as damage:
                return Told(kind, reason=str(damage))
            except (struct.error, IndexError):
                return Told(kind, reason="cut short")
            except zlib.error:
                return Told(kind, reason="damaged")
    return Told(reason="unknown kind")


def _png(data: bytes) -> tuple:
    at, size, turn, expand, total, kind = 8, None, 1, zlib.decompressobj(), 0, b""
    while kind != b"IEND":
        length, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + length]
        (check,) = struct.unpack_from(">I", data, at + 8 + length)
        if zlib.crc32(kind + body) != check:
            raise Damage("damaged")
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            size = width, height
        elif kind == b"eXIf":
            turn = _orientation(body)
        elif kind == b"IDAT":
            while body:  # expanded in parts, so that a small file can't take a large room
                total += len(expand.decompress(body, _PART))
                body = expand.unconsumed_tail
        at += length + 12
    if size is None or 0 in size:
        raise Damage("damaged")
    row = 1 + (width * bits * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 1) + 7) // 8
    if total < (row * height if not interlaced else 1):
        raise Damage("cut short")
    return (*size, turn)


def _bmp(data: bytes) -> tuple:
    begin, _, width, height, _, bits = struct.unpack_from("<IIiiHH", data, 10)
    if width <= 0 or height == 0:
        raise Damage("damaged")
    if begin + (width * bits + 31) // 32 * 4 * abs(height) > len(data):
        raise Damage("cut short")
    return width, abs(height), 1


def _gif(data: bytes) -> tuple:
    width, height = struct.unpack_from("<HH", data, 6)
    if not data.rstrip(b"\0").endswith(b";"):
        raise Damage("cut short")
    return width, height, 1


def _jpeg(data: bytes) -> tuple:
    at, size, turn = 2, None, 1
    while True:
        if data[at] != 0xFF:
            raise Damage("damaged")
        mark = data[at + 1]
        if mark == 0xFF:  # filling
            at += 1
            continue
        if mark == 0xD9:
            raise Damage("damaged")
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        (length,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + length]
        if len(body) < length - 2:
            raise Damage("cut short")
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            _, height, width = struct.unpack_from(">BHH", body)
            size = width, height
        elif mark == 0xE1 and body.startswith(b"Exif\0\0"):
            turn = _orientation(body[6:])
        elif mark == 0xDA:
            break
        at += 2 + length
    if size is None or 0 in size:
        raise Damage("damaged")
    if data.rfind(b"\xff\xd9", at) < 0:
        raise Damage("cut short")
    return (*size, turn)


def _orientation(tiff: bytes) -> int:
    """Tag 274 of the first directory; 1 where there is none, or none that can be read."""
    try:
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]
        magic, at = struct.unpack_from(order + "HI", tiff, 2)
        (n,) = struct.unpack_from(order + "H", tiff, at)
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * k)
            if magic == 42 and tag == 274 and kind == 3 and count == 1 and 1 <= value <= 8:
                return value
    except (KeyError, struct.error):
        pass
    return 1


#: How files of each kind begin, and who reads on.
KINDS = {"png": (b"\x89PNG\r\n\x1a\n", _png), "jpeg": (b"\xff\xd8\xff", _jpeg), "bmp": (b"BM", _bmp), "gif": (b"GIF8", _gif)}


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image as it is meant to be seen: 2 and 4 are mirrored, 3 turned upside down, 5 to 8 have rows for columns."""
    if orientation >= 5:
        image = image.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return image
