"""Sides of images, read from the head of their bytes."""

from __future__ import annotations

import struct

#: JPEG segments that hold the frame's sides are C0 to CF but for these, and these segments have no length.
_NO_FRAME, _BARE = (0xC4, 0xC8, 0xCC), (0x01, *range(0xD0, 0xDA))


def _jpeg(image: bytes) -> tuple[int, int] | None:
    at = 2
    while image[at : at + 1] == b"\xff":
        kind = image[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind in _BARE:
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in _NO_FRAME:
            height, width = struct.unpack_from(">HH", image, at + 5)
            return width, height
        else:
            at += 2 + struct.unpack_from(">H", image, at + 2)[0]
    return None


def _webp(image: bytes) -> tuple[int, int] | None:
    kind = image[12:16]
    if kind == b"VP8X":  # three bytes each, less one
        return 1 + int.from_bytes(image[24:27], "little"), 1 + int.from_bytes(image[27:30], "little")
    if kind == b"VP8 ":
        width, height = struct.unpack_from("<HH", image, 26)
        return width & 0x3FFF, height & 0x3FFF
    if kind == b"VP8L":  # 14 bits each, less one
        bits = struct.unpack_from("<I", image, 21)[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return None


def sides(image: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP, JPEG or WebP image; none of anything else or of a head cut off."""
    try:
        if image[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack_from(">II", image, 16)
        if image[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack_from("<HH", image, 6)
        if image[:2] == b"BM":
            width, height = struct.unpack_from("<ii", image, 18)
            return abs(width), abs(height)
        if image[:4] == b"RIFF" and image[8:12] == b"WEBP":
            return _webp(image)
        return _jpeg(image) if image[:2] == b"\xff\xd8" else None
    except (struct.error, IndexError):
        return None
