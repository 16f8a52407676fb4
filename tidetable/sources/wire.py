"""Protobuf wire format, read without generated classes."""

from __future__ import annotations

import struct


class WireError(ValueError):
    """The bytes aren't a protobuf message."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("a number is cut short")
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> dict[int, list]:
    """Field numbers to their values in order: whole numbers, or bytes (strings, messages, fixed-width values)."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size, at = varint(data, at)
            if size is None or at + size > len(data):
                raise WireError("a field is cut short")
            value, at = data[at : at + size], at + size
        out.setdefault(number, []).append(value)
    return out


def signed(value: int | None, bits: int = 64) -> int | None:
    """Two's complement of a varint (int32 and int64 fields)."""
    if value is None:
        return None
    value &= (1 << 64) - 1
    value = value - (1 << 64) if value >> 63 else value
    return value if bits == 64 else ((value + (1 << 31)) & (1 << 32) - 1) - (1 << 31)


def real(value: bytes | None) -> float | None:
    return None if value is None else struct.unpack("<f" if len(value) == 4 else "<d", value)[0]


def text(value: bytes | None) -> str | None:
    """Decoded; the empty string is null."""
    return (value.decode("utf-8", "replace") or None) if value is not None else None
