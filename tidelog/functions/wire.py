"""Messages in their binary wire form: the protocol-buffer encoding of strings and a timestamp.

A field is its number and wire type in one byte, then a length and the content;
empty fields are left out. The layout of such bytes depends on their values
(numbers of one to ten bytes, contents inside contents), which column
expressions only express at a size that no compiler takes, so both ways run in
Arrow batches. Decoding takes fields in any order; of repeated fields the last
counts, fields of other numbers are skipped, and what is no message is
malformed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MESSAGES

_MICROS = 1_000_000


def _number(value: int) -> bytes:
    """Groups of seven bits, the lowest first; negative numbers take ten bytes."""
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _stamp(micros: int) -> bytes:
    seconds, rest = divmod(micros, _MICROS)
    return b"".join(tag + _number(v) for tag, v in ((b"\x08", seconds), (b"\x10", rest * 1000)) if v)


def encode(message: str, **fields: Column) -> Column:
    """The bytes of a message; null and empty fields are left out."""
    names = [n for n in MESSAGES[message] if n in fields]
    tags = [bytes([MESSAGES[message].index(n) + 1 << 3 | 2]) for n in names]

    def write(*columns: pa.Array) -> pa.Array:
        out = []
        for values in zip(*(c.to_pylist() for c in columns), strict=True):
            parts = []
            for tag, v in zip(tags, values, strict=True):
                if v is not None and v != "":
                    content = _stamp(v) if isinstance(v, int) else v.encode()
                    parts += [tag, _number(len(content)), content]
            out.append(b"".join(parts))
        return pa.array(out, pa.binary())

    given = [F.unix_micros(fields[n].cast("timestamp")) if n == "expires_at" else fields[n] for n in names]
    return F.arrow_udf(write, "binary")(*given)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return value, at
        if shift > 63:
            raise ValueError("number without an end")


def _parse(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and contents of the fields; raises where the bytes are no message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
            if at > len(raw):
                raise ValueError("content without an end")
        else:
            raise ValueError(f"wire type {kind}")
        yield number, value


def _time(raw: bytes) -> int:
    """Microseconds of a timestamp message."""
    parts = dict(_parse(raw))
    seconds = parts.get(1, 0)
    return (seconds - (1 << 64) if seconds >> 63 else seconds) * _MICROS + parts.get(2, 0) // 1000


def decode(message: str, value: Column) -> Column:
    """The message's fields and error (malformed, or null) of its bytes. Unset strings are empty, an unset time is null."""
    names = MESSAGES[message]
    kinds = pa.struct([*((n, pa.timestamp("us", tz="UTC") if n == "expires_at" else pa.string()) for n in names), ("error", pa.string())])

    def read(values: pa.Array) -> pa.Array:
        out = []
        for raw in values.to_pylist():
            row = {n: None if n == "expires_at" else "" for n in names} | {"error": None}
            try:
                for number, content in _parse(raw or b""):
                    if 0 < number <= len(names) and isinstance(content, bytes):
                        name = names[number - 1]
                        row[name] = _time(content) if name == "expires_at" else content.decode()
            except (ValueError, IndexError, TypeError):
                row = dict.fromkeys(names) | {"error": "malformed"}
            out.append(row)
        return pa.array(out, kinds)

    ddl = ", ".join(f"{n} {'timestamp' if n == 'expires_at' else 'string'}" for n in (*names, "error"))
    return F.arrow_udf(read, ddl)(value)
