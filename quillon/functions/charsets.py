"""Single-byte code pages decoded by lookup; a byte without a character gives code 0, as in the tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a page differs from the Python codec it is derived from.
_PAGES = {
    "cp1251": ("cp1251", {}),
    "cp1252": ("cp1252", {}),
    "cp1253": ("cp1253", {}),
    "cp866": ("cp866", {}),
    "iso-8859-1": ("iso8859-1", {}),
    "koi8-r": ("koi8-r", {}),
    "koi8-u": ("koi8-u", {}),
    "koi8-ru": ("koi8-u", {0xAE: "ў", 0xBE: "Ў"}),
    "mac-cyrillic": ("mac-cyrillic", {0xA2: "¢", 0xB6: "∂", 0xFF: "¤"}),
    "mac-ukraine": ("mac-cyrillic", {0xFF: "¤"}),
}
CHARSETS = tuple(_PAGES)


def register(charset: str, codec: str, other: dict[int, str] | None = None) -> None:
    """Add a page: a single-byte Python codec and the bytes that differ from it. A name that is taken is an error."""
    if charset in _PAGES:
        raise ValueError(f"there is a page {charset!r}")
    _PAGES[charset] = (codec, other or {})


@functools.cache
def table(charset: str) -> tuple[str, ...]:
    """The character of each byte."""
    codec, other = _PAGES[charset]

    def char(byte: int) -> str:
        try:
            return other.get(byte) or bytes([byte]).decode(codec)
        except UnicodeDecodeError:
            return "\0"

    return tuple(char(b) for b in range(256))


def decode(data: Column, charset: str) -> Column:
    """Decode binary text of one code page."""
    page = F.array(*[F.lit(c) for c in table(charset)])
    n = F.octet_length(data)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    byte = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("int")
    return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.element_at(page, byte(i) + 1)), "")).when(data.isNotNull(), F.lit(""))
