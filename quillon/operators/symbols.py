"""Symbols of texts as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.runtime import small_batches


#: Bytes of a text that are looked at together, and symbols that leave a task in one batch, about.
PIECE = 1 << 16


def positions(rows: DataFrame, key: str, columns: tuple[str, ...] = ("position", "symbol", "byte_position", "size", "code")) -> DataFrame:
    """Per symbol of each text (key, text): its position, its last byte's position (both from 1), its bytes and code point.

    key tells the texts apart; a text is walked in its own row, so nothing is sorted or sent. Name fewer columns to make fewer.
    """
    each = decode(rows.select(key, F.col("text").cast("binary").alias("data")), key, columns)
    kinds = {"symbol": "string", "byte_position": "long"}
    return each.select(key, *[F.col(c).cast(kinds.get(c, "int")).alias(c) for c in columns])


def _legal(data: bytes | None) -> tuple[np.ndarray, ...] | None:
    """The columns of decode() for legal UTF-8, all symbols at once; None for other bytes."""
    try:
        code = np.frombuffer((data or b"").decode().encode("utf-32-le"), np.uint32).astype(np.int32)
    except UnicodeDecodeError:
        return None
    size = 1 + (code > 0x7F).astype(np.int32) + (code > 0x7FF) + (code > 0xFFFF)
    at = np.arange(len(code), dtype=np.int32)
    return at, at + 1, np.cumsum(size, dtype=np.int32), size, code


def _any(data: bytes, begin: int = 0, until: int | None = None) -> tuple[np.ndarray, ...]:
    """The columns of decode() for any bytes from `begin` on, symbol by symbol, to the first that ends at `until` or later."""
    out: list[tuple[int, ...]] = []
    i, position, until = begin, 0, len(data) if until is None else until
    while i < until:
        size = 1 + sum(data[i] >= lead for lead in (0xC0, 0xE0, 0xF0, 0xF8, 0xFC))
        chain = data[i : i + size]
        whole = len(chain) == size
        try:
            code = ord(chain.decode()) if whole else 0
            position += whole
        except (UnicodeDecodeError, TypeError):
            code = 0
        i += len(chain)
        out.append((len(out), position, i - begin, size if whole else 0, code))
    return tuple(np.array(out, np.int32).T)


def _pieces(data: bytes) -> Iterator[dict]:
    """The columns of decode() for one text, some symbols at a time."""
    at = position = i = 0
    while i < len(data):
        end = min(i + PIECE, len(data))
        for _ in range(3):  # a piece ends before a lead byte, if it can
            end -= end < len(data) and data[end] & 0xC0 == 0x80
        found = _legal(data[i:end]) or _any(data, i, end)
        places, ends = found[1], found[2]
        until = i + int(ends[-1])
        yield {"at": at + found[0], "position": position + places, "byte_position": i + ends, "size": found[3], "code": found[4], "symbol": (ends, data[i:until])}
        at, position, i = at + len(ends), position + int(places[-1]), until


def _column(name: str, parts: list) -> pa.Array:
    if name != "symbol":
        return pa.array(np.concatenate(parts), pa.int32())
    sizes = np.concatenate([np.diff(ends, prepend=0) for ends, _ in parts])
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(d for _, d in parts))])


def decode(rows: DataFrame, key: str, columns: tuple[str, ...] = ("at", "position", "byte_position", "size", "code")) -> DataFrame:
    """Symbols of bytes that may not be UTF-8 (key, data), as positions() gives them, in order of `at`.

    A lead byte takes the bytes it announces; if they are no legal symbol the code is 0 and the symbol position stays. A
    truncated tail is one symbol of code 0 and size 0. `columns` may name fewer, and `symbol`, the bytes themselves.

    A batch that leaves a task holds about PIECE symbols, twice that at most, whatever the texts' sizes.
    """
    kind = rows.schema[key].dataType.simpleString()
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, symbols = batch.column(key), [], 0

            def flush() -> pa.RecordBatch:
                places = np.repeat([r for r, _ in held], [len(p["code"]) for _, p in held])
                made = [_column(c, [p[c] for _, p in held]) for c in columns]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(places)), *made], [key, *columns])

            for row, data in enumerate(batch.column("data")):
                for piece in _pieces(data.as_py() or b""):
                    held.append((row, piece))
                    symbols += len(piece["code"])
                    if symbols >= PIECE:
                        yield flush()
                        held, symbols = [], 0
            if held:
                yield flush()

    kinds = ", ".join(f"{c} {'binary' if c == 'symbol' else 'int'}" for c in columns)
    return rows.select(key, "data").mapInArrow(run, f"{key} {kind}, {kinds}")


def describe(rows: DataFrame, key: str) -> DataFrame:
    """Per symbol: its code in hexadecimal, its general category and its counterpart in the other case."""
    each = rows.select(key, F.posexplode(T.symbols(F.col("text"))).alias("position", "symbol"))
    other = F.when(T.is_class(F.col("symbol"), "Lu"), T.lower_symbol(F.col("symbol"))).otherwise(T.upper_symbol(F.col("symbol")))
    return each.select(key, "position", "symbol", F.hex(F.ascii("symbol")).alias("hex"), T.symbol_class(F.col("symbol")).alias("class"), other.alias("other_case"))
