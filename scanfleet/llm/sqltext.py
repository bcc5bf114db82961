"""Pieces of DuckDB text that several check queries share."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII string, bit by bit: a byte is folded in, then eight -1 steps shift."""
    steps = f"flatten(list_transform(str_split({text}, ''), lambda ch: list_concat([CAST(ascii(ch) AS BIGINT)], list_transform(range(8), lambda z: CAST(-1 AS BIGINT)))))"
    fold = "CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)) END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda c, e: {fold}), CAST(4294967295 AS BIGINT))"
