"""Parts of SQL twins."""

from __future__ import annotations

# crc32 of a string in SQL: the table of remainders stands in a row of its own.
CRC_TABLE = """t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
  lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of ``text``, beside CRC_TABLE."""
    byte = f"('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT"
    folded = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))"
    return f"xor({folded}, 4294967295)"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
