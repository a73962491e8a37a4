"""Column expressions that the operators share. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_bytes(x: Column) -> Column:
    """Bytes of an unsigned number written in groups of seven bits."""
    out = F.lit(1)
    for n in range(1, 9):
        out = out + F.when(x >= F.lit(1 << 7 * n), 1).otherwise(0)
    return out.cast("long")


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings share at the start; 0 for a null."""
    least = F.least(F.char_length(a), F.char_length(b))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))), True)
    return F.when(a.isNull() | b.isNull() | (least == 0), 0).otherwise(F.when(differs > 0, differs - 1).otherwise(least)).cast("long")


def trimmed(line: Column) -> Column:
    """Without white space at either end, tabs and line ends included."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def lossy_text(value: Column) -> Column:
    """Bytes as text, invalid parts replaced by U+FFFD."""
    return F.make_valid_utf8(value.cast("string"))


def thousands(n: Column) -> Column:
    return F.coalesce(F.format_number(n, 0), F.lit("-"))


def uptime(seconds: Column, padded: bool = False) -> Column:
    """``1h 2m 3s``, or with two digits for minutes and seconds."""
    return F.format_string("%dh %02dm %02ds" if padded else "%dh %dm %ds", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)


def minute_label(seconds: Column) -> Column:
    """``mm:ss`` of a time in seconds."""
    return F.concat_ws(":", F.lpad(F.floor(seconds % 3600 / 60).cast("string"), 2, "0"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def record_bytes(klen: Column, vlen: Column) -> Column:
    """Size of a log record: checksum, length, op, time, both lengths, key and value."""
    return F.lit(21).cast("long") + klen + vlen


def memory_bytes(klen: Column, vlen: Column) -> Column:
    """What a new key is charged in memory: 40 bytes of overhead and 8 of time."""
    return F.lit(48).cast("long") + klen + vlen


def record_checksum(op: Column, ts: Column, key: Column, value: Column) -> Column:
    """CRC-32 over length, op and payload, numbers little-endian."""

    def little(x: Column, n: int) -> Column:
        digits = F.lpad(F.hex(x), 2 * n, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(n, 0, -1)]))

    k, v = key.cast("binary"), value.cast("binary")
    klen, vlen = F.octet_length(k).cast("long"), F.octet_length(v).cast("long")
    return F.crc32(F.concat(little(klen + vlen + 14, 2), little(op, 1), little(ts, 8), little(klen, 2), k, little(vlen, 4), v))


def digest(value: Column, part: int = 0) -> Column:
    """60 bits of a string's MD5 digest, of the first or second half: a hash that other engines have too."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1 + 16 * part, 15), 16, 10).cast("long")
