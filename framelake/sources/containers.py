"""Media containers as tables: IVF, length-prefixed unit streams and Y4M.

Files are read by Spark's binaryFile source, so any store that Spark reads will do; one file is
one row (2 GiB at most) and becomes a row for each unit.  Malformed input is data: units
before an error are kept and the error is the last row's `error`.

    units(spark, path)     path, unit_idx, header_offset, payload_offset, size, pts, payload, error
    obus(units)            the fields of each unit's header beside its payload
    y4m_rows(spark, path)  path, frame, plane, y, samples
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import GLOBAL_TYPES, byte_at, obu_header

UNIT_SCHEMA = "path string, unit_idx long, header_offset long, payload_offset long, size long, pts decimal(20,0), payload binary, error string"
#: A unit above this size ends the scan of its file with an error.
MAX_UNIT_BYTES = 256 << 20


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def sniffed(content: Column) -> Column:
    """`ivf` by its first four bytes, else `annexb`."""
    return F.when(F.substring(content, 1, 4) == F.lit(b"DKIF"), "ivf").otherwise("annexb")


def little_endian(content: Column, at: int, n: int) -> Column:
    """Unsigned little-endian integer of n bytes (n < 8) at a fixed offset."""
    digits = F.concat(*[F.hex(F.substring(content, at + i + 1, 1)) for i in reversed(range(n))])
    return F.when(F.octet_length(content) >= at + n, F.conv(digits, 16, 10).cast("long"))


def ivf_header(content: Column) -> Column:
    """fourcc, width, height, timebase and declared frame count of the 32-byte file header."""
    return F.struct(
        F.substring(content, 9, 4).cast("string").alias("fourcc"),
        little_endian(content, 12, 2).alias("width"),
        little_endian(content, 14, 2).alias("height"),
        little_endian(content, 16, 4).alias("tb_den"),
        little_endian(content, 20, 4).alias("tb_num"),
        little_endian(content, 24, 4).alias("frame_count"),
    )


def _ivf(data: memoryview, cap: int) -> Iterator[tuple]:
    """(header_offset, payload_offset, size, pts, payload, error)."""
    if len(data) < 32:
        yield 0, 0, len(data), None, None, "ivf/header-truncated"
        return
    at = struct.unpack_from("<H", data, 6)[0]
    while at < len(data):
        if at + 12 > len(data):
            yield at, at, len(data) - at, None, None, "ivf/frame-header-truncated"
            return
        size, pts = struct.unpack_from("<IQ", data, at)
        if size > cap or at + 12 + size > len(data):
            yield at, at + 12, size, pts, None, "unit/too-large" if size > cap else "ivf/frame-truncated"
            return
        yield at, at + 12, size, pts, bytes(data[at + 12 : at + 12 + size]), None
        at += 12 + size


def _annexb(data: memoryview, cap: int) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        size, n = 0, 0
        for n in range(8):
            if at + n >= len(data):
                yield at, at + n, 0, None, None, "annexb/length-truncated"
                return
            size |= (data[at + n] & 127) << 7 * n
            if data[at + n] < 128:
                break
        else:
            yield at, at, 0, None, None, "annexb/length-unended"
            return
        start = at + n + 1
        if size >= 1 << 32 or size > cap or start + size > len(data) or not size:
            yield at, start, size, None, None, "unit/too-large" if size > cap else "annexb/empty-unit" if not size else "annexb/unit-truncated"
            return
        yield at, start, size, None, bytes(data[start : start + size]), None
        at = start + size


def units(spark: SparkSession, path: str, max_unit_bytes: int = MAX_UNIT_BYTES, fail_fast: bool = False) -> DataFrame:
    """A row for each unit of each file below path; with fail_fast an error ends the query."""
    columns = [c.split()[0] for c in UNIT_SCHEMA.split(", ")]

    def walked(batches):
        from decimal import Decimal

        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                walk = _ivf if content[:4] == b"DKIF" else _annexb
                rows, held = [], 0
                for i, (at, start, size, pts, payload, error) in enumerate(walk(memoryview(content), max_unit_bytes)):
                    if fail_fast and error:
                        raise ValueError(f"{name}: {error} at byte {at}")
                    rows.append((name, i, at, start, size, None if pts is None else Decimal(pts), payload, error))
                    held += len(payload or b"")
                    if held > 16 << 20:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files(spark, path).mapInPandas(walked, UNIT_SCHEMA)


def obus(table: DataFrame) -> DataFrame:
    """Units with their header fields; a unit shorter than its header has `error` obu/header-truncated."""
    h = obu_header(byte_at(F.col("payload"), 0), byte_at(F.col("payload"), 1), GLOBAL_TYPES)
    parsed = table.withColumn("header", F.when(F.octet_length("payload") >= h["header_bytes"], h))
    return parsed.withColumn("error", F.coalesce("error", F.when(F.col("header").isNull(), "obu/header-truncated")))


def ivf_file_header(width: int, height: int, tb_den: int, tb_num: int, frames: int = 0, fourcc: bytes = b"AV02") -> bytes:
    return struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, fourcc, width, height, tb_den, tb_num, frames, 0)


def reversed_bytes(n: Column, width: int) -> Column:
    """Little-endian bytes of a non-negative integer."""
    digits = F.lpad(F.hex(n), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]))


def ivf_record(pts: Column, payload: Column) -> Column:
    """An IVF frame record: size, pts and payload; records of a stream in order follow the file header."""
    return F.concat(reversed_bytes(F.octet_length(payload).cast("long"), 4), reversed_bytes(pts.cast("long"), 8), payload)


def leb128_bytes(n: Column) -> Column:
    """LEB128 bytes of an integer below 2^28."""
    n = n.cast("long")
    parts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.call_function("shiftright", n, 7 * i)), lambda v: v > 0)
    one = lambda v, more: F.unhex(F.lpad(F.hex(v.bitwiseAND(127) + F.when(more, 128).otherwise(0)), 2, "0"))
    return F.when(n < 128, one(n, F.lit(False))).otherwise(F.aggregate(F.transform(parts, lambda v: one(v, v >= 128)), F.unhex(F.lit("")), lambda a, b: F.concat(a, b)))


def annexb_record(payload: Column) -> Column:
    return F.concat(leb128_bytes(F.octet_length(payload)), payload)


# ---- Y4M

#: Samples of chroma planes relative to luma, across and down.
CHROMA = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "mono": (0, 0)}


def y4m_header(line: Column) -> Column:
    """Fields of a YUV4MPEG2 header line."""
    tag = lambda t, p: F.nullif(F.regexp_extract(line, f" {t}({p})", 1), F.lit(""))
    chroma = F.coalesce(tag("C", "[^ ]+"), F.lit("420"))
    return F.struct(
        tag("W", "[0-9]+").cast("int").alias("width"),
        tag("H", "[0-9]+").cast("int").alias("height"),
        tag("F", "[0-9]+").cast("int").alias("rate_num"),
        F.nullif(F.regexp_extract(line, " F[0-9]+:([0-9]+)", 1), F.lit("")).cast("int").alias("rate_den"),
        F.coalesce(F.nullif(F.regexp_extract(chroma, "^(mono|420|422|444)", 1), F.lit("")), F.lit("420")).alias("chroma"),
        F.when(chroma.rlike("p10$|mono10$"), 10).otherwise(8).alias("bit_depth"),
    )


def y4m_rows(spark: SparkSession, path: str) -> DataFrame:
    """A row for each line of samples; a truncated last frame is left out."""
    text = F.substring_index(F.decode(F.substring("content", 1, 256), "ISO-8859-1"), "\n", 1)
    headed = files(spark, path).withColumn("line", text).withColumn("h", y4m_header(F.col("line"))).select("path", "content", F.octet_length("line").alias("skip"), "h.width", "h.height", "h.chroma", "h.bit_depth")

    def planes(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                wide = r.bit_depth > 8
                sx, sy = CHROMA[r.chroma]
                shapes = [(r.height, r.width)] + ([((r.height + sy - 1) // sy, (r.width + sx - 1) // sx)] * 2 if sx else [])
                total = sum(h * w for h, w in shapes) * (1 + wide)
                at, frame = r.skip + 1, 0
                while (end := r.content.find(b"\n", at)) >= 0 and end + 1 + total <= len(r.content):
                    at, rows = end + 1, []
                    for p, (h, w) in enumerate(shapes):
                        block = np.frombuffer(r.content, "<u2" if wide else np.uint8, h * w, at).reshape(h, w).astype(np.int32)
                        rows += [(r.path, frame, p, y, block[y]) for y in range(h)]
                        at += h * w * (1 + wide)
                    yield pd.DataFrame(rows, columns=["path", "frame", "plane", "y", "samples"])
                    frame += 1

    return headed.mapInPandas(planes, "path string, frame long, plane int, y int, samples array<int>")


def y4m_header_line(width: int, height: int, rate_num: int, rate_den: int, chroma: str = "420", bit_depth: int = 8) -> str:
    return f"YUV4MPEG2 W{width} H{height} F{rate_num}:{rate_den} Ip C{chroma}{'p10' if bit_depth > 8 else ''}\n"


def frame_digests(rows: DataFrame, bit_depth: int = 8) -> DataFrame:
    """SHA-256 of each frame's visible samples: planes in order, row by row; one byte a sample, above 8 bits two, the low one first."""
    if bit_depth > 8:
        value = lambda v: F.concat(F.lpad(F.hex(v.cast("long") % 256), 2, "0"), F.lpad(F.hex(F.shiftright(v.cast("long"), 8)), 2, "0"))
    else:
        value = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    line = F.unhex(F.array_join(F.transform("samples", value), ""))
    ordered = F.array_sort(F.collect_list(F.struct("plane", "y", F.hex(line).alias("bytes"))))
    frames = rows.groupBy("path", "frame").agg(F.transform(ordered, lambda r: r["bytes"]).alias("lines"))
    return frames.select("path", "frame", F.sha2(F.unhex(F.array_join("lines", "")), 256).alias("digest"))
