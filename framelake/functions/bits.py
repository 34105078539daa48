"""Bit-level decoders as Column expressions over binary columns.

A bit string is the binary digits of a bounded prefix as text, so that fields are substrings
and everything stays in generated code.  Decoders return null where the input is too short
or the code is malformed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def byte_at(data: Column, at: int | Column) -> Column:
    """Byte value 0..255 at an offset; null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    one = F.substring(data, at + 1, F.lit(1))
    return F.when(F.octet_length(one) == 1, F.conv(F.hex(one), 16, 10).cast("int"))


def bit_string(data: Column, n_bytes: int) -> Column:
    """Digits of the first n_bytes bytes (fewer if the data ends before)."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(n_bytes - 1)), lambda i: F.when(i < F.octet_length(data), F.lpad(F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 2), 8, "0")).otherwise(""))
    return F.array_join(digits, "")


def fixed_bits(bits: Column, at: Column | int, n: int | Column) -> Column:
    """f(n): n bits from a bit offset, first bit highest."""
    at, n = (F.lit(x) if isinstance(x, int) else x for x in (at, n))
    field = F.substring(bits, at + 1, n)
    return F.when(n == 0, F.lit(0).cast("long")).when(F.length(field) == n, F.conv(field, 2, 10).cast("long"))


def signed_bits(bits: Column, at: Column | int, n: int) -> Column:
    """su(n): two's complement."""
    v = fixed_bits(bits, at, n)
    return F.when(v >= 1 << (n - 1), v - (1 << n)).otherwise(v)


def uvlc(bits: Column) -> Column:
    """(value, length) of an unsigned Exp-Golomb code at offset 0: z zeros, a one, z bits s; value s + 2^z - 1."""
    z = F.locate("1", bits) - 1
    s = fixed_bits(bits, z + 1, z)
    ok = (z >= 0) & (z < 32) & s.isNotNull()
    return F.when(ok, F.struct((s + F.call_function("shiftleft", F.lit(1).cast("long"), z) - 1).alias("value"), (2 * z + 1).alias("length")))


def svlc(bits: Column) -> Column:
    """Signed code: odd v is +half, even v is -half, half = (v + 1) >> 1."""
    v = uvlc(bits)["value"]
    half = F.shiftright(v + 1, 1)
    return F.when(v % 2 == 1, half).otherwise(-half)


def leb128(data: Column) -> Column:
    """(value, length) of a LEB128 number at offset 0; null if it is unended in 8 bytes or needs over 32 bits."""
    at = F.sequence(F.lit(0), F.lit(7))
    step = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("length"), F.lit(False).alias("done"), F.lit(False).alias("bad"))

    def read(s: Column, i: Column) -> Column:
        b = byte_at(data, i)
        value = s.value + F.call_function("shiftleft", (b.bitwiseAND(127)).cast("long"), 7 * i)
        more = F.struct(value.alias("value"), (i + 1).alias("length"), (b < 128).alias("done"), s.bad.alias("bad"))
        short = F.struct(s.value.alias("value"), s.length.alias("length"), F.lit(False).alias("done"), F.lit(True).alias("bad"))
        return F.when(s.done | s.bad, s).when(b.isNull(), short).otherwise(more)

    out = F.aggregate(at, step, read)
    return F.when(out.done & ~out.bad & (out.value < 1 << 32), F.struct(out.value.alias("value"), out.length.alias("length")))


def ns(value: Column, n: int) -> Column:
    """Value of a non-symmetric code read from the low bits of an integer: w-1 bits v, and one more if v >= 2^w - n."""
    w = n.bit_length()
    m = (1 << w) - n
    v = F.shiftright(value, 1) % (1 << (w - 1))
    return F.when(v < m, v).otherwise(v * 2 - m + value % 2)


def rice(bits: Column, n: int) -> Column:
    """rg(n): q ones, a zero, n bits r; value q * 2^n + r."""
    q = F.locate("0", bits) - 1
    r = fixed_bits(bits, q + 1, n)
    return F.when((q >= 0) & (q < 32) & r.isNotNull(), q.cast("long") * (1 << n) + r)


def obu_header(first: Column, second: Column, globals_: list[int]) -> Column:
    """Fields of a unit header from its first two bytes."""
    ext = F.shiftright(first, 7) == 1
    kind = F.shiftright(first, 2).bitwiseAND(31)
    return F.struct(
        ext.alias("has_extension"),
        kind.alias("type_code"),
        first.bitwiseAND(3).alias("temporal_layer"),
        F.when(ext, F.shiftright(second, 5)).otherwise(0).alias("embedded_layer"),
        F.when(ext, second.bitwiseAND(31)).when(kind.isin(globals_), 31).otherwise(0).alias("extended_layer"),
        F.when(ext, 2).otherwise(1).alias("header_bytes"),
    )


def round2(x: Column, n: int) -> Column:
    """Rounding shift; negative values round with the arithmetic shift."""
    return x if n == 0 else F.shiftright(x + (1 << (n - 1)), n)


def clip3(low, high, x: Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(lit(high), x))


def relative_distance(a: Column, b: Column, restricted: int = -1) -> Column:
    """Order distance in -127..127; the restricted value is farther than any other."""
    return F.when((a == restricted) & (b == restricted), 0).when(a == restricted, 127).when(b == restricted, -127).otherwise(clip3(-127, 127, a - b))


#: Unit types by their 5-bit code; further codes are reserved.
UNIT_TYPES = [
    "Reserved0", "SequenceHeader", "TemporalDelimiter", "MultiFrameHeader", "ClosedLoopKey", "OpenLoopKey", "LeadingTileGroup", "RegularTileGroup", "MetadataShort",
    "MetadataGroup", "Switch", "LeadingSef", "RegularSef", "LeadingTip", "RegularTip", "BufferRemovalTiming", "LayerConfigurationRecord", "AtlasSegment",
    "OperatingPointSet", "BridgeFrame", "Msdo", "RasFrame", "QuantizationMatrix", "FilmGrain", "ContentInterpretation", "Padding",
]
#: Classes of unit types.
UNIT_CLASSES = {
    "is_tile_group": ["ClosedLoopKey", "OpenLoopKey", "LeadingTileGroup", "RegularTileGroup", "Switch", "RasFrame"],
    "is_extensible": ["SequenceHeader", "MultiFrameHeader", "LayerConfigurationRecord", "AtlasSegment", "OperatingPointSet", "ContentInterpretation"],
    "is_tip_frame": ["LeadingTip", "RegularTip"],
    "is_sef": ["LeadingSef", "RegularSef"],
    "is_regular_frame": ["OpenLoopKey", "RegularTileGroup", "Switch", "RegularSef", "RegularTip", "BridgeFrame", "RasFrame"],
    "requires_global_layer": ["TemporalDelimiter", "Msdo"],
    "permits_global_layer": ["TemporalDelimiter", "MetadataShort", "MetadataGroup", "BufferRemovalTiming", "LayerConfigurationRecord", "AtlasSegment", "OperatingPointSet", "Msdo", "Padding"],
    "requires_base_layers": ["SequenceHeader", "TemporalDelimiter", "LayerConfigurationRecord", "AtlasSegment", "OperatingPointSet"],
}


#: Codes of the types that carry the global layer where a header names none.
GLOBAL_TYPES = sorted(UNIT_TYPES.index(name) for name in UNIT_CLASSES["requires_global_layer"])


def unit_types(spark):
    """A row for each 5-bit code: its name and classes (a table of 32 rows, to be broadcast)."""
    rows = []
    for code in range(32):
        name = UNIT_TYPES[code] if code < len(UNIT_TYPES) else f"Reserved{code}"
        rows.append((code, name, name.startswith("Reserved"), *(name in own for own in UNIT_CLASSES.values())))
    return spark.createDataFrame(rows, "type_code int, type_name string, is_reserved boolean, " + ", ".join(f"{c} boolean" for c in UNIT_CLASSES))


def aligned(bits: Column, at: Column | int) -> Column:
    """Whether the bits from a position up to the next byte are zero."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.locate("1", F.substring(bits, at + 1, F.pmod(-at, F.lit(8)))) == 0


def trailing_bits(rest: Column) -> Column:
    """Verdict on the bits that end a payload: a one, then zeros."""
    return F.when(F.length(rest) == 0, "empty").when(~F.startswith(rest, F.lit("1")), "missing one bit").when(F.locate("1", F.substring(rest, F.lit(2), F.length(rest))) > 0, "zero bit not zero").otherwise("ok")


def payload_tail(rest: Column, extensible: Column, payload_bytes: Column) -> Column:
    """Verdict on what is left of a payload: an extension flag of zero where the type has one, then trailing bits; an empty payload has none."""
    after = F.when(extensible, F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
    return F.when(payload_bytes == 0, "ok").when(extensible & F.startswith(rest, F.lit("1")), "extension").otherwise(trailing_bits(after))


def padding(payload: Column) -> Column:
    """(padding_bytes, trailing_bytes, verdict): trailing bits begin with the last byte that isn't zero."""
    n = F.octet_length(payload)
    kept = F.regexp_replace(F.hex(payload), "(?:00)+$", "")
    length = F.floor(F.length(kept) / 2).cast("int")
    verdict = F.when((n > 0) & (length == 0), "all zero").when((n > 0) & (F.substring(kept, -2, 2) != "80"), "trailing bits").otherwise("ok")
    ok = verdict == "ok"
    before = F.greatest(length - 1, F.lit(0))
    return F.struct(F.when(ok, before).alias("padding_bytes"), F.when(ok, n - before).alias("trailing_bytes"), verdict.alias("verdict"))


def log2_q8(x: Column) -> Column:
    """log2 in 256ths, rounded."""
    return F.floor(F.log2(x.cast("double")) * 256 + 0.5).cast("int")


def lowered_precision(v: Column, precision: int, limited: bool = True) -> Column:
    """A vector component (eighths of a sample) rounded to a precision of 0 to 6, halves towards zero; if limited, what was rounded is kept within 16 bits and a sign."""
    if precision >= 6:
        return v
    n = 6 - precision
    size = F.abs(v)
    whole = F.shiftleft(F.shiftright(size - 1 + (1 << n >> 1), n), n)
    out = F.when(v >= 0, whole).otherwise(-whole)
    if not limited:
        return out
    limit = (1 << 16) - (1 << n)
    return F.when(whole != size, clip3(-limit, limit, out)).otherwise(out)
