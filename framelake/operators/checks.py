"""Stateless checks of units: header layers, reserved types, payload syntax and tails, with their rule ids.

    found = check_units(obus(units))       one row for each finding: keep columns, rule_id, severity, bit
    validate(spark, path)                  the same from files

Each unit's payload is read by the table of its type; a fault there becomes the finding of that field, what
follows a good read is the payload's tail (extension flag, trailing bits).  All rules are one projection
and one explode, so units are read once and nothing is shuffled.  Types without a table of fields
(layer records, atlas segments, operating points, matrices, grain, metadata) have header rules only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions.bits import UNIT_CLASSES, UNIT_TYPES, padding
from ..functions.syntax import Syntax

GLOBAL = 31
#: Types that must lie on temporal layer 0.
LAYER_ZERO = ["ClosedLoopKey", "OpenLoopKey", "Switch", "RasFrame"]
#: Rules of fields whose checks fail.
FIELD_RULES = {
    "seq_header_id": "sequence-header/seq-header-id-out-of-range",
    "chroma_format_idc": "sequence-header/chroma-format-out-of-range",
    "bit_depth_idc": "sequence-header/bit-depth-out-of-range",
    "seq_max_mlayer_cnt_minus_1": "sequence-header/seq-max-mlayer-count-out-of-range",
    "seq_cropping_win_left_offset": "sequence-header/crop-left-out-of-range",
    "seq_cropping_win_right_offset": "sequence-header/crop-right-out-of-range",
    "seq_cropping_win_top_offset": "sequence-header/crop-top-out-of-range",
    "seq_cropping_win_bottom_offset": "sequence-header/crop-bottom-out-of-range",
    "num_units_in_decoding_tick": "sequence-header/timing-num-units-zero",
    "num_units_in_display_tick": "sequence-header/timing-display-tick-zero",
    "time_scale": "sequence-header/timing-time-scale-zero",
    "num_ticks_per_picture_minus_1": "sequence-header/timing-num-ticks-per-picture-out-of-range",
    "seq_own_cols": "tile-params/tile-cols-out-of-range",
    "seq_own_rows": "tile-params/tile-rows-out-of-range",
}
TAIL_RULES = {
    "extension": "obu-header/extension-flag-not-zero",
    "empty": "trailing-bits/empty",
    "missing one bit": "trailing-bits/missing-one-bit",
    "zero bit not zero": "trailing-bits/zero-bit-not-zero",
    "cut": "bitstream/parse-error",
}
#: A fault that isn't one of the payload: sizes of tiles aren't defined for its level.
NOT_A_FAULT = "range:seq__max_width"
TABLES = {"SequenceHeader": H.SEQUENCE, "Msdo": H.MSDO, "MultiFrameHeader": H.MULTI_FRAME, "BufferRemovalTiming": H.REMOVAL, "ContentInterpretation": H.CONTENT}


def _bit(data: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(data, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (7 - at % 8).cast("int")).bitwiseAND(1)


def tail(data: Column, at: Column, extensible: Column) -> Column:
    """Verdict on what follows bit `at`: ok, extension, empty, missing one bit, zero bit not zero, or cut (no room for the flag)."""
    size = 8 * F.octet_length(data).cast("long")
    p = at + extensible.cast("long")
    byte = F.conv(F.hex(F.substring(data, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    below = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (7 - p % 8).cast("int")) - 1)
    behind = F.hex(F.substring(data, F.floor(p / 8).cast("int") + 2, F.octet_length(data)))
    return (
        F.when(size == 0, "ok")
        .when(extensible & (at >= size), "cut")
        .when(extensible & (_bit(data, at) == 1), "extension")
        .when(p >= size, "empty")
        .when(_bit(data, p) == 0, "missing one bit")
        .when((below != 0) | behind.rlike("[^0]"), "zero bit not zero")
        .otherwise("ok")
    )


def _finding(rule: Column | str, severity: str, when: Column, bit: Column | None = None) -> Column:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.when(when, F.struct(rule.alias("rule_id"), F.lit(severity).alias("severity"), (F.lit(None) if bit is None else bit).cast("long").alias("bit")))


def _one_of(kind: Column, names: list[str]) -> Column:
    return kind.isin([UNIT_TYPES.index(n) for n in names])


def header_findings(kind: Column, t: Column, m: Column, x: Column) -> list[Column]:
    """Rules on a unit's type and its temporal, embedded and extended layer."""
    reserved = (kind == 0) | (kind >= len(UNIT_TYPES))
    return [
        _finding("obu-header/global-xlayer-required", "error", _one_of(kind, UNIT_CLASSES["requires_global_layer"]) & (x != GLOBAL)),
        _finding("obu-header/global-xlayer-requires-base-layers", "error", (x == GLOBAL) & ((m != 0) | (t != 0))),
        _finding("obu-header/global-xlayer-allowed-types", "error", (x == GLOBAL) & ~_one_of(kind, UNIT_CLASSES["permits_global_layer"])),
        _finding("obu-header/base-layer-only-types", "error", _one_of(kind, UNIT_CLASSES["requires_base_layers"]) & ((t != 0) | (m != 0))),
        _finding("obu-header/temporal-layer-zero-only-types", "error", _one_of(kind, LAYER_ZERO) & (t != 0)),
        _finding("obu-header/reserved-obu-type", "info", reserved),
        _finding("msdo/non-global-layer-id", "error", _one_of(kind, ["Msdo"]) & ((t != 0) | (m != 0) | (x != GLOBAL))),
    ]


def _field_findings(header: str, kind: str) -> list[Column]:
    """Rules on the fields of a payload that could be read."""
    h = F.col(header)
    good = F.col(f"{header}_error").isNull()
    if kind == "Msdo":
        above = [_finding("msdo/profile-below-substream-max", "error", good & (h[f"sub_{k}_max_profile"] > h["multistream_profile_idc"])) for k in range(9)]
        reserved = h["multistream_profile_idc"].between(5, 30)
        return [_finding("msdo/too-many-streams", "error", good & (h["num_streams_minus_2"] > 2)), *above, _finding("annex-a/profile-reserved", "error", good & reserved)]
    if kind == "MultiFrameHeader":
        return [_finding("mfh/seq-header-id-out-of-range", "error", good & (h["mfh_seq_header_id"] > 15)), _finding("mfh/id-out-of-range", "error", good & (h["mfh_id_minus_1"] + 1 > 15))]
    if kind == "ContentInterpretation":
        position = F.greatest(h["chroma_sample_position_top"], h["chroma_sample_position_bottom"])
        aspect = h["aspect_ratio_idc"]
        return [
            _finding("content-interpretation/reserved-bits-nonzero", "warning", good & (h["reserved_2bit"] != 0)),
            _finding("content-interpretation/chroma-sample-position-out-of-range", "error", good & (position > 5)),
            _finding("content-interpretation/aspect-ratio-idc-out-of-range", "error", good & (aspect > 16) & (aspect != 255)),
        ]
    return []


def _lookup(table: dict[str, str], key: Column, otherwise: str | None = None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(F.lit(otherwise))


def check_units(units: DataFrame, keep: list[str], tables: dict[str, Syntax] | None = None) -> DataFrame:
    """keep, rule_id, severity, bit (place in the payload) of units: type_code, temporal_layer, embedded_layer, extended_layer, payload (behind the header)."""
    tables, df = TABLES if tables is None else tables, units
    kind, data = F.col("type_code"), F.coalesce(F.col("payload"), F.lit(b""))
    rules = header_findings(kind, F.col("temporal_layer"), F.col("embedded_layer"), F.col("extended_layer"))
    empty, zeros = F.octet_length(data) == 0, ~F.hex(data).rlike("[^0]")
    rules.append(_finding("obu-reserved/all-zero-payload", "error", ((kind == 0) | (kind >= len(UNIT_TYPES))) & ~empty & zeros))
    delimiter = tail(data, F.lit(0).cast("long"), F.lit(False))
    rules.append(_finding(_lookup(TAIL_RULES, delimiter), "error", _one_of(kind, ["TemporalDelimiter"]) & (delimiter != "ok"), F.lit(0)))
    pad = padding(data)["verdict"]
    rules.append(_finding(F.when(pad == "all zero", "padding/all-zero-payload").otherwise("padding/invalid-trailing-bits"), "error", _one_of(kind, ["Padding"]) & (pad != "ok")))
    for k, (name, table) in enumerate(tables.items()):
        own, header = kind == UNIT_TYPES.index(name), f"_h{k}"
        df = table.with_state(df, f"_s{k}", "payload", when=f"type_code = {UNIT_TYPES.index(name)}")
        df = df.withColumn(header, table.named(f"_s{k}")).withColumn(f"{header}_error", F.col(f"_s{k}.error")).withColumn(f"{header}_pos", F.col(f"_s{k}.pos"))
        fault, pos = F.col(f"{header}_error"), F.col(f"{header}_pos")
        field = F.when(F.startswith(fault, F.lit("range:")), F.substring_index(fault, ":", -1))
        rules.append(_finding(F.coalesce(_lookup(FIELD_RULES, field), F.lit("bitstream/parse-error")), "error", own & fault.isNotNull() & (fault != NOT_A_FAULT), pos))
        rules += [F.when(own, x) for x in _field_findings(header, name)]
        verdict = tail(data, pos, F.lit(name in UNIT_CLASSES["is_extensible"]))
        rules.append(_finding(_lookup(TAIL_RULES, verdict), "error", own & fault.isNull() & (verdict != "ok"), pos))
    hits = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(hits).alias("f")).select(*keep, "f.*")


def unit_rows(obus: DataFrame) -> DataFrame:
    """What check_units takes, from containers.obus: the payload without its header."""
    h = F.col("header")
    body = F.substring("payload", h["header_bytes"] + 1, F.octet_length("payload"))
    layers = [h[c].alias(c) for c in ("type_code", "temporal_layer", "embedded_layer", "extended_layer")]
    return obus.where(h.isNotNull()).select("path", "unit_idx", "header_offset", *layers, body.alias("payload"))


def validate(spark: SparkSession, path: str) -> DataFrame:
    """path, unit_idx, header_offset, rule_id, severity, bit of the files below path; faults of a container are findings too."""
    from ..sources.containers import obus
    from ..sources.datasource import register

    register(spark)
    units = obus(spark.read.format("units").load(path))
    keep = ["path", "unit_idx", "header_offset"]
    broken = units.where(F.col("error").isNotNull()).select(*keep, F.lit("bitstream/parse-error").alias("rule_id"), F.lit("error").alias("severity"), F.lit(None).cast("long").alias("bit"))
    return check_units(unit_rows(units), keep).unionByName(broken)
