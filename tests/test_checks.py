"""Stateless checks over hand-made streams: each gives exactly the expected rules."""

import pytest
from test_headers import Writer, f, packed, sequences, uvlc

from framelake.functions import headers as H
from framelake.functions.bits import GLOBAL_TYPES, UNIT_TYPES
from framelake.operators import checks as C
from framelake.sources import containers as S


def unit(name, payload=b"", t=0, m=None, x=None):
    kind = UNIT_TYPES.index(name) if isinstance(name, str) else name
    first = (m is not None or x is not None) << 7 | kind << 2 | t
    return bytes([first]) + (bytes([(m or 0) << 5 | (x or 0)]) if first >> 7 else b"") + payload


def ended(bits, extensible=False, flag="0"):
    return packed(bits + (flag if extensible else "") + "1")


DELIMITER = unit("TemporalDelimiter")
still = uvlc(0) + f(2, 5) + "1" + f(5, 5)
GOOD_SEQUENCE = sequences(1)[0][1].bits
MSDO_BITS = f(0, 3) + f(1, 5) + f(4, 5) + "0" + "1" + (f(3, 5) + f(1, 5) + f(4, 5) + "0") * 2 + "0"
CASES = {
    "empty": ([], set()),
    "delimiter": ([DELIMITER], set()),
    "delimiter with trailing bits": ([DELIMITER + b"\x80"], set()),
    "delimiter without them": ([DELIMITER + b"\x00"], {"trailing-bits/missing-one-bit"}),
    "delimiter with more": ([DELIMITER + b"\x80\x01"], {"trailing-bits/zero-bit-not-zero"}),
    "delimiter on a layer": ([unit("TemporalDelimiter", x=3)], {"obu-header/global-xlayer-required"}),
    "global with layers": ([unit("Padding", b"\x80", t=1, m=2, x=31)], {"obu-header/global-xlayer-requires-base-layers"}),
    "global frame": ([unit("RegularTileGroup", x=31)], {"obu-header/global-xlayer-allowed-types"}),
    "base types": ([unit("OperatingPointSet", t=1)], {"obu-header/base-layer-only-types"}),
    "key on a temporal layer": ([unit("ClosedLoopKey", t=2)], {"obu-header/temporal-layer-zero-only-types"}),
    "reserved": ([unit("Reserved0", b"\x01"), unit(29)], {"obu-header/reserved-obu-type"}),
    "reserved of zeros": ([unit(30, b"\x00\x00")], {"obu-header/reserved-obu-type", "obu-reserved/all-zero-payload"}),
    "padding": ([unit("Padding", b"abc\x80"), unit("Padding")], set()),
    "bad padding": ([unit("Padding", b"\x00"), unit("Padding", b"a")], {"padding/all-zero-payload", "padding/invalid-trailing-bits"}),
    "sequence": ([unit("SequenceHeader", ended(GOOD_SEQUENCE, True))], set()),
    "extended sequence": ([unit("SequenceHeader", ended(GOOD_SEQUENCE, True, "1"))], {"obu-header/extension-flag-not-zero"}),
    "cut sequence": ([unit("SequenceHeader", packed(GOOD_SEQUENCE)[:9])], {"bitstream/parse-error"}),
    "no sequence": ([unit("SequenceHeader")], {"bitstream/parse-error"}),
    "ids": ([unit("SequenceHeader", packed(uvlc(16)))], {"sequence-header/seq-header-id-out-of-range"}),
    "chroma": ([unit("SequenceHeader", packed(still + uvlc(4)))], {"sequence-header/chroma-format-out-of-range"}),
    "depth": ([unit("SequenceHeader", packed(still + uvlc(0) + uvlc(2)))], {"sequence-header/bit-depth-out-of-range"}),
    "crop": ([unit("SequenceHeader", packed(still + uvlc(0) + uvlc(0) + f(0, 4) * 2 + "11" + "1" + uvlc(0) + uvlc(2)))], {"sequence-header/crop-right-out-of-range"}),
    "multistream": ([unit("Msdo", ended(MSDO_BITS))], set()),  # its layer is inferred
    "multistream on a layer": ([unit("Msdo", ended(MSDO_BITS), x=0)], {"obu-header/global-xlayer-required", "msdo/non-global-layer-id"}),
    "multistream faults": (
        [unit("Msdo", ended(f(3, 3) + f(6, 5) + f(4, 5) + "0" + "1" + (f(3, 5) + f(7, 5) + f(4, 5) + "0") * 5 + "0"))],
        {"msdo/too-many-streams", "msdo/profile-below-substream-max", "annex-a/profile-reserved"},
    ),
    "multi-frame": ([unit("MultiFrameHeader", ended(uvlc(16) + uvlc(15) + "000", True))], {"mfh/seq-header-id-out-of-range", "mfh/id-out-of-range"}),
    "removal": ([unit("BufferRemovalTiming", ended("0" + "0" + f(3, 4)))], set()),
    "content": (
        [unit("ContentInterpretation", ended(f(1, 2) + "0110" + "01" + uvlc(6) + f(17, 8), True))],
        {"content-interpretation/reserved-bits-nonzero", "content-interpretation/chroma-sample-position-out-of-range", "content-interpretation/aspect-ratio-idc-out-of-range"},
    ),
    "no trailing bits": ([unit("BufferRemovalTiming", packed("0" + "0" + f(3, 4) + "00"))], {"trailing-bits/missing-one-bit"}),
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("streams")
    for k, (units, _) in enumerate(CASES.values()):
        (folder / f"{k:02}.av2").write_bytes(b"".join(bytes([len(u) & 127 | 128, len(u) >> 7]) + u if len(u) > 127 else bytes([len(u)]) + u for u in units))
    (folder / "99.av2").write_bytes(b"\x01\x08\x05\x08")  # a good delimiter, then a unit cut short
    out = {}
    for r in C.validate(spark, str(folder)).collect():
        out.setdefault(int(r.path.rsplit("/", 1)[1][:2]), []).append(r)
    return out


@pytest.mark.parametrize("k", range(len(CASES)), ids=list(CASES))
def test_stream_gives_exactly_its_rules(found, k):
    assert {r.rule_id for r in found.get(k, [])} == list(CASES.values())[k][1]


def test_faults_of_the_container_and_places(found):
    assert [(r.unit_idx, r.header_offset, r.rule_id) for r in found[99]] == [(1, 2, "bitstream/parse-error")]
    at = list(CASES).index("depth")
    assert [r.bit for r in found[at]] == [len(still + uvlc(0))]
    one = [r for r in found[list(CASES).index("multistream faults")] if r.rule_id == "msdo/profile-below-substream-max"]
    assert len(one) == 5  # one for each stream above


def test_layers_of_global_types(spark):
    assert [UNIT_TYPES[c] for c in GLOBAL_TYPES] == ["TemporalDelimiter", "Msdo"]
    rows = [("x", k, 0, 0, 1, None, bytes([code << 2]), None) for k, code in enumerate((2, 3, 20))]
    table = spark.createDataFrame(rows, S.UNIT_SCHEMA)
    assert [r.header.extended_layer for r in S.obus(table).orderBy("unit_idx").collect()] == [31, 0, 31]


def test_every_table_reads_what_it_writes_without_findings(spark):
    rows = []
    for name, table in C.TABLES.items():
        extensible = name in C.UNIT_CLASSES["is_extensible"]
        for seed in range(3):
            fixed = {"num_streams_minus_2": 1, "multistream_profile_idc": 31, "reserved_2bit": 0, "chroma_sample_position_present_flag": 0, "aspect_ratio_idc": 255}
            w = Writer(seed, fixed={} if table is H.SEQUENCE else fixed)
            if table is H.SEQUENCE:
                w = sequences(seed + 1)[seed][1]
            else:
                w.write(table)
            x = 31 if name == "Msdo" else 0
            rows.append((name, UNIT_TYPES.index(name), 0, 0, x, ended(w.bits, extensible)))
    df = spark.createDataFrame(rows, "name string, type_code int, temporal_layer int, embedded_layer int, extended_layer int, payload binary")
    assert C.check_units(df, ["name"]).collect() == []
