"""Header tables against payloads that a plain writer makes, and against payloads made by hand."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from framelake.functions import headers as H
from framelake.functions.bits import UNIT_TYPES
from framelake.functions.syntax import Field, Syntax, flag
from framelake.plans.headers import duck


def f(n, w):
    return format(n, f"0{w}b") if w else ""


def uvlc(n):
    z = (n + 1).bit_length() - 1
    return "0" * z + f(n + 1, z + 1)


def ns(v, n):
    w = n.bit_length()
    m = (1 << w) - n
    return f(v, w - 1) if v < m else f(v + m, w)


def packed(bits):
    n = -(-len(bits) // 8)
    return int(bits.ljust(8 * n, "0") or "0", 2).to_bytes(n, "big") if n else b""


class Writer:
    """Chooses a value for each field that is there and writes it; expressions are evaluated by another engine."""

    def __init__(self, seed, context=None, fixed=None):
        self.r, self.db, self.fixed = random.Random(seed), duckdb.connect(), fixed or {}
        self.values, self.lists, self.bits = dict(context or {}), {}, ""

    def evaluated(self, text):
        self.values["pos"] = len(self.bits)
        plain = re.sub(r"[A-Za-z_][A-Za-z_0-9]*", lambda m: (f"({self.values[m.group()]})::bigint" if self.values[m.group()] is not None else "null::bigint") if m.group() in self.values else m.group(), duck(str(text)))
        return self.db.execute(f"select {plain}").fetchone()[0]

    def code(self, x, n):
        r = self.r
        if x.kind in ("f", "su"):
            v = self.fixed.get(x.name, r.getrandbits(n) if n else 0)
            return v - (1 << n) if x.kind == "su" and v >= 1 << (n - 1) else v, f(v, n)
        v = self.fixed.get(x.name, r.choice([0, 0, 1, 2, r.randrange(9)]))
        if x.kind == "leb":
            return v, f(v, 8)
        if x.kind == "uvlc":
            return v, uvlc(v)
        if x.kind == "ns":
            v = self.fixed.get(x.name, r.randrange(n))
            return v, ns(v, n)
        if x.kind == "rg":
            return v << n | 1, "1" * v + "0" + f(1, n)
        v = min(v, n)
        return v, "1" * v + ("0" if v < n else "")

    def write(self, syntax):
        for x in syntax.fields:
            if x.when and not self.evaluated(x.when):
                self.values[x.name] = x.absent
                continue
            n = None if x.kind == "widest" else self.evaluated(x.width)
            n = None if n is None else int(n)
            if x.kind == "let":
                self.values[x.name] = n
            elif x.kind == "widest":
                starts = self.lists[x.cap[1:]]
                total = self.evaluated(x.width)
                self.values[x.name] = max(b - a for a, b in zip(starts, [*starts[1:], total], strict=True))
            elif x.kind == "list":
                cap = self.evaluated(x.cap)
                self.lists[x.name] = [self.r.getrandbits(cap) for _ in range(n)]
                self.bits += "".join(f(v, cap) for v in self.lists[x.name])
                self.values[x.name] = n
            elif x.kind == "cover":
                cap, start, starts = self.evaluated(x.cap), 0, []
                while start < n:
                    most = min(n - start, cap)
                    size = self.r.randrange(max(1, min(most, n // 8)), most + 1)
                    self.bits += ns(size - 1, most)
                    starts.append(start)
                    start += size
                self.values[x.name], self.lists[x.name] = len(starts), starts
            else:
                for _ in range(500):
                    self.values[x.name], bits = self.code(x, n)
                    if not x.check or self.evaluated(x.check):
                        break
                self.bits += bits
            if x.check:
                assert self.evaluated(x.check), x.name
        return packed(self.bits)


#: Sizes and levels for which tiles are defined.
SENSIBLE = {"frame_width_bits_minus_1": 12, "frame_height_bits_minus_1": 11}


def sequences(n):
    out = []
    for seed in range(n):
        fixed = SENSIBLE | {"seq_level_idx": [31, 5, 0, 17, 20][seed % 5], "single_picture_header_flag": int(seed % 6 == 5), "seq_tile_info_present_flag": int(seed % 4 != 3)}
        w = Writer(seed, fixed=fixed)
        out.append((w.write(H.SEQUENCE), w))
    return out


def named(w, syntax):
    return {x.name: w.values[x.name] for x in syntax.fields if not (x.name.startswith("_") or "__" in x.name)}


def test_sequence_headers_give_what_was_written(spark):
    made = sequences(12)
    got = H.SEQUENCE.parsed(spark.createDataFrame([(k, p) for k, (p, _) in enumerate(made)], "k int, payload binary")).orderBy("k").collect()
    for row, (_, w) in zip(got, made, strict=True):
        header = row.header.asDict()
        assert row.header_error is None and row.header_bits == len(w.bits)
        assert {k: v for k, v in header.items() if not k.endswith("_starts")} == named(w, H.SEQUENCE)
        for name, starts in w.lists.items():
            assert header[f"{name}_starts"] == starts


def test_frame_headers_give_what_was_written(spark):
    rows, writers = [], []
    types = [UNIT_TYPES.index(n) for n in ("ClosedLoopKey", "OpenLoopKey", "RegularTileGroup", "Switch", "RegularSef", "BridgeFrame", "LeadingTip", "RasFrame", "RegularTileGroup")]
    for k, (_, s) in enumerate(sequences(18)):
        seq = {f"seq_{n}": v for n, v in s.values.items()}
        mfh = {"mfh_mfh_frame_width_minus_1": 99, "mfh_mfh_frame_height_minus_1": 49}
        w = Writer(100 + k, {"type_code": types[k % len(types)]} | seq | mfh, {"frame_is_inter": int(k >= 9)})
        payload = w.write(H.FRAME)
        rows.append((k, types[k % len(types)], payload, {n: v for n, v in s.values.items() if not n.startswith("_")}))
        writers.append(w)
    names = [x.name for x in H.SEQUENCE.fields if not x.name.startswith("_")]
    schema = "k int, type_code int, payload binary, seq struct<" + ", ".join(f"{n}: bigint" for n in names) + ">"
    df = spark.createDataFrame(rows, schema).withColumn("mfh", F.struct(F.lit(99).alias("mfh_frame_width_minus_1"), F.lit(49).alias("mfh_frame_height_minus_1")))
    got = H.FRAME.parsed(df).withColumn("status", H.frame_status()).orderBy("k").collect()
    for row, w in zip(got, writers, strict=True):
        header = row.header.asDict()
        assert row.header_error is None and row.header_bits == len(w.bits)
        assert {k: v for k, v in header.items() if not k.endswith("_starts")} == named(w, H.FRAME)
    assert {r.status for r in got} == {"show existing frame", "inter header begun", "through quantization"}
    assert sum(r.header.reuse_tile_info == 1 for r in got) and sum(r.header.tile_cols is not None and r.header.tile_cols > 1 for r in got)


def starts(w, axis):
    """Where tiles begin in superblocks: coded sizes, or one size and one superblock more for the first ones."""
    v = w.values
    if v[f"own_{axis}s"] is not None:
        return w.lists[f"own_{axis}s"]
    if v[f"uniform_{axis}s"] is None:
        return []
    out, at = [], 0
    for i in range(v[f"uniform_{axis}s"]):
        out.append(at)
        at += v[f"{axis}_each"] + (i < v[f"{axis}_extra"])
    return out


def test_frames_with_their_filters(spark):
    mfh_names = [x.name for x in H.MULTI_FRAME.fields]
    rows, writers = [], []
    for k, (_, s) in enumerate(sequences(10)):
        m = Writer(50 + k, fixed={"mfh_frame_width_bits_minus_1": 9, "mfh_frame_height_bits_minus_1": 9})
        m.write(H.MULTI_FRAME)
        shared = {n: m.values[n] if k % 3 else None for n in mfh_names}
        context = {f"seq_{n}": v for n, v in s.values.items()} | {f"mfh_{n}": v for n, v in shared.items()} | {"type_code": 4}
        w = Writer(200 + k, context, {"cur_mfh_id": int(k % 3 == 2 and m.values["mfh_frame_size_present_flag"] == 1), "base_q_idx": k % 2})
        w.write(H.FRAME)
        if w.values["frame_width"] is None:
            continue
        w.values["odd_start"] = int(any(x % 2 for axis in ("col", "row") for x in starts(w, axis)))
        first = len(w.bits)
        payload = w.write(H.FRAME_FILTERS)
        rows.append((len(rows), 4, payload, {n: v for n, v in s.values.items() if not n.startswith("_")}, shared, first))
        writers.append(w)
    schema = "k int, type_code int, payload binary, seq struct<" + ", ".join(f"{x.name}: bigint" for x in H.SEQUENCE.fields if not x.name.startswith("_")) + ">, mfh struct<" + ", ".join(f"{n}: bigint" for n in mfh_names) + ">, first int"
    got = H.parsed_frames(spark.createDataFrame(rows, schema)).orderBy("k").collect()
    assert len(got) == len(writers) >= 7
    for row, w in zip(got, writers, strict=True):
        assert (row.header_error, row.header_bits, row.filters_error, row.filters_bits) == (None, row.first, None, len(w.bits))
        assert row.filters.asDict() == named(w, H.FRAME_FILTERS)
    assert any(r.filters.coded_lossless for r in got) and any(r.filters.cdef_frame_enable for r in got)


def test_a_cut_payload_is_an_error_at_the_field_that_is_cut(spark):
    payload, w = sequences(1)[0]
    rows = [(n, payload[:n]) for n in range(len(payload))] + [(-1, None)]
    got = {r.n: r for r in H.SEQUENCE.parsed(spark.createDataFrame(rows, "n int, payload binary")).collect()}
    places = []
    for n, r in got.items():
        assert r.header_error.startswith("eof:") and r.header_bits <= 8 * max(n, 0)
        places.append((n, r.header_bits))
        whole = named(w, H.SEQUENCE)
        read = {k: v for k, v in r.header.asDict().items() if v is not None and not k.endswith("_starts")}
        assert read.items() <= whole.items()  # what comes before the cut is right
    assert [p for _, p in sorted(places)] == sorted(p for _, p in places)


def test_records_of_other_types(spark):
    for table in (H.MSDO, H.MULTI_FRAME, H.REMOVAL, H.CONTENT, H.TIMING_INFO, H.FILM_GRAIN, H.METADATA_SHORT, H.TILE_GROUP, H.TILE_GROUP_STRUCTURE):
        made = [Writer(seed, {"type_code": 4, "num_tiles": 1 + seed % 3, "tile_bits": 2}, {"zero_bit": 0}) for seed in range(8)]
        df = spark.createDataFrame([(k, w.write(table), 4, 1 + k % 3, 2) for k, w in enumerate(made)], "k int, payload binary, type_code int, num_tiles int, tile_bits int")
        for row, w in zip(table.parsed(df).orderBy("k").collect(), made, strict=True):
            lists = {n: row.header[f"{n}_starts"] for n in table.lists}
            assert {n: v for n, v in lists.items() if v is not None} == w.lists
            assert {n: v for n, v in row.header.asDict().items() if not n.endswith("_starts")} == named(w, table) and row.header_bits == len(w.bits)


def test_hand_made_headers(spark):
    # the smallest still picture: id 0, profile 2, single, level 5, 4:2:0 of 10 bits, 4 bits each for sizes of 16 x 9
    still = uvlc(0) + f(2, 5) + "1" + f(5, 5) + uvlc(0) + uvlc(0) + f(3, 4) + f(3, 4) + f(15, 4) + f(8, 4) + "0"
    # two layers: counts, timing, and a map in which layer 1 doesn't need layer 0
    layers = uvlc(3) + f(0, 5) + "0" + f(9, 5) + "1" + uvlc(1) + uvlc(1) + f(6, 3) + "0" + f(0, 2) + f(1, 3) + "1" + "0" + f(0, 4) + f(0, 4) + "1" + "1" + "0" + "1" + f(4, 4) + "0" + "1" + "10"
    got = H.SEQUENCE_GENERAL.parsed(spark.createDataFrame([(1, packed(still)), (2, packed(layers))], "k int, payload binary")).orderBy("k").collect()
    one, two = (r.header for r in got)
    assert [r.header_bits for r in got] == [len(still), len(layers)]
    assert (one.single_picture_header_flag, one.seq_level_idx, one.seq_tier, one.max_frame_width_minus_1, one.max_frame_height_minus_1, one.still_picture, one.monotonic_output_order_flag) == (1, 5, 0, 15, 8, 1, 1)
    assert (two.seq_header_id, two.seq_tier, two.chroma_format_idc, two.seq_lcr_id, two.max_mlayer_id, two.seq_max_mlayer_cnt_minus_1, two.seq_initial_display_delay_minus_1, two.mlayer_dependency_bits) == (3, 1, 1, 6, 1, 1, 4, 2)


def test_layer_maps(spark):
    def plain(bits, layers, present):
        digits = iter(f(bits, layers * (layers + 3) // 2))
        out = {(0, 0)}
        for c in range(1, layers + 1):
            for r in range(c, -1, -1):
                if not present or next(digits) == "1":
                    out.add((c, r))
        return out

    r = random.Random(4)
    rows = [(r.getrandbits(n * (n + 3) // 2) if n else 0, n, present) for n in range(8) for present in (0, 1)]
    got = spark.createDataFrame(rows, "bits long, layers long, present long").withColumn("m", H.layer_map(F.col("bits"), F.col("layers"), F.col("present"))).collect()
    for x in got:
        assert {(c.layer, c.reference) for c in x.m} == plain(x.bits, x.layers, x.present)


def test_dispatch_by_type(spark):
    writer = Writer(7, {"type_code": 4})
    rows = [
        (1, "Msdo", Writer(1).write(H.MSDO)),
        (2, "SequenceHeader", sequences(1)[0][0]),
        (3, "SequenceHeader", b"\x00"),
        (4, "ClosedLoopKey", writer.write(H.FRAME_PREFIX)),
        (5, "Padding", b"\x80"),
        (6, "Reserved0", b"x"),
        (7, "Msdo", None),
    ]
    df = spark.createDataFrame([(k, UNIT_TYPES.index(n), p) for k, n, p in rows] + [(8, 30, b"")], "k int, type_code int, payload binary")
    got = {r.k: r for r in H.payloads(df).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "parsed", 2: "parsed", 3: "malformed", 4: "prefix", 5: "opaque", 6: "reserved", 7: "malformed", 8: "reserved"}
    assert got[3].syntax_error == "eof:seq_header_id" and got[7].syntax_error.startswith("eof:")
    assert json.loads(got[4].fields)["cur_mfh_id"] == writer.values["cur_mfh_id"]
    assert json.loads(got[2].fields)["seq_level_idx"] == 31


def test_checks_and_malformed_codes(spark):
    table = Syntax(Field("a", "uvlc", check="a < 3"), flag("b"), Field("c", "rg", 2), Field("d", "leb"), Field("e", "cover", "70", cap="1"))
    cases = {
        uvlc(5): "range:a",
        "0" * 40: "code:a",
        "0" * 6: "eof:a",
        uvlc(1) + "1" + "1" * 32: "code:c",
        uvlc(1) + "1" + "000" + f(0xFF, 8) * 8: "code:d",
        uvlc(1) + "1" + "000" + f(0xFF, 8): "eof:d",
        uvlc(1) + "1" + "000" + f(1, 8): "range:e",
    }
    df = spark.createDataFrame([(k, packed(b)) for k, b in enumerate(cases)], "k int, payload binary")
    assert [r.header_error for r in table.parsed(df).orderBy("k").collect()] == list(cases.values())
    with pytest.raises(ValueError):
        Syntax(Field("a", "f", "b"), flag("b")).with_state(df, "s")
    with pytest.raises(ValueError):
        Syntax(flag("a"), flag("a"))
