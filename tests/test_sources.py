import hashlib
import struct

from pyspark.sql import functions as F

from framelake.sources import containers as C


def put(folder, name, data):
    (folder / name).write_bytes(data)
    return str(folder / name)


def ivf(frames):
    return C.ivf_file_header(16, 8, 30, 1, len(frames)) + b"".join(struct.pack("<IQ", len(p), t) + p for t, p in frames)


def test_ivf_units_and_header(spark, tmp_path):
    path = put(tmp_path, "a.ivf", ivf([(0, b"\x08abc"), (2**64 - 1, b"\x10")]))
    rows = [(r.unit_idx, r.header_offset, r.payload_offset, r.size, r.pts and int(r.pts), bytes(r.payload), r.error) for r in C.units(spark, path).orderBy("unit_idx").collect()]
    assert rows == [(0, 32, 44, 4, 0, b"\x08abc", None), (1, 48, 60, 1, 2**64 - 1, b"\x10", None)]
    h = C.files(spark, path).select(C.ivf_header(F.col("content")).alias("h"), C.sniffed(F.col("content")).alias("f")).first()
    assert (h.h.fourcc, h.h.width, h.h.height, h.h.tb_den, h.h.tb_num, h.h.frame_count, h.f) == ("AV02", 16, 8, 30, 1, 2, "ivf")


def test_errors_keep_the_prefix(spark, tmp_path):
    whole = ivf([(0, b"abcd"), (1, b"efgh")])
    cases = {"t.ivf": (whole[:-2], "ivf/frame-truncated", 2), "h.ivf": (whole[:40], "ivf/frame-header-truncated", 1), "s.ivf": (whole[:8], "ivf/header-truncated", 1), "u.av2": (b"\x02\x08\x00\x05\x08", "annexb/unit-truncated", 2), "l.av2": (b"\x01\x08\x80", "annexb/length-truncated", 2), "z.av2": (b"\x00", "annexb/empty-unit", 1)}
    for name, (data, error, n) in cases.items():
        rows = C.units(spark, put(tmp_path, name, data)).orderBy("unit_idx").collect()
        assert (len(rows), rows[-1].error) == (n, error)
        assert all(r.error is None for r in rows[:-1])
    assert C.units(spark, put(tmp_path, "e.av2", b"")).count() == 0
    big = C.units(spark, put(tmp_path, "b.ivf", whole), max_unit_bytes=3).collect()
    assert [r.error for r in big] == ["unit/too-large"]


def test_round_trip_of_records(spark, tmp_path):
    payloads = [b"\x08" + bytes([i]) * n for i, n in enumerate((0, 1, 126, 127, 128, 300, 20000))]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "n long, p binary")
    annexb = b"".join(bytes(r[1]) for r in df.select("n", C.annexb_record(F.col("p"))).orderBy("n").collect())
    records = b"".join(bytes(r[1]) for r in df.select("n", C.ivf_record(F.col("n"), F.col("p"))).orderBy("n").collect())
    for name, data in (("r.av2", annexb), ("r.ivf", C.ivf_file_header(8, 8, 30, 1) + records)):
        got = C.units(spark, put(tmp_path, name, data)).orderBy("unit_idx").collect()
        assert [bytes(r.payload) for r in got] == payloads


def test_obu_headers(spark, tmp_path):
    path = put(tmp_path, "a.av2", b"\x01\x08" + b"\x02\x96\x65" + b"\x01\x96")
    rows = C.obus(C.units(spark, path)).orderBy("unit_idx").collect()
    assert [r.header and r.header.type_code for r in rows] == [2, 5, None]
    assert rows[2].error == "obu/header-truncated"


def test_y4m_rows_and_digests(spark, tmp_path):
    y, u, v = bytes(range(16)), b"\x80" * 4, b"\x90" * 4
    frame = b"FRAME\n" + y + u + v
    path = put(tmp_path, "a.y4m", C.y4m_header_line(4, 4, 30, 1).encode() + frame * 2 + frame[:9])
    rows = C.y4m_rows(spark, path)
    assert rows.count() == 2 * (4 + 2 + 2)
    first = rows.where("frame = 1 and plane = 0 and y = 2").first()
    assert list(first.samples) == [8, 9, 10, 11]
    assert {r.digest for r in C.frame_digests(rows).collect()} == {hashlib.sha256(y + u + v).hexdigest()}
    wide = put(tmp_path, "b.y4m", C.y4m_header_line(2, 1, 30, 1, "mono", 10).encode() + b"FRAME\n" + struct.pack("<2H", 1023, 5))
    assert [list(r.samples) for r in C.y4m_rows(spark, wide).collect()] == [[1023, 5]]


def test_deep_samples_are_digested_low_byte_first(spark):
    rows = spark.createDataFrame([("p", 0, 0, 0, [1023, 5])], "path string, frame long, plane int, y int, samples array<int>")
    assert C.frame_digests(rows, 10).first().digest == hashlib.sha256(bytes([255, 3, 5, 0])).hexdigest()
    assert C.frame_digests(rows.selectExpr("path", "frame", "plane", "y", "array(7, 255) as samples")).first().digest == hashlib.sha256(bytes([7, 255])).hexdigest()
