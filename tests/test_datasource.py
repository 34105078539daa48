import os
import struct

import pytest
from pyspark.sql import functions as F

from framelake.sources import containers as C
from framelake.sources import datasource as D


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    D.register(spark)


def ivf(frames):
    return C.ivf_file_header(16, 8, 30, 1, len(frames)) + b"".join(struct.pack("<IQ", len(p), t) + p for t, p in frames)


FRAMES = [(7 * k, bytes([k % 256]) * (1 + 37 * k % 400)) for k in range(300)]
COLUMNS = "unit_idx", "header_offset", "payload_offset", "size", "pts", "payload", "error"


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("split", [1, 100, 5000, 1 << 30])
def test_ranges_give_the_units_of_the_whole_file(spark, tmp_path, split):
    (tmp_path / "a.ivf").write_bytes(ivf(FRAMES))
    (tmp_path / "_hidden").write_bytes(b"x")
    if split == 1:
        (tmp_path / "a.ivf").write_bytes(ivf(FRAMES[:3]))
    got = spark.read.format("units").option("splitBytes", split).load(str(tmp_path))
    assert rows(got) == rows(C.units(spark, str(tmp_path / "a.ivf")))
    if split == 5000:
        assert got.rdd.getNumPartitions() == -(-os.path.getsize(tmp_path / "a.ivf") // 5000)
        assert got.select(F.spark_partition_id()).distinct().count() > 5  # several tasks read one file


@pytest.mark.parametrize(
    "data",
    [b"", ivf(FRAMES[:2])[:-1], ivf(FRAMES[:2])[:40], ivf([])[:8], b"\x02\x08\x00\x05\x08", b"\x01\x08\x80", b"\x00", b"\xff" * 9, b"\x03abc" * 50],
)
def test_malformed_files_as_in_the_other_reader(spark, tmp_path, data):
    (tmp_path / "f.bin").write_bytes(data)
    got = spark.read.format("units").option("splitBytes", 16).load(str(tmp_path))
    assert rows(got) == rows(C.units(spark, str(tmp_path / "f.bin")))


def test_caps_and_fail_fast(spark, tmp_path):
    (tmp_path / "f.ivf").write_bytes(ivf([(0, b"abcd"), (1, b"x" * 99)]))
    assert [r.error for r in spark.read.format("units").option("maxUnitBytes", 50).load(str(tmp_path)).orderBy("unit_idx").collect()] == [None, "unit/too-large"]
    with pytest.raises(Exception, match="unit/too-large"):
        spark.read.format("units").option("maxUnitBytes", 50).option("failFast", "true").load(str(tmp_path)).collect()


@pytest.mark.parametrize("container", ["ivf", "annexb"])
def test_read_write_read(spark, tmp_path, container):
    df = spark.createDataFrame(FRAMES, "pts long, payload binary").repartitionByRange(4, "pts").sortWithinPartitions("pts")
    path = str(tmp_path / "out")
    df.write.format("units").option("container", container).mode("append").save(path)
    got = spark.read.format("units").load(path)
    assert sorted(bytes(r.payload) for r in got.collect()) == sorted(p for _, p in FRAMES)
    if container == "ivf":
        again = str(tmp_path / "again")
        got.select("pts", "payload").write.format("units").mode("append").save(again)
        assert sorted((int(r.pts), bytes(r.payload)) for r in spark.read.format("units").load(again).collect()) == FRAMES
    df.limit(2).write.format("units").option("container", container).mode("overwrite").save(path)
    assert spark.read.format("units").load(path).count() == 2


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.createDataFrame([(k, b"x" if k < 90 else b"") for k in range(100)], "pts long, payload binary").repartitionByRange(4, "pts")
    with pytest.raises(Exception, match="empty"):
        bad.write.format("units").option("container", "annexb").mode("append").save(path)
    assert spark.read.format("units").load(path).count() == 0
    assert not [f for _, _, fs in os.walk(path) for f in fs]


def test_stream_of_a_growing_file(spark, tmp_path):
    data, folder = ivf(FRAMES), tmp_path / "in"
    folder.mkdir()

    def run(out, check):
        q = spark.readStream.format("units").option("unitsPerBatch", 120).load(str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()

    out, check = str(tmp_path / "o"), str(tmp_path / "c")
    seen = 0
    for end in (20, 5000, 5001, len(data)):  # cut in the header and inside units
        (folder / "a.ivf").write_bytes(data[:end])
        if end == len(data):
            (folder / "b.av2").write_bytes(b"\x03abc\x02de\x05")
        for _ in range(4):
            run(out, check)
        got = spark.read.schema(C.UNIT_SCHEMA).parquet(out) if os.path.exists(out) else None
        n = got.count() if got else 0
        assert n >= seen
        seen = n
    got = spark.read.parquet(out)
    assert got.where("error is not null").count() == 0
    a = got.where(F.col("path").endswith("a.ivf"))
    assert rows(a) == rows(C.units(spark, str(folder / "a.ivf")))
    assert sorted((r.unit_idx, bytes(r.payload)) for r in got.where(F.col("path").endswith("b.av2")).collect()) == [(0, b"abc"), (1, b"de")]


def test_y4m_round_trip_and_format_change(spark, tmp_path):
    header = C.y4m_header_line(4, 2, 30, 1)
    samples = [(s, f, p, y, [(s * 50 + f * 10 + p + y + x) % 256 for x in range(4 if p == 0 else 2)]) for s in (1, 2) for f in range(3) for p in range(3) for y in range(2 if p == 0 else 1)]
    df = spark.createDataFrame(samples, "stream int, frame long, plane int, y int, samples array<int>")
    frames = D.frames_of_rows(df, header)
    D.write_y4m(frames, str(tmp_path / "y"))
    files = sorted(os.listdir(tmp_path / "y"))
    assert len(files) == 2
    got = C.y4m_rows(spark, str(tmp_path / "y"))
    stream = F.regexp_extract("path", r"/(\d)-[^/]*$", 1).cast("int")
    assert sorted(tuple(r) for r in got.select(stream, "frame", "plane", "y", "samples").collect()) == sorted(samples)
    D.write_y4m(frames, str(tmp_path / "raw"), raw=True)
    one = next(f for f in os.listdir(tmp_path / "raw") if f.startswith("1-"))
    want = b"".join(bytes(v) for s, f, p, y, v in sorted(samples) if s == 1)
    assert (tmp_path / "raw" / one).read_bytes() == want
    other = frames.withColumn("header", F.when(F.col("frame") == 2, C.y4m_header_line(8, 2, 30, 1)).otherwise(F.col("header")))
    with pytest.raises(Exception, match="another format"):
        D.write_y4m(other, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or not os.listdir(tmp_path / "bad")
