"""Unit payload verdicts, unit types and report helpers on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from framelake.functions import bits as B
from framelake.operators import rules as R


@pytest.mark.parametrize(
    ("rest", "verdict"),
    [("", "empty"), ("1", "ok"), ("10000000", "ok"), ("00000000", "missing one bit"), ("10000001", "zero bit not zero")],
)
def test_trailing_bits(spark, rest, verdict):
    row = spark.range(1).select(
        B.trailing_bits(F.lit(rest)).alias("plain"),
        B.payload_tail(F.lit("0" + rest), F.lit(True), F.lit(2)).alias("extensible"),
        B.payload_tail(F.lit("1" + rest), F.lit(True), F.lit(2)).alias("extended"),
        B.payload_tail(F.lit(rest), F.lit(False), F.lit(0)).alias("nothing"),
    ).first()
    assert tuple(row) == (verdict, verdict, "extension", "ok")


@pytest.mark.parametrize(
    ("payload", "want"),
    [(b"", (0, 0, "ok")), (b"\x80", (0, 1, "ok")), (b"ab\x80\x00", (2, 2, "ok")), (b"\x00\x00", (None, None, "all zero")), (b"ab", (None, None, "trailing bits")), (b"\xa0\x00", (None, None, "trailing bits"))],
)
def test_padding(spark, payload, want):
    df = spark.createDataFrame([(payload,)], "p binary")
    assert tuple(df.select(B.padding(F.col("p")).alias("x")).select("x.*").first()) == want


def test_alignment_and_precision(spark):
    row = spark.range(1).select(B.aligned(F.lit("1010000011111111"), 3).alias("a"), B.aligned(F.lit("1010000111111111"), 3).alias("b"), B.aligned(F.lit("1111111111111111"), 8).alias("c"), *[B.lowered_precision(F.lit(v), 3).alias(f"v{k}") for k, v in enumerate((0, 4, 5, -5, 12, 13, 65536))]).first()
    assert tuple(row) == (True, False, True, 0, 0, 8, -8, 8, 16, 65536)


def test_types_are_told_apart(spark):
    rows = {r.type_code: r for r in B.unit_types(spark).collect()}
    assert len(rows) == 32 and rows[2].requires_global_layer and rows[25].type_name == "Padding" and rows[25].permits_global_layer
    assert [c for c, r in rows.items() if r.is_reserved] == [0, *range(26, 32)]
    assert all(name in B.UNIT_TYPES for own in B.UNIT_CLASSES.values() for name in own)


def test_suggestions_prefer_the_namespace(spark):
    registry = spark.createDataFrame([(f"unit/r{k:02d}",) for k in range(12)] + [("upper/a",), ("stream/b",)], "rule_id string")
    got = R.suggestions(spark.createDataFrame([("unit/x",), ("uper/x",), ("zzz",), ("stream/q",)], "asked string"), registry).collect()
    by = {}
    for r in got:
        by.setdefault(r.asked, []).append(r.rule_id)
    assert sorted(by["unit/x"]) == [f"unit/r{k:02d}" for k in range(8)] == sorted(by["uper/x"])
    assert by["stream/q"] == ["stream/b"] and "zzz" not in by


def test_drift_and_coverage(spark):
    e, r = (spark.createDataFrame([(x,) for x in ids], "rule_id string") for ids in (["a", "b", "b"], ["b", "c"]))
    assert {tuple(x) for x in R.registry_drift(e, r).collect()} == {("a", "not registered"), ("c", "never emitted")}
    files = spark.createDataFrame([("f", "1"), ("g", "2"), ("h", "3"), ("i", "4")], "path string, sha256 string")
    manifest = spark.createDataFrame([("f", "1"), ("g", "x"), ("h", "3"), ("h", "3"), ("j", "5")], "path string, sha256 string")
    assert {tuple(x) for x in R.manifest_coverage(files, manifest).collect()} == {("f", "ok"), ("g", "changed"), ("h", "listed twice"), ("i", "unlisted"), ("j", "missing")}
