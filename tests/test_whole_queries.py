"""Catalogue queries that take every row of their input, on small hand-made tables."""

import math

import duckdb
import pytest
from oracle import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from framelake.functions import bits as B
from framelake.plans import records, streams  # noqa: F401  (these add their queries)
from framelake.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.fixture
def documents(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_slots_of_every_packet(spark, tmp_path):
    events = [(k, 1, k, "click", 1.0) for k in range(10)]
    df = spark.createDataFrame(events, "event_id long, user_id long, ts long, event_type string, value double")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.n, r.slot): r.last_n for r in QUERIES["ref_slot_state_all"](spark, str(tmp_path)).collect()}
    assert got == {(n, s): max((m for m in range(n) if m % 8 == s), default=None) for n in range(10) for s in range(8)}


def test_leb128_of_short_texts_and_long_codes(spark, documents):
    # two bytes of 128 and more to each letter
    d = documents([(1, "a", "en"), (2, "", "en"), (3, None, "en"), (4, "éé\x01", "en"), (5, "éab", "en"), (6, "éééé", "en"), (7, "ééa", "en"), (8, "é", "en")])
    got = {r.doc_id: (r.value, r.length) for r in QUERIES["leb128_decode_all"](spark, d).collect()}
    two = 0x43 + (0x29 << 7)
    none = (None, None)
    assert got == {1: (97, 1), 2: none, 3: none, 4: (two + (two << 14) + (1 << 28), 5), 5: (two + (97 << 14), 3), 6: none, 7: none, 8: none}


def test_bytes_of_whole_texts(spark, documents):
    long = "ab" * 50_000 + "é"  # the last bytes count too
    d = documents([(1, "aabb", "en"), (2, "", "en"), (3, None, "en"), (4, "aaaa", "de"), (8, long, "en"), (16, "a" * 7, "en")])
    got = {r.doc_id: (r.bits_per_byte, r.n_bytes) for r in QUERIES["symbol_cost_entropy_bytes"](spark, d).collect()}
    parts = [50_000, 50_000, 1, 1]
    assert got.keys() == {1, 4, 8, 16} and got[1] == (1.0, 4) and got[4] == (0.0, 4) and got[8][1] == 100_002
    assert got[8][0] == round(sum(-n * math.log2(n / 100_002) for n in parts) / 100_002, 6)
    got = {(r.lang, r.byte): (r.mean, r.n) for r in QUERIES["cdf_average_bytes"](spark, d).collect()}
    # documents 8 and 16 are one tile
    assert got == {("en", 97): (50_007 >> 3, 50_009), ("en", 98): (50_000 >> 3, 50_002), ("en", 0xC3): (0, 1), ("en", 0xA9): (0, 1), ("de", 97): (0, 4)}


@pytest.mark.parametrize("name", ["ref_slot_state_all", "leb128_decode_all", "symbol_cost_entropy_bytes", "cdf_average_bytes"])
def test_whole_queries_hold_the_filtered_rows(spark, sf_dir, duck, name):
    names, every = spark_rows(QUERIES[name](spark, sf_dir))
    assert (names, every) == duck_rows(duck, ORACLES[name])
    if name == "ref_slot_state_all":
        assert set(spark_rows(QUERIES["ref_slot_state"](spark, sf_dir))[1]) < set(every)


@pytest.mark.parametrize("step", [1, 10**14])
def test_records_agree_however_long_they_are_valid(spark, tmp_path, step):
    # some orders twice, some without a customer, a status or a key
    orders = [(k * step, k % 3, "FOP"[k * k % 7 % 3], f"{k * 5 % 4}-P") for k in range(60)]
    orders += [*orders[::7], (5, None, "F", "1-P"), (6, 1, None, "1-P"), (None, 1, "F", "1-P"), (7 * step, 2, "O", None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["record_agreement"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = duck_rows(c, ORACLES["record_agreement"])
    assert spark_rows(got) == want and len(want[1]) > 20
    # a version isn't copied, nor sent to the driver
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Generate", "Join", "Broadcast"))


def test_vectors_beyond_16_bits(spark, tmp_path):
    values = [0.0, 49.84, 705.04, 705.05, 705.2, 705.36, 705.37, 709.52, 1_000_000.13, -605.04, -605.21, -98_765.43, None]
    df = spark.createDataFrame([(k, k % 2, k, "view", v) for k, v in enumerate(values)], "event_id long, user_id long, ts long, event_type string, value double")
    df.write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert spark_rows(QUERIES["vector_precision"](spark, str(tmp_path))) == duck_rows(c, ORACLES["vector_precision"])
    limits = spark.range(1).select(*[B.lowered_precision(F.lit(v), p).alias(f"v{v}p{p}") for v in (70_001, -70_001) for p in (1, 5)])
    assert tuple(limits.first()) == (65_504, 65_534, -65_504, -65_534)
