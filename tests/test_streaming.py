import random

import pytest
from pyspark.sql import functions as F

from framelake.streaming import state as S


@pytest.fixture
def run(spark, tmp_path):
    def run(op, rows, schema, batches=3):
        """The stream of `rows` in several files through op, as collected rows."""
        src = tmp_path / "in"
        size = -(-len(rows) // batches)
        for i in range(batches):
            spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(str(src / f"b{i}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
        q = op(stream).writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table("out").collect()

    return run


def test_units_close_at_delimiters(run):
    rows = [(1, n, k, 10 * n) for n, k in enumerate("DaaDbDDc")] + [(2, n, k, 1) for n, k in enumerate("aDb")]
    got = sorted(tuple(r) for r in run(lambda s: S.unit_totals(s, "D"), rows, "stream long, n long, event_type string, bits long"))
    assert got == [(1, 1, 3, 30), (1, 2, 2, 70), (1, 3, 1, 50), (2, 0, 1, 1)]


def test_display_order(run):
    # coded order: key 0, hidden 4, hidden 2, shown 1, shown 3: 1 pulls 2 after it, 3 pulls 4
    packets = [(0, 0, True), (1, 4, False), (2, 2, False), (3, 1, True), (4, 3, True)]
    got = run(S.display_order, [(7, *p) for p in packets], "stream long, n long, hint long, shown boolean")
    assert [r.hint for r in sorted(got, key=lambda r: r.output)] == [0, 1, 2, 3, 4]


def test_reference_slots_match_the_batch_form(run):
    r = random.Random(1)
    rows = [(s, n, r.randrange(256)) for n in range(30) for s in range(3)]
    got = {(x.stream, x.n): x.slots for x in run(S.reference_slots, rows, "stream long, n long, mask int")}
    for s in range(3):
        slots = [-1] * S.SLOTS
        for n, mask in sorted((n, m) for t, n, m in rows if t == s):
            assert got[s, n] == slots
            slots = [n if mask >> k & 1 else x for k, x in enumerate(slots)]


def test_window_totals_equal_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = S.window_totals(events).agg(F.sum("n")).first()[0]
    assert rows == events.count()
