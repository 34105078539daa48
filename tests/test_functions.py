from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.functions import bits as B
from framelake.functions import blocks as K

slow = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def leb(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


@slow
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=8))
def test_leb128_round_trip(spark, numbers):
    n = B.leb128(F.col("b"))
    got = one(spark, [(leb(x) + b"\xff",) for x in numbers], "b binary", n["value"], n["length"])
    assert got == [(x, len(leb(x))) for x in numbers]


def test_leb128_errors(spark):
    rows = [(b"",), (b"\x80",), (b"\xff" * 9,), (leb(2**32),), (None,)]
    assert one(spark, rows, "b binary", B.leb128(F.col("b")).isNull()) == [(True,)] * 5


@slow
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=8))
def test_uvlc_round_trip(spark, numbers):
    code = ["0" * ((x + 1).bit_length() - 1) + bin(x + 1)[2:] + "0110" for x in numbers]
    u = B.uvlc(F.col("s"))
    assert one(spark, [(c,) for c in code], "s string", u["value"], u["length"]) == [(x, 2 * (x + 1).bit_length() - 1) for x in numbers]


def test_codes(spark):
    assert one(spark, [("010",), ("011",), ("1",), ("00",)], "s string", B.svlc(F.col("s"))) == [(1,), (-1,), (0,), (None,)]
    assert one(spark, [("11010",), ("0111",), ("1111",)], "s string", B.rice(F.col("s"), 2)) == [(10,), (3,), (None,)]
    assert one(spark, [("1010",), ("0101",)], "s string", B.signed_bits(F.col("s"), 0, 4), B.fixed_bits(F.col("s"), 1, 3)) == [(-6, 2), (5, 5)]


def test_header_with_and_without_extension(spark):
    h = B.obu_header(F.col("a"), F.col("b"), [2])
    got = one(spark, [(0b00001001, 0), (0b10010110, 0b01100101)], "a int, b int", h)
    assert tuple(got[0][0]) == (False, 2, 1, 0, 31, 1)
    assert tuple(got[1][0]) == (True, 5, 2, 3, 5, 2)


def test_distance_and_rounding(spark):
    got = one(spark, [(5, 300), (-1, 3), (3, -1), (-1, -1)], "a int, b int", B.relative_distance(F.col("a"), F.col("b")))
    assert got == [(-127,), (127,), (-127,), (0,)]
    assert one(spark, [(-3,), (3,)], "a int", B.round2(F.col("a"), 1)) == [(-1,), (2,)]


BLOCKS = [([0] * 64, [0] * 64), ([255] * 64, [0] * 64), (list(range(64)), list(range(63, -1, -1)))]


def test_metrics_on_hand_made_blocks(spark):
    x, y = F.col("x"), F.col("y")
    got = one(spark, BLOCKS, "x array<int>, y array<int>", K.sad(x, y), K.sse(x, y), F.round(K.psnr(K.sse(x, y), 64), 3), F.round(K.ssim(x, y), 4))
    assert got[0] == (0, 0, float("inf"), 1.0)
    assert got[1][:3] == (64 * 255, 64 * 255 * 255, 0.0)
    assert got[2][0] == 2048


def test_satd_is_the_sum_of_hadamard_coefficients(spark):
    x, y = BLOCKS[2]
    d = [a - b for a, b in zip(x, y, strict=True)]
    expected = sum(abs(sum(v * (-1) ** bin(i & k).count("1") for i, v in enumerate(d))) for k in range(64))
    assert one(spark, [(x, y)], "x array<int>, y array<int>", K.satd(F.col("x"), F.col("y"))) == [(expected,)]


def test_paeth_and_constraint(spark):
    got = one(spark, [(10, 20, 10), (10, 20, 20), (10, 30, 21)], "a int, l int, o int", K.paeth(F.col("a"), F.col("l"), F.col("o")))
    assert got == [(20,), (10,), (21,)]
    assert one(spark, [(3,), (-20,), (40,)], "d int", K.constrained(F.col("d"), 16, 5)) == [(3,), (-6,), (0,)]


def test_dct_is_the_matrix_product(spark):
    import numpy as np

    x = np.random.default_rng(1).integers(0, 256, (8, 8))
    m = np.array(K.DCT8)
    got = one(spark, [(x.ravel().tolist(),)], "x array<int>", K.dct2d(F.col("x")))[0][0]
    assert (np.array(got).reshape(8, 8) == m @ x @ m.T).all()
