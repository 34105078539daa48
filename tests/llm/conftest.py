import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()

#: Names that the operators use inside or return, to clash with.
CLASHES = ["key", "_key", "_row", "_id", "part", "to", "h", "cell", "rest", "limit", "full", "shard", "slot", "row_no", "domain", "tokens", "epoch", "class_id", "bands", "score", "label", "size", "_domain", "host", "rule", "word", "row"]


def words(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_documents():
    """Nulls in every column, empty and very long texts, ties, repeated rows, blanks of all kinds."""
    r = random.Random(3)
    long_text = "\n".join(words(r, 40) for _ in range(500))
    base = words(r, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "src0"),
        (2, " ".join(near), "en", "src1"),
        (3, base, "de", "src2"),
        (3, base, "de", "src2"),
        (3, "other " + words(r, 30), None, "src2"),
        (4, None, "fr", None),
        (5, "", "en", "src0"),
        (None, words(r, 20), "en", "src0"),
        (None, None, None, None),
        (6, long_text, "en", "nonumber"),
        (7, "one", "en", "src1"),
        (8, " \t\n\u00a0\u2003 ", "es", "src3"),
        (9, "x" * 5000, "en", "src3"),
        (10, "Ünï\u0130 ÇÖDÉ 😀 \x00 \x1c x", "en", "src3"),
    ]
    rows += [(20 + i, words(r, 5 + i), r.choice(["en", "de"]), f"src{i % 5}") for i in range(30)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """These operators run many small jobs; two partitions are enough to cross partition bounds."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
