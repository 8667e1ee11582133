"""The linear address pattern finds what the plain one finds, and reads long runs once."""

import random
import re
import time

from pyspark.sql import functions as F

from veilspan.functions import regexes as rx
from veilspan.functions import scrub, spans

PLAIN = re.compile(rx.EMAIL, re.ASCII)


def test_same_matches(spark):
    rng = random.Random(11)
    alphabets = ["ab@.", "a@.co+-%_", "x1._@- \n", "é@ab.c", "@.", "a.@com "]
    texts = ["a@b.com+x@d.com", "a@b.co.x@d.com", "...a@b.com", "-" * 70 + "a@b.com", "a@b@c.com", "_a@b.com", "a@b.com.%%x@d.org", "", "@a.com", "a@b.c1 x@y.com"]
    texts += ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 40))) for _ in range(6000)]
    texts += ["".join(rng.choice(a) for _ in range(rng.randrange(1, 30))) for a in alphabets for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = F.lit(rx.address())
    rows = df.select("t", F.regexp_extract_all("t", pattern, F.lit(0)).alias("m"), F.col("t").rlike(rx.address()).alias("any")).collect()
    for r in rows:
        want = PLAIN.findall(r.t)
        assert list(r.m) == want and r.any == bool(want), r.t


def test_long_runs(spark):
    n = 1_000_000
    for unit in ("a", ".", "a.", "a-", "x@a."):
        df = spark.createDataFrame([(unit * (n // len(unit)) + " x@y.com",)], "t string")
        df.select(F.length("t")).collect()
        start = time.time()
        row = df.select(F.size(spans.scan("t")).alias("n"), F.length(scrub.scrub_text("t")).alias("k")).first()
        assert row.n >= 1 and time.time() - start < 10, (unit, time.time() - start)


def test_prose(spark):
    """A text with one address among thousands of words costs little more than one without."""
    words = "the quick brown fox, jumps over. Lazy dogs and some other words in a line - of prose; " * 120
    df = spark.range(1500).selectExpr(f"concat(id, ' {words}', 'mail to user', id, '@example.org now. ', '{words}') AS t").repartition(8).cache()
    df.count()
    start = time.time()
    assert df.filter(F.col("t").rlike(rx.address())).count() == 1500
    assert time.time() - start < 8
