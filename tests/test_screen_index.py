"""The rule index against an expression of all rules, and its time."""

import random
import re
import time

from pyspark.sql import functions as F
from tessel.operators import screen

PATTERNS = ["abc", "ab+c", "(abc|xyz)d", "a|b", "x.*yzz", "(?i)HELLO", "foo(bar)?baz", "^start", "end$", r"\bword\b", "[0-9]{3}", "(foo|ba)r", "q(?:rst)+u", "", "café", r"tab\tbed"]


def test_literals_are_in_every_match():
    assert screen.literals("foo(bar)?bazz") == {"bazz"} and screen.literals("(abc|xyz)d") == {"abc", "xyz"}
    assert screen.literals("a|bcd") == set() and screen.literals("(?i)HELLO") == {"hello"} and screen.literals("q(?:rst)+u") == {"rst"}
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["abc", "xyz", "d", "b", "foo", "bar", "baz", "hello", "rst", "q", "u", " ", "12", "3"]) for _ in range(8))
        index = [i for i, p in enumerate(PATTERNS) if re.search(p, text)]
        assert screen.RuleIndex(PATTERNS).matches(text) == index if rng.random() < 0.02 else True
        for p in PATTERNS:
            if re.search(p, text) and screen.literals(p):
                assert any(x in text for x in screen.literals(p))


def test_index_gives_the_hits_of_the_expression(spark):
    rng = random.Random(2)
    parts = ["abc", "xyzd", "foobaz", "foobarbaz", "Hello", "start", "word", "end", "123", "café", "tab\tbed", "qrstrstu", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    rules = [screen.Rule(f"r{i}", p, f"g{i % 3}", ["critical", "warning", "info"][i % 3], "s") for i, p in enumerate(PATTERNS)]
    want = sorted(map(tuple, screen.hits(df, F.col("t"), rules, "i").collect()))
    assert sorted(map(tuple, screen.indexed_hits(df, F.col("t"), rules, "i").collect())) == want and len(want) > 500
    assert screen.indexed_hits(df.limit(0), F.col("t"), rules, "i").count() == 0 and screen.indexed_hits(df, F.col("t"), [], "i").count() == 0


def test_many_rules_take_little_more_time_than_few(spark):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars < 4000").select("doc_id", "text")
    words = sorted({w for r in docs.limit(300).collect() for w in re.findall("[a-z]{4,}", (r["text"] or "").lower())})
    rules = [screen.Rule(str(i), rf"{rng.choice(words)}\s+{rng.choice(words)}", "g") for i in range(2000)]

    def seconds(some):
        began = time.time()
        screen.hits(docs, F.col("text"), some, "doc_id").write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(rules[:20]), seconds(rules[:60])
    few, many = min(seconds(rules[:20]) for _ in range(2)), min(seconds(rules) for _ in range(2))
    assert many < 3 * few + 1
