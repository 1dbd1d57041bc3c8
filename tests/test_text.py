import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.distance import alignment_distance, deletions, maybe_within
from lodestone.functions.text import field_length, field_tokens, prefix_ngrams, prefixes, tokenize, tokenize_text

TOKENS = [
    ("", ""),
    ("!@#$%^", ""),
    ("hello, world!", "hello world"),
    ("item123 test", "item123 test"),
    ("theOffice", "the office"),
    ("TheOffice", "the office"),
    ("myAPIService", "my api service"),
    ("HTTPRequestManager", "http request manager"),
    ("performHTTPRequest", "perform http request"),
    ("state-of-the-art", "state of the art"),
    ("my_variable_name", "my variable name"),
    ("API_v1.0-beta!", "api v1 0 beta"),
    ("1Password", "1 password"),
    ("BIGAcronymThenCamel", "big acronym then camel"),
    ("word1!@#word2", "word1 word2"),
    ("myAPI1Test", "my api1 test"),
    ("İstanbul café", "istanbul caf"),
    (None, ""),
]


def test_tokenize(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "i int, t string").select("i", F.array_join(tokenize(F.col("t")), " ").alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: e for i, (_, e) in enumerate(TOKENS)}
    assert all(" ".join(tokenize_text(t)) == e for t, e in TOKENS if t is not None)


@pytest.mark.parametrize(("text", "expected"), [("cat dog", "cat c ca dog d do"), ("api-v1", "api a ap v1 v"), ("test test", "test t te tes"), ("tester testing", "tester t te tes test teste testing testi testin"), ("", "")])
def test_prefix_ngrams(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(F.array_join(prefix_ngrams(F.col("t")), " ")).first()[0] == expected


def test_prefixes(spark):
    assert spark.createDataFrame([("cat",), ("",)], "t string").select(prefixes(F.col("t"))).collect() == [(["c", "ca", "cat"],), ([],)]


def test_fields_by_type(spark):
    df = spark.createDataFrame([("A b", ["c d", "e"], 3)], "name string, tags array<string>, n int")
    row = df.select(field_tokens(df, "name"), field_tokens(df, "tags"), field_tokens(df, "n"), field_tokens(df, "absent"), field_length(df, "tags"), field_length(df, "n")).first()
    assert list(row) == [["a", "b"], ["c", "d", "e"], [], [], 3, 0]


def plain_distance(a, b):
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            cost = a[i - 1] != b[j - 1]
            best = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + cost)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def test_distance_cases(spark):
    cases = [("abc", "abc", 2, 0), ("ab", "ba", 2, 1), ("form", "from", 2, 1), ("teh", "the", 2, 1), ("abc", "xyz", 1, 2), ("hello", "world", 2, 3), ("a", "abcd", 2, 3), ("", "", 1, 0), ("", "a", 1, 1), ("ca", "abc", 3, 3)]
    df = spark.createDataFrame([(a, b, e) for a, b, _, e in cases], "a string, b string, e int")
    for most in {m for _, _, m, _ in cases}:
        got = df.select("a", "b", alignment_distance(F.col("a"), F.col("b"), most).alias("d")).collect()
        for r, (a, b, m, e) in zip(got, cases, strict=True):
            assert m != most or r["d"] == e, (a, b)


def test_distance_against_plain(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 6))), "".join(rng.choices("abc", k=rng.randint(0, 6)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", alignment_distance(a, b).alias("d"), maybe_within(a, b, 2).alias("near"), F.arrays_overlap(deletions(a, 2), deletions(b, 2)).alias("meets")).collect():
        d = plain_distance(r["a"], r["b"])
        assert r["d"] == d
        if d <= 2:
            assert r["near"] and r["meets"]
