"""Null and large keys pass through every operator unchanged."""

from millrace.llm import containers, leaks, pieces, quality

BIG = 2**62 + 1


def test_keys(spark):
    text = "one two three four five six seven eight nine ten eleven twelve. "
    df = spark.createDataFrame([(BIG, text * 200, 1), (None, text * 200, 1)], "k long, t string, n int")
    keys = lambda d: {r.k for r in d.select("k").collect()}
    assert keys(quality.text_quality(df, "k", "t")) == keys(quality.text_quality(df, "k", "t", chunk=1000)) == {BIG, None}
    assert keys(pieces.text_pieces(df, "k", "t")) == {BIG, None} and keys(containers.count_tokens(df, "k", "t")) == {BIG, None}
    assert keys(containers.fill(df, "k", "n")) == {BIG, None}
    found = leaks.find_leaks(df, df.withColumnRenamed("k", "item"), "k", "t", "item", "t")
    assert {(r.k, r.item) for r in found.collect()} == {(a, b) for a in (BIG, None) for b in (BIG, None)}
