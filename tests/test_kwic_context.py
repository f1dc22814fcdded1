"""Left contexts are whole tokens, however long these or the blanks before them are."""

import re

from verseloom.functions import text as X


def test_left_context_reaches_far_enough(spark):
    long = ["a" * 300, "b" * 700, "c" * 90]
    texts = ["x y " + " ".join(long) + " cat end", "one two" + " " * 3000 + "cat", "p q r " + "-" * 128 + " cat", "z" * 5000 + " cat", "cat", "w" * 129 + " v cat and cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for window in (1, 2, 3, 5):
        got = {(r.k, r.match_no): (r.start, r.pre) for r in X.kwic(df, ["k"], "t", "cat", window=window).collect()}
        assert len(got) == 7
        for (k, _), (at, pre) in got.items():
            starts = [m.start() for m in re.finditer(r"[\w\-']+|[^\w\s]", texts[k][:at])][-window:]
            assert pre == (texts[k][starts[0] : at].strip() if starts else "")
