"""Top phrases against plain counting, and what they shuffle."""

import random
import re
from collections import Counter

import pytest

from lithograin.operators import text


def plain(texts, words=3, top=10):
    n = Counter()
    for line in (line for t in texts if t is not None for line in t.split("\n")):
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", line) if x]
        n.update(" ".join(w[i : i + words]) for i in range(len(w) - words + 1))
    return sorted(((p, c) for p, c in n.items() if c > 1), key=lambda x: (-x[1], x[0].encode()))[:top]


def found(spark, texts, **options):
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    return [(r.phrase, r.n) for r in text.top_phrases(docs, **options).collect()]


def shuffled_rows(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


ODD = [None, "", "\n\n", "a b", "a b c", "\ta  b\r\n c", " é b c\r\n", "é b c\né b c", "a b c a b c a b c", "z z z z", "𝄞 x y\n￮ x y", "𝄞 x y\r\r\n￮ x y\n", "one two\nthree four", "a\r\n"]


@pytest.mark.parametrize("buckets, at_first, options", [(1 << 18, 1 << 12, {}), (8, 1, {}), (8, 1, {"top": 2}), (8, 1, {"top": 0}), (1, 1, {"words": 1, "top": 100}), (8, 1, {"words": 5})])
def test_odd_texts(spark, monkeypatch, buckets, at_first, options):
    monkeypatch.setattr(text, "BUCKETS", buckets, raising=False)
    monkeypatch.setattr(text, "FIRST", at_first, raising=False)
    assert found(spark, ODD, **options) == plain(ODD, **options)


def test_no_texts(spark):
    assert found(spark, []) == found(spark, [None]) == []


def test_ties_beyond_the_first_buckets(spark, monkeypatch):
    monkeypatch.setattr(text, "FIRST", 4, raising=False)
    texts = [f"p{i:04} q r" for i in range(3000)] * 2
    assert found(spark, texts) == [(f"p{i:04} q r", 2) for i in range(10)]


def test_few_phrases_are_shuffled_as_text(spark, monkeypatch):
    monkeypatch.setattr(text, "BUCKETS", 1 << 10, raising=False)
    monkeypatch.setattr(text, "FIRST", 1 << 4, raising=False)
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(1000)) + "\n" + "\n".join(f"head {i} tail" for i in range(12)) * 40 for _ in range(100)]
    before = shuffled_rows(spark)
    assert found(spark, texts) == plain(texts)
    assert sum(n for stage, n in shuffled_rows(spark).items() if stage not in before) < 20_000  # of 100,000 different phrases
