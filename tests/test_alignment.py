import random

import pytest

from aliasmith.functions.alignment import ngram_alignment


def by_table(a, b, n):
    """The best alignment by the table of all prefixes, cell by cell."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    one = [("first", a[0])] * (n - 1) + list(a)
    two = [("first", b[0])] * (n - 1) + list(b)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            agree = sum(one[i - 1 + u] == two[j - 1 + u] for u in range(n))
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + agree)
    return best[-1][-1] / (n * max(len(a), len(b)))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_alignment_equals_the_table_of_prefixes(spark, n):
    rng = random.Random(n)
    texts = ["", "a", "aa", "é", "日本", "😀a", "x" * 300]
    texts += ["".join(rng.choices("abcé ", k=rng.randint(0, 14))) for _ in range(150)]
    rows = [(rng.choice(texts), rng.choice(texts)) for _ in range(600)] + [(t, t) for t in texts]
    df = spark.createDataFrame([*rows, (None, "a"), ("a", None)], "a string, b string")
    for a, b, score in df.select("a", "b", ngram_alignment(df.a, df.b, n)).collect():
        if a is None or b is None:
            assert score is None
        else:
            assert score == pytest.approx(by_table(a, b, n)), (a, b)


def test_known_values(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abc", "xyz"), ("toradol", "tegretol")], "a string, b string")
    same, apart, drugs = (r[0] for r in df.select(ngram_alignment(df.a, df.b)).collect())
    assert same == 1.0 and apart == 0.0 and drugs == by_table("toradol", "tegretol", 2)


def test_an_n_gram_needs_a_character():
    with pytest.raises(ValueError):
        ngram_alignment("a", "b", 0)
