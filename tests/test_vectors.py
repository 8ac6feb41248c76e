import random

from conftest import rows

from siftworks.operators import vectors


def data(n=60):
    r = random.Random(3)
    return [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)], i % 2) for i in range(n)]


def test_pairs_equal_brute_force(spark):
    d = data()
    df = spark.createDataFrame(d + d[:5] + [(99, None, 0)], "id long, vector array<float>, group int")
    expected = sorted((a[0], b[0]) for a in d for b in d if a[0] < b[0] and a[2] == b[2] and sum(x * y for x, y in zip(a[1], b[1])) >= 2)
    assert sorted(rows(vectors.pairs_above(df, 2.0, 7), "id_a", "id_b")) == expected
    assert vectors.pairs_above(df.limit(0), 0.5).count() == 0


def test_nearest_equal_brute_force(spark):
    d = data()
    df = spark.createDataFrame([x[:2] for x in d], "id long, vector array<float>")
    got = {}
    for r in vectors.nearest(df.filter("id % 20 = 0"), df, 3, 7).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for q, v, _ in d[::20]:
        assert got[q] == sorted((i for i, *_ in d if i != q), key=lambda i: (-sum(x * y for x, y in zip(v, d[i][1])), i))[:3]
    assert vectors.nearest(df.limit(0), df).count() == 0
