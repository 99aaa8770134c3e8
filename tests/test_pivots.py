"""Top-k by pivots is that of all pairs, and skips blocks where vectors lie in groups."""

import numpy as np
import pytest

from cargolens.operators import pivots, vectors

SCHEMA = "vec_id long, label int, embedding array<float>"


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def same(e, q, k, min_score=None, **options):
    got = pivots.top_k_by_pivots(e, q, k, min_score, **options)
    want = rows_of(vectors.top_k_in_blocks(e, q, k, min_score))
    assert rows_of(got) == want
    return want


@pytest.mark.parametrize("min_score", [None, 0.6])
def test_odd_vectors(spark, min_score):
    rows = [(i, i % 2, [float((i * k) % 7) - 2 for k in range(1, 6)]) for i in range(60)]
    rows += [(70, 0, []), (71, 1, None), (72, 0, [0.0] * 5), (75, 1, [0.0] * 5), (78, 0, [1.0, 2.0]), (81, None, [1.0] * 5)]
    rows += [(84, 3, [0.0, 0.0]), (87, 3, [0.0, 0.0]), (90, 1, [-x for x in rows[3][2]]), (93, 1, [1e-30] * 5)]
    e = spark.createDataFrame(rows, SCHEMA)
    assert same(e, e.filter("vec_id % 3 = 0"), 4, min_score, pivots=3, block=7)


def test_repeated_rows_and_empty_tables(spark):
    e = spark.createDataFrame([(i % 20, 0, [1.0 + i % 5, float(i % 3)]) for i in range(40)], SCHEMA)
    q = e.filter("vec_id < 4").dropDuplicates(["vec_id"])
    assert same(e, q, 3, pivots=2, block=4)
    assert not same(e.limit(0), q, 3) and not same(e, q.limit(0), 3)


def test_groups_are_skipped(spark):
    g = np.random.default_rng(4)
    middle = g.standard_normal((8, 16)) * 4
    rows = [(i, 0, [float(x) for x in middle[i % 8] + g.standard_normal(16) * 0.3]) for i in range(800)]
    e = spark.createDataFrame(rows, SCHEMA)
    q = e.filter("vec_id % 20 = 0")
    assert len(same(e, q, 5)) == 200
    found = pivots.search(e, q, 5)
    assert rows_of(found.best) == rows_of(vectors.top_k(vectors.vector_scores(e, q), 5))
    total, met = (d.groupBy().sum("n").first()[0] for d in (found.blocks, found.met))
    assert total == 40 * 800 and met < total / 2
