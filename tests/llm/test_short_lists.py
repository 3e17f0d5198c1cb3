import numpy as np

from graphloom.llm import mih_search


def test_no_query_ends_short(spark):
    """Copies with the lowest identifiers, then vectors far from them and from each other."""
    rng = np.random.default_rng(4)
    copies = np.tile(rng.standard_normal(16), (250, 1))
    far = rng.standard_normal((150, 16))
    vectors = np.concatenate([copies, far])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = mih_search.search(df, lambda i: i % 10 == 0, k=5).toPandas()
    sizes = got.groupby("query_id").size()
    assert len(sizes) == 40 and (sizes == 5).all()
    assert sorted(got[got.query_id == 390]["rank"]) == [1, 2, 3, 4, 5]
