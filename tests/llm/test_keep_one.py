import corpus_pipeline
from graphloom.llm import simhash


def test_one_row_of_each_group(spark):
    """Rows with a null or a repeated identifier and texts of several groups."""
    text = lambda i: " ".join(f"t{i}x{j}" for j in range(60))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (3, text(3)), (3, text(4)), (5, text(2)), (3, text(4)), (None, text(1) + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(None, {text(0)}), (None, {text(1), text(1) + " end"}), (5, {text(2)}), (3, {text(3)}), (3, {text(4)})]
    for left in (corpus_pipeline.near_dedup(spark, df, "").collect(), simhash.drop_near_duplicates(df, shingle=3, max_distance=2).collect()):
        for doc_id, texts in want:
            assert sum(r.doc_id == doc_id and r.text in texts for r in left) >= 1
        assert len(left) <= len(want) + 1
    assert len(corpus_pipeline.near_dedup(spark, df, "").collect()) == len(want)
