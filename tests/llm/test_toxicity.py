import numpy as np
from pyspark.sql import functions as F

from rulespark.llm import queries, toxicity
from rulespark.llm.common import remainder


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = queries.op3(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    positive = sorted((r.score for r in rows if r.toxic == 1))
    negative = sorted((r.score for r in rows if r.toxic == 0))
    auc = np.searchsorted(negative, positive).sum() / (len(positive) * len(negative))
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert auc > 0.97 and right > 0.97, (auc, right)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, toxicity.training_labels(x)) for x in (labels, flipped))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_weights_are_sparse(spark, docs, sf_dir):
    weights, _ = toxicity.train(docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert 0 < np.count_nonzero(weights) < 20_000


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model, out="score")
    assert got.columns == [*odd.columns, "score"] and got.count() == odd.count()
    blank = [r.score for r in got.where("text is null or text = ''").collect()]
    assert len(set(blank)) == 1 and 0 <= blank[0] <= 1
    assert toxicity.score(empty, model).count() == 0
    weights, bias = toxicity.train(empty, labels)
    assert not weights.any() and bias == 0.0
