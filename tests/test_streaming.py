from pyspark.sql import functions as F

from rarefold.operators import neighbours, votes
from rarefold.streaming.scoring import scored_stream


def test_stream_scores_like_a_batch(spark, tmp_path):
    data = [(i, int(i % 5 == 0), [float(i % 7), float(i % 11)]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, y int, v array<double>")
    df.where("id < 10").coalesce(1).write.parquet(f"{tmp_path}/in")
    train = df.where("id >= 10")
    scored_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), train, f"{tmp_path}/out", f"{tmp_path}/at", once=True).awaitTermination()
    s = neighbours.sizes(train)
    want = votes.single(neighbours.class_lists(df.where("id < 10"), train, s.k_min_eff, s.k_maj), s)
    got = spark.read.parquet(f"{tmp_path}/out").select("id", "y", "frac", "y_pred")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where(F.col("frac").isNull()).count() == 0
