from pyspark.sql import functions as F

from pairloom.functions.sets import jaccard
from pairloom.functions.text import words
from pairloom.streaming.scoring import score_stream


def test_each_pair_is_scored_once(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(i, f"a b {i}", "a b c") for i in range(20)], "i int, x string, y string")
    df.limit(10).coalesce(1).write.parquet(src)
    score = lambda b: b.select("i", jaccard(words("x"), words("y")).alias("s"))
    run = lambda: score_stream(spark.readStream.schema(df.schema).parquet(src), score, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    df.where(F.col("i") >= 10).coalesce(1).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(df.limit(10).union(df.where("i >= 10")).collect()) and {r["s"] for r in got} == {0.5}
