import time

from pyspark.sql import functions as F

from siftwell.llm.common import Scratch


def test_no_exchanged_files_stay(spark):
    def files():
        every = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in every.mkString("\n").split("\n") if "/shuffle_" in x and x.endswith(".data")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had, conf = files(), spark.conf.get(key)
    saved = Scratch(spark).save(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")), "t")
    for _ in range(50):  # they are removed soon after
        if not files() - had:
            break
        time.sleep(0.2)
    assert not files() - had and spark.conf.get(key) == conf
    assert saved.agg(F.sum("n")).first()[0] == 5000
