"""Helpers of the training-data operators."""

import re
import time

from pyspark.sql import functions as F

from codestrata.llm.common import checkpoint

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark) -> set[str]:
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", held.mkString(" ")))


def test_checkpoint_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(KEY)
    kept = checkpoint(spark.range(20_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.count("*").alias("n")))
    deadline = time.time() + 10
    while shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert shuffle_files(spark) - before == set()
    assert spark.conf.get(KEY) == setting
    # a table that was checkpointed and one that was not can be used again and again
    wide = kept.join(kept.withColumnRenamed("n", "m"), "k")
    assert [wide.count(), checkpoint(wide).count(), wide.count(), kept.agg(F.sum("n")).first()[0]] == [7_000, 7_000, 7_000, 20_000]
