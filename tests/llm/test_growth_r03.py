"""Plans keep one form whatever the size of their inputs."""

import zlib

from corrobora.llm import quality_lines


def test_few_labels_are_joined_like_many(spark):
    docs = spark.createDataFrame([(i, "some words here\n" * 3) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    runs = quality_lines.labelled_runs(docs, labels)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    assert runs.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(50))
