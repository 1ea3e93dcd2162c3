"""Tables bucketed by a key: joins by it leave their rows, such as texts, where they are."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from engram.session import shared_dir, shuffle_partitions


def number_for(df: DataFrame) -> int:
    """How many buckets for ``df`` by its estimated size: few for a small table, and none of more than some 64 MB."""
    dealt = max(shuffle_partitions(df.sparkSession), 8)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:  # not known
        return dealt
    return max(8, min(size >> 23, dealt), size >> 26)


def bucketed(df: DataFrame, key: str, name: str, n: int = 0) -> DataFrame:
    """``df`` written to the shared folder as a table that is bucketed by ``key``, in ``n`` buckets.

    Without ``n``, ``df`` should be dealt by the key already, to as many partitions as shuffles have.
    """
    spark = df.sparkSession
    table = f"engram_{name}_{uuid.uuid4().hex}"
    rows, n = (df.repartition(n, key), n) if n else (df, max(shuffle_partitions(spark), 8))
    rows.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").bucketBy(n, key).saveAsTable(table)
    return spark.table(table)
