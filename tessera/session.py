"""Session settings used by tests, the bench and the examples.

Library functions never need these; they only read ``tessera.*`` settings.
The choices that matter at scale:

* AQE on, with skew-join splitting and partition coalescing.
* ``spark.sql.autoBroadcastJoinThreshold=-1``: no broadcast from *static*
  size estimates (those are guesses after filters, generators and
  aggregates).  Broadcasts then come only from (a) explicit hints placed by
  this package behind a declared-shape bound, or (b) AQE's runtime rule,
  which uses the *measured* size of a finished shuffle stage.
* ``spark.ui.enabled=false``: no web server.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session_conf(shuffle_partitions: int = 8) -> dict[str, str]:
    return {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", "8g"),
        "spark.sql.files.maxPartitionBytes": "128MB",
    }


def get_session(master: str | None = None, app: str = "tessera", shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = session_conf(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
