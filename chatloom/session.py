"""Session settings and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name="chatloom", master=None, shuffle_partitions=None, conf=None):
    """A session with the settings the jobs are tuned for.

    AQE coalesces small shuffle partitions, splits skewed join partitions and turns
    a shuffled join into a broadcast join from the measured size of a side.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark, purpose):
    """A new sub-folder of the folder the cluster shares between its machines.

    The folder comes from ``spark.checkpoint.dir`` or the context's checkpoint folder;
    only a local session without one, as in tests, gets a temporary folder. On a cluster
    every machine would write to a disk of its own, so a missing folder is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = os.path.join(tempfile.gettempdir(), "chatloom-checkpoints")
    return f"{root.rstrip('/')}/chatloom/{purpose}-{uuid.uuid4().hex}"
