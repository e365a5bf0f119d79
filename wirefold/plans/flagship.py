"""The flagship question: how many packets per application yield a sample?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.functions import packet as P
from wirefold.operators import labels as L
from wirefold.sources.captures import decode_packets
from wirefold.sources.synthetic import captures_from_events


def kept_packets_per_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """captures -> packets (decode + headers) -> keep filter -> labels -> count per class."""
    kept = P.keep_packets(decode_packets(captures_from_events(spark, sf_dir)))
    labelled = L.attach_labels(kept.select("path"))
    named = L.label_name(L.label_name(labelled, "app", "app_label", "application"),
                         "traffic", "traffic_label", "traffic")
    return named.groupBy("app_label", "application", "traffic_label", "traffic").agg(
        F.count("*").alias("n_packets"), F.countDistinct("path").alias("n_captures"))
