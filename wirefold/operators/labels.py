"""Capture prefix, label lookups, display names, task projection.

The two label tables are fixed and small (140 prefixes, 26 names), so they
are always broadcast: their size does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Capture prefix, application id, traffic id.
LABEL_PREFIXES = [
    ("aim_chat_3a", 0, 0),
    ("aim_chat_3b", 0, 0),
    ("aimchat1", 0, 0),
    ("aimchat2", 0, 0),
    ("facebook_chat_4a", 2, 0),
    ("facebook_chat_4b", 2, 0),
    ("facebookchat1", 2, 0),
    ("facebookchat2", 2, 0),
    ("facebookchat3", 2, 0),
    ("gmailchat1", 4, 0),
    ("gmailchat2", 4, 0),
    ("gmailchat3", 4, 0),
    ("hangout_chat_4b", 5, 0),
    ("hangouts_chat_4a", 5, 0),
    ("icq_chat_3a", 6, 0),
    ("icq_chat_3b", 6, 0),
    ("icqchat1", 6, 0),
    ("icqchat2", 6, 0),
    ("skype_chat1a", 10, 0),
    ("skype_chat1b", 10, 0),
    ("email1a", 1, 1),
    ("email1b", 1, 1),
    ("email2a", 1, 1),
    ("email2b", 1, 1),
    ("ftps_down_1a", 3, 2),
    ("ftps_down_1b", 3, 2),
    ("ftps_up_2a", 3, 2),
    ("ftps_up_2b", 3, 2),
    ("scp1", 8, 2),
    ("scpdown1", 8, 2),
    ("scpdown2", 8, 2),
    ("scpdown3", 8, 2),
    ("scpdown4", 8, 2),
    ("scpdown5", 8, 2),
    ("scpdown6", 8, 2),
    ("scpup1", 8, 2),
    ("scpup2", 8, 2),
    ("scpup3", 8, 2),
    ("scpup5", 8, 2),
    ("scpup6", 8, 2),
    ("sftp1", 9, 2),
    ("sftp_down_3a", 9, 2),
    ("sftp_down_3b", 9, 2),
    ("sftp_up_2a", 9, 2),
    ("sftp_up_2b", 9, 2),
    ("sftpdown1", 9, 2),
    ("sftpdown2", 9, 2),
    ("sftpup1", 9, 2),
    ("skype_file1", 10, 2),
    ("skype_file2", 10, 2),
    ("skype_file3", 10, 2),
    ("skype_file4", 10, 2),
    ("skype_file5", 10, 2),
    ("skype_file6", 10, 2),
    ("skype_file7", 10, 2),
    ("skype_file8", 10, 2),
    ("netflix1", 7, 3),
    ("netflix2", 7, 3),
    ("netflix3", 7, 3),
    ("netflix4", 7, 3),
    ("spotify1", 11, 3),
    ("spotify2", 11, 3),
    ("spotify3", 11, 3),
    ("spotify4", 11, 3),
    ("vimeo1", 12, 3),
    ("vimeo2", 12, 3),
    ("vimeo3", 12, 3),
    ("vimeo4", 12, 3),
    ("youtube1", 14, 3),
    ("youtube2", 14, 3),
    ("youtube3", 14, 3),
    ("youtube4", 14, 3),
    ("youtube5", 14, 3),
    ("youtube6", 14, 3),
    ("youtubehtml5_1", 14, 3),
    ("facebook_audio1a", 2, 4),
    ("facebook_audio1b", 2, 4),
    ("facebook_audio2a", 2, 4),
    ("facebook_audio2b", 2, 4),
    ("facebook_audio3", 2, 4),
    ("facebook_audio4", 2, 4),
    ("facebook_video1a", 2, 4),
    ("facebook_video1b", 2, 4),
    ("facebook_video2a", 2, 4),
    ("facebook_video2b", 2, 4),
    ("hangouts_audio1a", 5, 4),
    ("hangouts_audio1b", 5, 4),
    ("hangouts_audio2a", 5, 4),
    ("hangouts_audio2b", 5, 4),
    ("hangouts_audio3", 5, 4),
    ("hangouts_audio4", 5, 4),
    ("hangouts_video1b", 5, 4),
    ("hangouts_video2a", 5, 4),
    ("hangouts_video2b", 5, 4),
    ("skype_audio1a", 10, 4),
    ("skype_audio1b", 10, 4),
    ("skype_audio2a", 10, 4),
    ("skype_audio2b", 10, 4),
    ("skype_audio3", 10, 4),
    ("skype_audio4", 10, 4),
    ("skype_video1a", 10, 4),
    ("skype_video1b", 10, 4),
    ("skype_video2a", 10, 4),
    ("skype_video2b", 10, 4),
    ("voipbuster1b", 13, 4),
    ("voipbuster2b", 13, 4),
    ("voipbuster3b", 13, 4),
    ("voipbuster_4a", 13, 4),
    ("voipbuster_4b", 13, 4),
    ("vpn_aim_chat1a", None, 5),
    ("vpn_aim_chat1b", None, 5),
    ("vpn_facebook_chat1a", None, 5),
    ("vpn_facebook_chat1b", None, 5),
    ("vpn_hangouts_chat1a", None, 5),
    ("vpn_hangouts_chat1b", None, 5),
    ("vpn_icq_chat1a", None, 5),
    ("vpn_icq_chat1b", None, 5),
    ("vpn_skype_chat1a", None, 5),
    ("vpn_skype_chat1b", None, 5),
    ("vpn_ftps_a", None, 6),
    ("vpn_ftps_b", None, 6),
    ("vpn_sftp_a", None, 6),
    ("vpn_sftp_b", None, 6),
    ("vpn_skype_files1a", None, 6),
    ("vpn_skype_files1b", None, 6),
    ("vpn_email2a", None, 7),
    ("vpn_email2b", None, 7),
    ("vpn_netflix_a", None, 8),
    ("vpn_spotify_a", None, 8),
    ("vpn_vimeo_a", None, 8),
    ("vpn_vimeo_b", None, 8),
    ("vpn_youtube_a", None, 8),
    ("vpn_bittorrent", None, 9),
    ("vpn_facebook_audio2", None, 10),
    ("vpn_hangouts_audio1", None, 10),
    ("vpn_hangouts_audio2", None, 10),
    ("vpn_skype_audio1", None, 10),
    ("vpn_skype_audio2", None, 10),
    ("vpn_voipbuster1a", None, 10),
    ("vpn_voipbuster1b", None, 10),
]

# Task, class id, display name.
LABEL_NAMES = [
    ("app", 0, "AIM Chat"),
    ("app", 1, "Email"),
    ("app", 2, "Facebook"),
    ("app", 3, "FTPS"),
    ("app", 4, "Gmail"),
    ("app", 5, "Hangouts"),
    ("app", 6, "ICQ"),
    ("app", 7, "Netflix"),
    ("app", 8, "SCP"),
    ("app", 9, "SFTP"),
    ("app", 10, "Skype"),
    ("app", 11, "Spotify"),
    ("app", 12, "Vimeo"),
    ("app", 13, "Voipbuster"),
    ("app", 14, "Youtube"),
    ("traffic", 0, "Chat"),
    ("traffic", 1, "Email"),
    ("traffic", 2, "File Transfer"),
    ("traffic", 3, "Streaming"),
    ("traffic", 4, "Voip"),
    ("traffic", 5, "VPN: Chat"),
    ("traffic", 6, "VPN: File Transfer"),
    ("traffic", 7, "VPN: Email"),
    ("traffic", 8, "VPN: Streaming"),
    ("traffic", 9, "VPN: Torrent"),
    ("traffic", 10, "VPN: Voip"),
]

TASKS = {"app": "app_label", "traffic": "traffic_label"}

LABEL_PREFIX_SCHEMA = T.StructType([
    T.StructField("prefix", T.StringType(), False),
    T.StructField("app_id", T.IntegerType(), True),
    T.StructField("traffic_id", T.IntegerType(), True),
])
LABEL_NAME_SCHEMA = T.StructType([
    T.StructField("task", T.StringType(), False),
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
])


def label_prefix_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABEL_PREFIXES, LABEL_PREFIX_SCHEMA)


def label_name_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABEL_NAMES, LABEL_NAME_SCHEMA)


def capture_prefix(path: str | Column = "path") -> Column:
    """L1: file name up to the first '.', lower-cased."""
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.substring_index(F.element_at(F.split(p, "/"), -1), ".", 1))


def attach_labels(df: DataFrame, path: str = "path") -> DataFrame:
    """L2 + L3: ``app_label`` / ``traffic_label`` (BIGINT, null when unmapped), one broadcast join."""
    spark = df.sparkSession
    lp = label_prefix_table(spark).select(
        "prefix", F.col("app_id").cast("bigint").alias("app_label"),
        F.col("traffic_id").cast("bigint").alias("traffic_label"))
    return (df.withColumn("_prefix", capture_prefix(path))
              .join(F.broadcast(lp), F.col("_prefix") == lp["prefix"], "left")
              .drop("_prefix", "prefix"))


def label_name(df: DataFrame, task: str, id_col: str, out: str = "label") -> DataFrame:
    """L4: id -> display name for a task (``app`` / ``traffic``); unknown id -> null."""
    if task not in TASKS:
        raise ValueError(f"task must be one of {sorted(TASKS)}, not {task!r}")
    names = label_name_table(df.sparkSession).where(F.col("task") == task).select(
        F.col("id").alias("_nid"), F.col("name").alias(out))
    return df.join(F.broadcast(names), F.col(id_col) == F.col("_nid"), "left").drop("_nid")


def task_projection(df: DataFrame, label_col: str, keep_key: tuple[str, ...] = ()) -> DataFrame:
    """Rows labelled for the task, label renamed to ``label``."""
    return df.where(F.col(label_col).isNotNull()).select(
        *keep_key, "feature", F.col(label_col).alias("label"))
