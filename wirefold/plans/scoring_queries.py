"""Registered queries for voting, capture labels, models, sinks and the stream (E, V8-V12, S8-S12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions import packet as P
from wirefold.operators import features as FE
from wirefold.operators import metrics as M
from wirefold.operators import models as MO
from wirefold.operators import sampling as B
from wirefold.operators import scoring as SC
from wirefold.operators.labels import LABEL_NAMES
from wirefold.plans.oracle_base import byte_digest_sql, with_ev, with_kept
from wirefold.plans.registry import register
from wirefold.plans.sampling_queries import test_sql
from wirefold.session import read_table, shared_dir, wide_tasks
from wirefold.sources import captures as C
from wirefold.sources import files as FS
from wirefold.sources.synthetic import captures_from_events
from wirefold.streaming import capture_stream as ST

EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]
N_TRAFFIC = 11


def rule_predictions(packets: DataFrame) -> DataFrame:
    """A fixed stand-in scorer for SQL-checkable votes: (sport + dport) % 11 of each kept packet."""
    kept = P.keep_packets(packets)
    return kept.select("path", "packet_no",
                       ((F.col("hdr.sport") + F.col("hdr.dport")) % N_TRAFFIC).cast("int").alias("prediction"))


def _traffic_name_sql(col: str) -> str:
    return "CASE " + col + " " + " ".join(
        f"WHEN {i} THEN '{n}'" for task, i, n in LABEL_NAMES if task == "traffic") + " END"


_VOTE_CTE = """,
v AS (SELECT path, (sport + dport) % 11 AS c, count(*) AS n FROM ev WHERE NOT is_control AND NOT is_dns GROUP BY 1, 2),
r AS (SELECT path, c, sum(n) OVER (PARTITION BY path) AS n_packets,
             row_number() OVER (PARTITION BY path ORDER BY n DESC, c) AS rn FROM v),
lab AS (SELECT DISTINCT e.path, CAST(coalesce(r.n_packets, 0) AS BIGINT) AS n_packets, CAST(r.c AS INTEGER) AS prediction
        FROM ev e LEFT JOIN r ON e.path = r.path AND r.rn = 1)
"""


@register("majority_vote", f"""
WITH c AS (SELECT user_id, list_position({['click', 'error', 'purchase', 'signup', 'view']}, event_type) - 1 AS cls,
                  count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT user_id, cls, sum(n) OVER (PARTITION BY user_id) AS n_packets,
             row_number() OVER (PARTITION BY user_id ORDER BY n DESC, cls) AS rn FROM c)
SELECT user_id, CAST(n_packets AS BIGINT) AS n_packets, CAST(cls AS INTEGER) AS prediction FROM r WHERE rn = 1""")
def majority_vote(spark, sf):
    """Most frequent class per group, ties -> smallest id (events voted per user)."""
    ev = read_table(spark, sf, "events")
    cls = F.array_position(F.array(*[F.lit(c) for c in EVENT_CLASSES]), F.col("event_type")) - 1
    return SC.majority_vote(ev.select("user_id", cls.cast("int").alias("prediction")), "user_id")


@register("capture_label", with_ev(_VOTE_CTE + f"""
SELECT path, n_packets, prediction, {_traffic_name_sql('prediction')} AS label FROM lab"""))
def capture_label(spark, sf):
    """Vote + display name per capture (captures without kept packets keep a null label)."""
    caps = captures_from_events(spark, sf)
    return SC.capture_labels(caps, rule_predictions(C.decode_packets(caps)), "traffic")


@register("stream_capture_labels", with_ev(_VOTE_CTE + f"""
SELECT prefix || '.' || user_id || '.' || chunk || '.pcap' AS name, n_packets, prediction,
       {_traffic_name_sql('prediction')} AS label
FROM (SELECT DISTINCT l.path, prefix, user_id, chunk, n_packets, prediction FROM lab l JOIN ev USING (path))"""))
def stream_capture_labels(spark, sf):
    """E5 + S9: capture files labelled by a file stream per folder, in two runs sharing their checkpoints
    (the second run sees only the files added after the first) — equal to the batch labels."""
    caps = captures_from_events(spark, sf)
    folder = shared_dir(spark, "stream-in")
    out, ckpt = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-ckpt")
    first = caps.where(F.col("path").rlike("/(Email1a|netflix1)\\."))
    rest = caps.join(first.select("path"), "path", "left_anti")

    def predict(batch):
        return rule_predictions(C.decode_packets(batch))

    folders = FS.folder_count(caps)
    for part in (first, rest):
        FS.write_capture_files(part, spark, folder, folders)
        ST.label_capture_folders(spark, FS.capture_folders(spark, folder), out, ckpt, predict, "traffic")
    res = spark.read.parquet(out)
    return res.select(F.element_at(F.split("path", "/"), -1).alias("name"), "n_packets", "prediction", "label")


@register("incremental_captures", with_ev("""
SELECT DISTINCT prefix || '.' || user_id || '.' || chunk || '.pcap' AS name FROM ev WHERE prefix <> 'Email1a'"""))
def incremental_captures(spark, sf):
    """Captures still to do = all captures minus those with a done marker (an anti join);
    here the e-mail captures are marked done by an earlier run."""
    caps = captures_from_events(spark, sf).select("path")
    done_dir = shared_dir(spark, "done")
    caps.where(F.col("path").contains("/Email1a.")).write.mode("overwrite").parquet(done_dir)
    pending = FS.pending_captures(caps, spark.read.parquet(done_dir))
    return pending.select(F.element_at(F.split("path", "/"), -1).alias("name"))


_APP = "CASE lprefix WHEN 'email1a' THEN 1 WHEN 'netflix1' THEN 7 END"
_TRAFFIC = "CASE lprefix WHEN 'email1a' THEN 1 WHEN 'netflix1' THEN 3 WHEN 'vpn_email2a' THEN 7 END"


@register("sample_json_roundtrip", with_kept(f"""
SELECT CAST({_APP} AS BIGINT) AS app_label, CAST({_TRAFFIC} AS BIGINT) AS traffic_label, count(*) AS n,
       CAST(sum(bs) AS BIGINT) AS byte_sum
FROM (SELECT lprefix, byte_sum AS bs FROM (SELECT lprefix, {byte_digest_sql('fhex')} FROM kept)) GROUP BY 1, 2"""))
def sample_json_roundtrip(spark, sf):
    """S8 + S10: samples written as gzip JSON lines (<= 10000 per part), read back with a fixed schema."""
    samples = FE.preprocess(captures_from_events(spark, sf, tasks=wide_tasks(spark)), with_key=False)
    folder = FS.write_samples_json(samples, shared_dir(spark, "samples-json"))
    back = FS.read_samples_json(spark, folder)
    d = back.select("app_label", "traffic_label", P.vector_digest("feature")[2])
    return d.groupBy("app_label", "traffic_label").agg(F.count("*").alias("n"),
                                                       F.sum("byte_sum").cast("bigint").alias("byte_sum"))


@register("split_parquet_roundtrip", f"""
SELECT CASE WHEN {test_sql('o_orderkey')} THEN 'test' ELSE 'train' END AS split, o_orderstatus AS label,
       count(*) AS n, round(sum(o_totalprice), 2) AS price_sum
FROM orders GROUP BY 1, 2""")
def split_parquet_roundtrip(spark, sf):
    """S11 + S12: train/test Parquet written (overwrite, partitioned by split) and scanned back."""
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.array(F.col("o_totalprice")).alias("feature"), F.col("o_orderstatus").alias("status"))
    out = shared_dir(spark, "split-parquet")
    B.build_task_sets(o, "status", out, "o_orderkey", 0.2)
    back = FS.read_parquet(spark, out)
    return back.groupBy("split", "label").agg(F.count("*").alias("n"),
                                              F.round(F.sum(F.col("feature")[0]), 2).alias("price_sum"))


# --- models -----------------------------------------------------------------------------
# What a model predicts depends on its training; checked exactly are the features, the rows
# scored, the range of the classes, the votes, and that a stored model scores like the first.

EMBEDDING_WIDTH = 64


def _embeddings(spark, sf):
    return read_table(spark, sf, "embeddings").select(
        "vec_id", F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("feature"), "label")


def _conv_sql(model_type: str, task: str, width: int = EMBEDDING_WIDTH) -> str:
    """SQL of the preset's convolution features: the kernels' numbers, drawn from the seed, written out."""
    p = MO.preset(model_type, task)
    same = p["padding"] == "same"
    parts = []
    for i, (k, stride, w, bias) in enumerate(MO.random_kernels(p["kernels"], p["filters"])):
        n_out = -(-width // stride) if same else (width - k) // stride + 1
        left = max(0, (n_out - 1) * stride + k - width) // 2 if same else 0
        rows = ", ".join(f"({f}, {[float(x) for x in w[f]]}::DOUBLE[], {float(bias[f])!r}::DOUBLE)" for f in range(len(bias)))
        terms = " + ".join(f"w[{j + 1}] * (CASE WHEN o * {stride} + {j - left} BETWEEN 0 AND {width - 1} "
                           f"THEN x[o * {stride} + {j - left} + 1]::DOUBLE ELSE 0 END)" for j in range(k))
        y = f"(SELECT vec_id, f, {terms} + b AS y FROM e, (VALUES {rows}) AS k(f, w, b), range({n_out}) AS r(o))"
        first, second = ("avg(greatest(y, 0))", "max(greatest(y, 0))") if same else ("max(y)", "avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END)")
        parts.append(f"SELECT vec_id, f, {first} AS a, {second} AS c FROM {y} GROUP BY vec_id, f")
    return (f"WITH e AS (SELECT vec_id, embedding AS x FROM embeddings), u AS ({' UNION ALL '.join(parts)}) "
            "SELECT vec_id, CAST(2 * count(*) AS INTEGER) AS n_features, round(sum(a), 4) AS first_sum, round(sum(c), 4) AS second_sum "
            "FROM u GROUP BY vec_id")


def _conv_query(spark, sf, model_type: str, task: str):
    from pyspark.ml.functions import vector_to_array

    p = MO.preset(model_type, task)
    t = MO.RandomConvFeatures(inputCol="feature", outputCol="conv", kernelSpec=MO.flat_spec(p["kernels"]),
                              numFilters=p["filters"], padding=p["padding"], inputWidth=EMBEDDING_WIDTH)
    out = t.transform(_embeddings(spark, sf)).select("vec_id", vector_to_array("conv").alias("c"))
    half = f"int(i / {p['filters']}) % 2"
    return out.select("vec_id", F.size("c").alias("n_features"), *[
        F.round(F.expr(f"aggregate(filter(c, (x, i) -> {half} = {part}), 0D, (s, x) -> s + x)"), 4).alias(name)
        for part, name in ((0, "first_sum"), (1, "second_sum"))])


@register("cnn_features", _conv_sql("cnn", "app"))
def cnn_features(spark, sf):
    """V8: random-convolution features (max, positive share) of the cnn / app preset, all 200 filters."""
    return _conv_query(spark, sf, "cnn", "app")


@register("resnet_features", _conv_sql("resnet", "traffic"))
def resnet_features(spark, sf):
    """V9: SAME-padded random-convolution features (mean, max of ReLU) of the resnet / traffic preset."""
    return _conv_query(spark, sf, "resnet", "traffic")


def _embedding_sets(spark, sf):
    return B.train_test_split(_embeddings(spark, sf), "vec_id", "label", 0.2)


@register("train_mlp", f"SELECT vec_id, label, true AS in_range FROM embeddings WHERE {test_sql('vec_id')}")
def train_mlp(spark, sf):
    """MLP head (d-200-100-50-k) on cnn features at preset settings; one class of the data per test row."""
    train, test = _embedding_sets(spark, sf)
    model = MO.train(train, "app", "cnn", head="mlp", input_width=EMBEDDING_WIDTH)
    k = train.agg((F.max("label") + 1).alias("k"))
    scored = MO.predict(model, test, ("vec_id", "label"))
    return scored.join(F.broadcast(k), F.lit(True)).select(
        "vec_id", "label", ((F.col("prediction") >= 0) & (F.col("prediction") < F.col("k"))).alias("in_range"))


@register("model_roundtrip", f"SELECT vec_id, true AS same FROM embeddings WHERE {test_sql('vec_id')}")
def model_roundtrip(spark, sf):
    """The saved and loaded model scores every test row like the trained one."""
    train, test = _embedding_sets(spark, sf)
    model = MO.train(train, "traffic", "resnet", head="logistic", input_width=EMBEDDING_WIDTH)
    path = MO.save_model(model, shared_dir(spark, "model"))
    a = MO.predict(model, test, ("vec_id",)).withColumnRenamed("prediction", "before")
    b = MO.predict(MO.load_model(path), test, ("vec_id",)).withColumnRenamed("prediction", "after")
    return a.join(b, "vec_id").select("vec_id", (F.col("before") == F.col("after")).alias("same"))


def _packet_model(spark, sf, caps):
    """Stored task sets -> train -> save -> load, at preset filters."""
    stored = shared_dir(spark, "samples")
    FE.preprocess(caps, as_bytes=True).write.parquet(stored)
    sets = B.build_task_sets(spark.read.parquet(stored), "traffic_label", shared_dir(spark, "task-set"), ["path", "packet_no"], as_bytes=True)
    train = spark.read.parquet(sets).where("split = 'train'")
    model = MO.train(train, "traffic", "resnet", head="logistic", num_classes=N_TRAFFIC)
    return MO.load_model(MO.save_model(model, shared_dir(spark, "model"))), sets


@register("score_packets", with_kept("SELECT path, packet_no, true AS in_range FROM kept"))
def score_packets(spark, sf):
    """Every kept packet scored once by a model trained on the stored task set."""
    caps = captures_from_events(spark, sf)
    model, _ = _packet_model(spark, sf, caps)
    scored = SC.score_packets(FE.feature_bytes(C.decode_packets(caps)).select("path", "packet_no", "fbytes"), model)
    return scored.select("path", "packet_no", F.col("prediction").between(0, N_TRAFFIC - 1).alias("in_range"))


@register("score_captures", with_ev("""
SELECT path, CAST(count(*) FILTER (WHERE NOT is_control AND NOT is_dns) AS BIGINT) AS n_packets,
       count(*) FILTER (WHERE NOT is_control AND NOT is_dns) > 0 AS labelled FROM ev GROUP BY path"""))
def score_captures(spark, sf):
    """Captures -> model -> vote -> traffic label, for all captures in one job."""
    caps = captures_from_events(spark, sf)
    model, _ = _packet_model(spark, sf, caps)
    return SC.score_captures(caps, model, "traffic").select("path", "n_packets", F.col("label").isNotNull().alias("labelled"))


@register("evaluate_stored_set", with_kept(f"""
SELECT CAST(label AS INTEGER) AS label, count(*) AS n FROM (SELECT path, packet_no, {_TRAFFIC} AS label FROM kept)
WHERE label IS NOT NULL AND {test_sql('path', 'packet_no')} GROUP BY 1"""))
def evaluate_stored_set(spark, sf):
    """E1 + M1: a loaded model on a stored test set; the matrix' rows add up to the test rows of each class."""
    model, sets = _packet_model(spark, sf, captures_from_events(spark, sf))
    matrix = M.confusion_matrix(MO.predict(model, spark.read.parquet(sets).where("split = 'test'"), ("label",)))
    return matrix.groupBy("label").agg(F.sum("n").cast("bigint").alias("n")).where("n > 0")


@register("training_presets", with_kept(f"""
, p(model_type, task, output_dim, epochs, kernel1, stride1) AS (VALUES
  ('cnn', 'app', 17, 20, 4, 3), ('cnn', 'traffic', 12, 20, 5, 3),
  ('resnet', 'app', 17, 40, 4, 3), ('resnet', 'traffic', 12, 40, 5, 3)),
k AS (SELECT 'app' AS task, max({_APP}) + 1 AS k_data FROM kept
      UNION ALL SELECT 'traffic', max({_TRAFFIC}) + 1 FROM kept)
SELECT p.model_type, p.task, CAST(p.output_dim AS INTEGER) AS output_dim, CAST(p.epochs AS INTEGER) AS epochs,
       CAST(p.kernel1 AS INTEGER) AS kernel1, CAST(p.stride1 AS INTEGER) AS stride1, CAST(k.k_data AS INTEGER) AS k_data
FROM p JOIN k USING (task)"""))
def training_presets(spark, sf):
    """The four (model type, task) presets next to the class count the data asks for
    (the head is sized from the data, K5)."""
    samples = FE.preprocess(captures_from_events(spark, sf), with_key=False)
    k = samples.agg((F.max("app_label") + 1).cast("int").alias("app"),
                    (F.max("traffic_label") + 1).cast("int").alias("traffic"))
    kd = k.select(F.explode(F.array(
        F.struct(F.lit("app").alias("task"), F.col("app").alias("k_data")),
        F.struct(F.lit("traffic").alias("task"), F.col("traffic").alias("k_data")))).alias("t")).select("t.*")
    rows = [(m, t, p["output_dim"], p["epochs"], p["kernels"][0][0], p["kernels"][0][1])
            for (m, t), p in MO.PRESETS.items()]
    presets = spark.createDataFrame(rows, "model_type string, task string, output_dim int, epochs int, "
                                          "kernel1 int, stride1 int")
    return presets.join(F.broadcast(kd), "task").select(
        "model_type", "task", "output_dim", "epochs", "kernel1", "stride1", "k_data")
