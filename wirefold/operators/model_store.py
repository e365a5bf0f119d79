"""Versioned models per (task, model type), published at once.

``<root>/<task>/<type>/v<number>`` holds a model and, written last, a manifest
with its preset, class names and metrics.  A writer claims its number by
creating a file that must not exist yet, so two writers never share a folder;
a version without manifest doesn't exist for readers, who get the newest one
that has it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from wirefold.operators.labels import LABEL_NAMES
from wirefold.operators.models import preset
from wirefold.sources.files import hadoop_path


def _folder(root: str, task: str, model_type: str) -> str:
    preset(model_type, task)  # unknown names raise
    return f"{root.rstrip('/')}/{task}/{model_type}"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Versions of a folder that have a manifest, oldest first."""
    fs, path = hadoop_path(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    found = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    return [n for n in found if fs.exists(hadoop_path(spark, f"{folder}/v{n}/manifest.json")[1])]


def claim_version(spark: SparkSession, root: str, task: str, model_type: str) -> int:
    """A number that no other writer has."""
    folder = _folder(root, task, model_type)
    fs, path = hadoop_path(spark, f"{folder}/claims")
    taken = [int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
    n = max(taken, default=0) + 1
    while not fs.createNewFile(hadoop_path(spark, f"{folder}/claims/{n}")[1]):
        n += 1
    return n


def publish_model(spark: SparkSession, model: PipelineModel, root: str, task: str, model_type: str, metrics: dict | None = None,
                  version: int | None = None) -> int:
    """Store a model as a new version; its number."""
    n = version or claim_version(spark, root, task, model_type)
    folder = f"{_folder(root, task, model_type)}/v{n}"
    model.write().overwrite().save(f"{folder}/model")
    manifest = {"task": task, "model_type": model_type, "version": n, "preset": preset(model_type, task),
                "classes": {i: name for t, i, name in LABEL_NAMES if t == task}, "metrics": metrics or {}}
    fs, hidden = hadoop_path(spark, f"{folder}/_manifest")
    out = fs.create(hidden, True)
    out.write(json.dumps(manifest).encode())
    out.close()
    if not fs.rename(hidden, hadoop_path(spark, f"{folder}/manifest.json")[1]):
        raise RuntimeError(f"{folder} has a manifest already")
    return n


def model_versions(spark: SparkSession, root: str, task: str, model_type: str) -> Iterable[dict]:
    """The manifests of all published versions, oldest first."""
    folder = _folder(root, task, model_type)
    for n in _numbers(spark, folder):
        yield json.loads("".join(r.value for r in spark.read.text(f"{folder}/v{n}/manifest.json").collect()))


def load_newest(spark: SparkSession, root: str, task: str, model_type: str) -> tuple[PipelineModel, dict]:
    """The newest published model and its manifest; LookupError if there is none."""
    versions = list(model_versions(spark, root, task, model_type))
    if not versions:
        raise LookupError(f"no model for task={task!r}, model_type={model_type!r} below {root}")
    return PipelineModel.load(f"{_folder(root, task, model_type)}/v{versions[-1]['version']}/model"), versions[-1]
