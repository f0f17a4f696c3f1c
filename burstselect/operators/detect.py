"""From photos to raw face detections, with any detector.

A detector is given as two factories: ``locator()`` returns a function from an image to (x, y, w, h, confidence) boxes in pixels, ``eyes()`` one from an
image and a box to the probability that the eyes are open. Either may return None, where its model is not there. A factory runs in the Python
worker, once for all the tasks that the worker takes on, so models are neither shipped with tasks nor loaded for each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame

from burstselect.params import SelectionParams

Box = tuple[float, float, float, float]
Locator = Callable[[np.ndarray], Iterable[tuple[float, float, float, float, float | None]]]
Eyes = Callable[[np.ndarray, Box], float | None]

DETECTIONS = (
    "rel string, face_no int, x double, y double, w double, h double, frame_w int, frame_h int, confidence double, open_prob double"
)

# One model of each role in a Python worker, under the digest of its factory.
_MODELS: dict[str, tuple[str, Any]] = {}


def model(role: str, digest: str, factory: Callable[[], Any]) -> Any:
    """The worker's model for ``role``, made on first use; another factory replaces it."""
    if role not in _MODELS or _MODELS[role][0] != digest:
        _MODELS.pop(role, None)  # frees the old model before the new one is loaded
        _MODELS[role] = (digest, factory())
    return _MODELS[role][1]


def _digest(factory: Callable[[], Any] | None) -> str:
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def model_profile(worker_mb: int, task_cpus: int = 1) -> ResourceProfile:
    """Resources of the detecting stage alone: the Python memory of an executor, and the cores that one model uses."""
    executor = ExecutorResourceRequests().pysparkMemory(f"{worker_mb}m")
    return ResourceProfileBuilder().require(executor).require(TaskResourceRequests().cpus(task_cpus)).build


def _may_count(boxes: list[tuple], area: float, params: SelectionParams) -> list[bool]:
    """Which boxes are sure enough and large enough to be in the foreground; only their eyes are read."""
    sure = [b[4] is None or b[4] >= params.min_confidence for b in boxes]
    share = [b[2] * b[3] / area for b in boxes]
    largest = max((s for s, ok in zip(share, sure, strict=True) if ok), default=0.0)
    floor = max(params.min_face_frac, params.foreground_ratio * largest)
    return [ok and s >= floor for s, ok in zip(share, sure, strict=True)]


def _read_eyes(eyes: Eyes, image: np.ndarray, box: Box) -> float | None:
    """Null where the reader can't cope with a face: that face then counts as open."""
    try:
        return eyes(image, box)
    except Exception:
        return None


def detect(
    photos: DataFrame,
    load: Callable[[str], np.ndarray | None],
    locator: Callable[[], Locator | None] | None,
    eyes: Callable[[], Eyes | None] | None = None,
    params: SelectionParams = SelectionParams(),
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """The faces found in each photo of (rel, path): the ``detections`` that ``with_faces`` and ``score`` take.

    Without a locator no photo has faces; without an eye reader, or where it fails, ``open_prob`` is null, which leaves the eye gate out. A
    photo that ``load`` can't open (None) has no rows, as one without faces. ``profile`` (see `model_profile`) gives this stage resources of
    its own; a local master has one kind of executor and must do without. Only paths travel, so spread the photos over tasks first, as ``score`` does.
    """
    names = [c.split()[0] for c in DETECTIONS.split(", ")]
    keys = {"locator": _digest(locator), "eyes": _digest(eyes)}

    def faces_of(rel: str, image: np.ndarray, find: Locator, read: Eyes | None) -> Iterator[tuple]:
        high, wide = image.shape[:2]
        boxes = [tuple(b) for b in find(image)]
        for no, (b, counts) in enumerate(zip(boxes, _may_count(boxes, float(high * wide), params), strict=True), 1):
            opened = _read_eyes(read, image, b[:4]) if read and counts else None
            yield (rel, no, *map(float, b[:4]), wide, high, b[4], opened)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = model("locator", keys["locator"], locator) if locator else None
        read = model("eyes", keys["eyes"], eyes) if eyes else None
        for pdf in batches:
            rows: list[tuple] = []
            for row in pdf.itertuples(index=False) if find else ():
                image = load(row.path)
                if image is not None and image.size:
                    rows += faces_of(row.rel, image, find, read)
            yield pd.DataFrame(rows, columns=names)

    return photos.select("rel", "path").mapInPandas(run, DETECTIONS, profile=profile)
