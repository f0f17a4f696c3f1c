from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from burstselect.session import local_session  # noqa: E402

T0 = datetime(2031, 3, 8, 12, 0, 0)

FRAME_SCHEMA = (
    "rel string, when_ts timestamp_ntz, phash bigint, face_count int, eye_score double, sharpness double, "
    "exposure_flag boolean, blown double, crushed double, size_bytes bigint, mtime double"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), partitions=4)
    # Keep small chunks apart, so that small tables are split over several of them.
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield session
    session.stop()


def frame(rel, at=None, phash=0, faces=0, eye=None, sharp=0.0, exposed=False, blown=0.0, crushed=0.0, size=0, mtime=0.0):
    """One frame; ``at`` is in seconds after T0, None for an undated frame."""
    when = None if at is None else T0 + timedelta(seconds=at)
    return (rel, when, phash, faces, eye, float(sharp), exposed, float(blown), float(crushed), size, mtime)


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    """Small tables are split over several chunks."""
    from burstselect.plans import ordered

    monkeypatch.setattr(ordered, "CHUNK_ROWS", 90)


@pytest.fixture(scope="session")
def frames(spark):
    return lambda rows: spark.createDataFrame(rows, FRAME_SCHEMA)
