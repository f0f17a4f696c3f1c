"""Burst selection on Spark: group frames into bursts, judge each frame, report the result."""

from burstselect.params import SelectionParams

__all__ = ["SelectionParams"]
