"""Inkstrata: text-evidence search, candidate mining and preference ranking as Spark dataflows."""

from __future__ import annotations

import os
import sys
from pathlib import Path

from pyspark import cloudpickle

_ROOT = str(Path(__file__).resolve().parent.parent)

# Python workers import this package by name when they can see it; otherwise functions travel by value.
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and os.path.realpath(os.getcwd()) != _ROOT:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
