"""Readers and writers of splat scene files as Spark DataFrames."""

from .detect import FORMATS, detect
from .readers import Scene, read
from .writers import write

__all__ = ["FORMATS", "Scene", "detect", "read", "write"]
