"""Frames and their operators."""

from quillframe.operators.frame import EagerFrame, Frame, LazyFrame
from quillframe.operators.grouped import GroupedFrame

__all__ = ["EagerFrame", "Frame", "GroupedFrame", "LazyFrame"]
