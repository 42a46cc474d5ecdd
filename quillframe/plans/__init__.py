"""Rendering of plans."""

from quillframe.plans.trace import Step, to_dot

__all__ = ["Step", "to_dot"]
