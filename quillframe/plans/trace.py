"""A trace of the calls that built a frame, for ``explain``.  Spark plans from its own tree, never from this one."""

from __future__ import annotations

import shutil
import subprocess
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Step:
    label: str
    inputs: tuple[Step, ...] = ()


def to_dot(root: Step) -> str:
    """DOT text of the plan as written, root first; a step that is used twice is one node."""
    order: dict[int, Step] = {}

    def visit(step: Step) -> None:
        if id(step) not in order:
            order[id(step)] = step
            for child in step.inputs:
                visit(child)

    visit(root)
    names = {key: f"n{i}" for i, key in enumerate(order)}
    lines = ["digraph plan {", "  node [shape=box];"]
    for key, step in order.items():
        text = step.label.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        lines.append(f'  {names[key]} [label="{text}"];')
        lines += [f"  {names[key]} -> {names[id(child)]};" for child in step.inputs]
    return "\n".join([*lines, "}"]) + "\n"


def render(dot: str, path: str) -> bool:
    """Writes a PNG with Graphviz if it is installed, else the DOT text; says whether it is a PNG."""
    if program := shutil.which("dot"):
        subprocess.run([program, "-Tpng", "-o", path], input=dot.encode(), check=True)
        return True
    Path(path).write_text(dot)
    return False
