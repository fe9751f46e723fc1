"""Small JSON settings of a job, with checked names."""

from __future__ import annotations

import json
import os

HERE = os.path.dirname(os.path.abspath(__file__))


def load(job: str, path: str | None = None) -> dict:
    """The job's own settings, those of the file at `path` over them; unknown names are refused."""
    with open(os.path.join(HERE, f"{job}.json")) as f:
        known = json.load(f)
    if path:
        with open(path) as f:
            own = json.load(f)
        if odd := sorted(set(own) - set(known)):
            raise ValueError(f"{path}: unknown settings {', '.join(odd)}; known are {', '.join(known)}")
        known |= own
    return known
