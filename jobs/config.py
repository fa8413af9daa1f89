"""Settings of a job: the JSON file beside its module, or another one of the same keys."""

from __future__ import annotations

import json
from pathlib import Path


def settings(module: str, path: str | None = None) -> dict:
    """The job's own settings, with those of ``path`` over them; an unknown key is an error."""
    own = json.loads(Path(module).with_suffix(".json").read_text())
    if path:
        other = json.loads(Path(path).read_text())
        if unknown := sorted(set(other) - set(own)):
            raise KeyError(f"unknown settings: {unknown}")
        own |= other
    return own
