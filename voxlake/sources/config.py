"""Settings files: YAML or JSON mappings, with relative paths made absolute. They are read on the driver, being small."""

from __future__ import annotations

import json
from pathlib import Path


def load(path: str) -> dict:
    """The mapping in a YAML or JSON file; anything else is an error. YAML needs the yaml package."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix == ".json":
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def absolute(value, root: str, keys=("path", "dir", "root", "file")):
    """`value` with every relative path under `root`: strings whose key ends in one of `keys`, at any depth.

    Absolute paths, addresses with a scheme and empty strings stay.
    """

    def walk(x, key: str):
        if isinstance(x, dict):
            return {k: walk(v, str(k)) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, key) for v in x]
        named = isinstance(x, str) and x and any(key == k or key.endswith("_" + k) for k in keys)
        return str(Path(root) / x) if named and "://" not in x and not x.startswith(("/", "~")) else x

    return walk(value, "")
