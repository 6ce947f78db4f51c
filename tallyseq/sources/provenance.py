"""Run records and package checks."""

from __future__ import annotations

import hashlib
import json
import math
import os
import platform
import time
from importlib import metadata


def sha256_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def file_record(path: str, root: str = ".") -> dict:
    return {"path": os.path.relpath(path, root), "bytes": os.path.getsize(path), "sha256": sha256_file(path)}


def plain(value):
    """JSON-ready: missing and infinite numbers become null, numpy and paths plain (SNK-04)."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def write_json(path: str, document) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump(plain(document), f, indent=2, sort_keys=True)


def run_record(name: str, inputs: list[str], outputs: list[str], expected: list[str], began: float, packages: tuple[str, ...] = ("pyspark", "numpy", "pandas")) -> dict:
    """Inputs and outputs with sizes and hashes, versions, time, and which expected files are missing (QC-01)."""
    missing = sorted(set(expected) - {os.path.basename(p) for p in outputs})
    return {
        "name": name, "inputs": [file_record(p) for p in inputs], "outputs": [file_record(p) for p in outputs], "missing": missing, "passed": not missing,
        "python": platform.python_version(), "versions": {p: metadata.version(p) for p in packages}, "seconds": time.time() - began,
    }


def check_package(root: str, manifest: dict[str, str], most_bytes: int = 50 << 20, banned: tuple[str, ...] = (".pyc", ".DS_Store")) -> list[str]:
    """What is wrong with a package: files absent, changed, too large or of banned kinds (QC-02)."""
    wrong = []
    for name, digest in manifest.items():
        path = os.path.join(root, name)
        if not os.path.exists(path):
            wrong.append(f"{name}: absent")
        elif sha256_file(path) != digest:
            wrong.append(f"{name}: changed")
    for folder, _, names in os.walk(root):
        for n in names:
            p = os.path.join(folder, n)
            if os.path.getsize(p) > most_bytes:
                wrong.append(f"{os.path.relpath(p, root)}: too large")
            if n.endswith(banned):
                wrong.append(f"{os.path.relpath(p, root)}: banned kind")
    return wrong


def build_manifest(root: str) -> list[dict]:
    """Every file below a folder with its size and hash (QC-03)."""
    return [file_record(os.path.join(f, n), root) for f, _, names in sorted(os.walk(root)) for n in sorted(names)]


def run_steps(steps: dict, start_at: str | None = None) -> dict[str, float]:
    """Steps in order, from ``start_at`` on; the first failure ends the run (QC-04). Returns seconds by step."""
    names = list(steps)
    took = {}
    for name in names[names.index(start_at) if start_at else 0 :]:
        began = time.time()
        steps[name]()
        took[name] = time.time() - began
    return took
