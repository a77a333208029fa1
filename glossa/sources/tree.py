"""Output trees: write-once files within a byte budget, published by a rename or as one deterministic archive."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from glossa.functions.package_kernel import path_ok
from glossa.operators.rejects import CheckFailed
from glossa.sources import stardict


class Tree:
    """Files by path; each is written once, and all of them stay within ``budget`` bytes."""

    def __init__(self, budget: int = 8 << 30):
        self.budget, self.used, self.paths = budget, 0, set()

    def put(self, path: str, data: bytes) -> None:
        if not path_ok(path) or path in self.paths:
            raise CheckFailed("IO", f"{path} is no path or is written twice")
        if self.used + len(data) > self.budget:
            raise CheckFailed("LIMIT", "output size")
        self.used += len(data)
        self.paths.add(path)
        self._store(path, data)

    def put_json(self, path: str, value) -> None:
        self.put(path, json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True).encode() + b"\n")


class ArchiveTree(Tree):
    """Kept in memory and finished as one archive whose bytes follow from the files alone."""

    def __init__(self, budget: int = 8 << 30):
        super().__init__(budget)
        self.files: dict[str, bytes] = {}

    def _store(self, path: str, data: bytes) -> None:
        self.files[path] = data

    def read(self, path: str) -> bytes:
        return self.files[path]

    def finish(self) -> bytes:
        return stardict.pack(self.files)


class FolderTree(Tree):
    """Files in a private staging folder beside ``target``; leaving the block without an error publishes them."""

    def __init__(self, target: str, budget: int = 8 << 30):
        super().__init__(budget)
        self.target, self.stage = Path(target), Path(f"{target}.staging-{os.getpid()}")

    def __enter__(self):
        if self.target.exists():
            raise CheckFailed("IO", f"{self.target} exists")
        os.makedirs(self.stage, mode=0o700)
        return self

    def __exit__(self, kind, *_):
        if kind is None:
            os.rename(self.stage, self.target)
        else:
            shutil.rmtree(self.stage, ignore_errors=True)

    def _store(self, path: str, data: bytes) -> None:
        file = self.stage / path
        file.parent.mkdir(parents=True, exist_ok=True)
        with open(file, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())

    def read(self, path: str) -> bytes:
        """A regular file of the tree; links and paths that leave it are refused."""
        root = self.target if self.target.exists() else self.stage
        file = root / path
        if not path_ok(path) or file.is_symlink() or not file.is_file():
            raise CheckFailed("IO", f"{path} is no file of the tree")
        return file.read_bytes()
