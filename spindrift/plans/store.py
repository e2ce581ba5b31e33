"""Index snapshots: states, an atomically replaced name of the active one, locks, retention and sweeping. Small driver-side steps on a
shared file system; the tables themselves are written by Spark before the pointer moves."""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
import uuid
from contextlib import contextmanager
from pathlib import Path

SCHEMA_VERSION = 2
#: Names in the index folder: the file that names the active snapshot, the lock, and in a snapshot its state and manifest.
ACTIVE, LOCK, STATE, MANIFEST = "active", "lock", "state", "manifest.json"
BUILDING, COMPLETE, FAILED = "building", "complete", "failed"


class IndexProblem(RuntimeError):
    """An error with a code and what to do about it."""

    code, action = "INDEX_ERROR", "Check the index folder"

    def as_dict(self) -> dict[str, str]:
        return {"code": self.code, "message": str(self), "action": self.action}


class SchemaMismatch(IndexProblem):
    code, action = "INDEX_SCHEMA_MISMATCH", "Build the index again with force"


class InvalidPath(IndexProblem):
    code, action = "INVALID_INDEX_PATH", "Choose a folder with an ASCII path"


class CorpusNotFound(IndexProblem):
    code, action = "CORPUS_NOT_FOUND", "Give the corpus folder"


class IndexNotFound(IndexProblem):
    code, action = "INDEX_NOT_FOUND", "Build the index first"


class IndexCorrupt(IndexProblem):
    code, action = "INDEX_CORRUPT", "Build the index again with force"


class ModelUnavailable(IndexProblem):
    code, action = "MODEL_UNAVAILABLE", "Give the embedder that the index was built with"


def require_ascii(path: str | Path) -> None:
    if not str(path).isascii():
        raise InvalidPath(f"the path is not ASCII: {path}")


class Store:
    """Snapshots below root/snapshots, each with a state; root/active names the one that is searched."""

    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.snapshots = self.root / "snapshots"

    def _states(self) -> dict[str, str]:
        """State of every snapshot by its name; names are in order of time."""
        found = sorted(self.snapshots.iterdir()) if self.snapshots.is_dir() else []
        return {p.name: (p / STATE).read_text() if (p / STATE).is_file() else FAILED for p in found}

    def _replace(self, path: Path, text: str) -> None:
        part = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
        part.write_text(text, encoding="utf-8")
        os.replace(part, path)

    def create(self) -> Path:
        path = self.snapshots / f"{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        path.mkdir(parents=True)
        self._replace(path / STATE, BUILDING)
        return path

    def current(self) -> Path:
        """The active snapshot, complete and of this schema."""
        try:
            name = (self.root / ACTIVE).read_text(encoding="utf-8")
        except OSError:
            if self.root.is_dir() and any(p.name not in (LOCK, self.snapshots.name) for p in self.root.iterdir()):
                raise SchemaMismatch(f"{self.root} holds something else") from None
            raise IndexNotFound(f"no index in {self.root}") from None
        if self._states().get(name) != COMPLETE:
            raise IndexCorrupt(f"{name!r} is no complete snapshot")
        path = self.snapshots / name
        if self.manifest(path).get("schema_version") != SCHEMA_VERSION:
            raise SchemaMismatch(f"snapshot {name} has another schema")
        return path

    def manifest(self, snapshot: Path) -> dict:
        try:
            return json.loads((snapshot / MANIFEST).read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            raise SchemaMismatch(f"the manifest of {snapshot.name} can't be read") from e

    def write_manifest(self, snapshot: Path, manifest: dict) -> None:
        self._replace(snapshot / MANIFEST, json.dumps(manifest, ensure_ascii=False, indent=1))

    def activate(self, snapshot: Path) -> None:
        """First the snapshot is complete, then it is named; a reader sees the old one or the new one."""
        self._replace(snapshot / STATE, COMPLETE)
        self._replace(self.root / ACTIVE, snapshot.name)

    def _remove(self, names: list[str]) -> list[str]:
        for name in names:
            shutil.rmtree(self.snapshots / name, ignore_errors=True)
        return names

    def retain(self, keep: int = 2) -> list[str]:
        """Removes all complete snapshots but the active one and, of the others, the newest keep - 1; returns what went."""
        active = self.current().name
        others = [name for name, state in self._states().items() if state == COMPLETE and name != active]
        return self._remove(others[: max(0, len(others) - max(0, keep - 1))])

    def discard(self, snapshot: Path) -> None:
        self._replace(snapshot / STATE, FAILED)
        self._remove([snapshot.name])

    def sweep(self, hours: float = 24) -> list[str]:
        """Removes snapshots that never got complete and whose state is older than that."""
        old = lambda name: time.time() - (self.snapshots / name / STATE).stat().st_mtime > hours * 3600
        return self._remove([name for name, state in self._states().items() if state != COMPLETE and ((self.snapshots / name / STATE).is_file() is False or old(name))])

    @contextmanager
    def lock(self, stale_s: float = 3600):
        """One build at a time. The holder keeps touching its lock; one that was not touched for stale_s is replaced."""
        self.root.mkdir(parents=True, exist_ok=True)
        path, own = self.root / LOCK, uuid.uuid4().hex
        for attempt in (0, 1):
            try:
                with open(path, "x") as f:
                    f.write(own)
                break
            except FileExistsError:
                if attempt or time.time() - path.stat().st_mtime <= stale_s:
                    raise IndexProblem("another build is running") from None
                path.unlink(missing_ok=True)
        done = threading.Event()

        def touch():
            while not done.wait(stale_s / 10):
                if path.is_file() and path.read_text() == own:
                    os.utime(path)

        keeper = threading.Thread(target=touch, daemon=True)
        keeper.start()
        try:
            yield
        finally:
            done.set()
            keeper.join()
            if path.is_file() and path.read_text() == own:
                path.unlink()
