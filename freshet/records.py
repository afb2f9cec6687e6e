"""What a run is made of, on the driver alone: provenance, small state, locks and packages."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tarfile
import uuid
from dataclasses import asdict, dataclass
from pathlib import Path

_SECRET = re.compile(r"(?i)(password|passwd|secret|token|api[_-]?key|authorization|credential|private[_-]?key)")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def canonical_digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def redact(value):
    """A copy without the values of names that sound secret, at any depth."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if _SECRET.search(str(k)) else redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, list | tuple) else value


class StateStore:
    """Small named values. In memory here; FileStateStore keeps them."""

    def __init__(self):
        self._values: dict[str, bytes] = {}

    def get(self, name: str) -> bytes | None:
        return self._values.get(name)

    def put(self, name: str, value: bytes) -> None:
        self._values[name] = value

    def delete(self, name: str) -> None:
        self._values.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._values)


class FileStateStore(StateStore):
    """A file a value, replaced whole."""

    def __init__(self, folder: str):
        self._folder = Path(folder)
        self._folder.mkdir(parents=True, exist_ok=True)

    def _path(self, name: str) -> Path:
        return self._folder / (name.encode().hex() + ".state")

    def get(self, name: str) -> bytes | None:
        return self._path(name).read_bytes() if self._path(name).exists() else None

    def put(self, name: str, value: bytes) -> None:
        new = self._path(name).with_suffix(f".{uuid.uuid4().hex}")
        new.write_bytes(value)
        os.replace(new, self._path(name))

    def delete(self, name: str) -> None:
        self._path(name).unlink(missing_ok=True)

    def names(self) -> list[str]:
        return sorted(bytes.fromhex(p.stem).decode() for p in self._folder.glob("*.state"))


class SealedStateStore(StateStore):
    """Another store behind `seal` and `open` functions, as of an encryption library."""

    def __init__(self, inner: StateStore, seal, unseal):
        self._inner, self._seal, self._unseal = inner, seal, unseal

    def get(self, name: str) -> bytes | None:
        found = self._inner.get(name)
        return None if found is None else self._unseal(found)

    def put(self, name: str, value: bytes) -> None:
        self._inner.put(name, self._seal(value))

    def delete(self, name: str) -> None:
        self._inner.delete(name)

    def names(self) -> list[str]:
        return self._inner.names()


@dataclass(frozen=True)
class Provenance:
    """What a run read, with which logic, and what it planned: enough to tell whether a replay does the same."""

    inputs: dict[str, str]
    logic: str
    actions: dict[str, dict[str, int]]

    @property
    def digest(self) -> str:
        return canonical_digest(asdict(self))

    def differences(self, other: Provenance) -> list[str]:
        return [n for n in ("inputs", "logic", "actions") if getattr(self, n) != getattr(other, n)]


def lock(folder: str, settings: dict | None = None) -> dict:
    """Digests of all Python files below a folder and of settings: what a pipeline is made of."""
    top = Path(folder)
    files = {str(p.relative_to(top)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(top.rglob("*.py"))}
    body = {"files": files, "settings": redact(settings or {})}
    return body | {"digest": canonical_digest(body)}


def package(folder: str, out: str) -> dict:
    """A reproducible archive of a pipeline with its lock."""
    found = lock(folder)
    with tarfile.open(out, "w", format=tarfile.USTAR_FORMAT) as tar:
        for name in sorted(found["files"]):
            info = tarfile.TarInfo(name)
            data = (Path(folder) / name).read_bytes()
            info.size = len(data)
            import io

            tar.addfile(info, io.BytesIO(data))
    return found


def verify_package(path: str, locked: dict) -> bool:
    with tarfile.open(path) as tar:
        files = {m.name: hashlib.sha256(tar.extractfile(m).read()).hexdigest() for m in tar}
    return files == locked["files"]
