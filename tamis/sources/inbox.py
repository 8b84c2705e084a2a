"""Inbox folders: which files are ready, and moving them through their life."""

from __future__ import annotations

import fnmatch
import os
import time
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from tamis.config import Ingestion


@dataclass(frozen=True)
class Unit:
    """A file on its way: key, where it is, when it was seen."""

    key: str
    path: str
    detected_at: str | None


def ready_files(folder: str, include: Iterable[str], exclude: Iterable[str], quiet_seconds: float, limit: int | None = None, now: float | None = None) -> list[str]:
    """Regular files that match an include pattern (none given: any) and no exclude pattern, unchanged for a while; oldest first."""
    now = time.time() if now is None else now
    include, exclude, found = tuple(include) or ("*",), tuple(exclude), []
    if not os.path.isdir(folder):
        return []
    with os.scandir(folder) as entries:
        for e in entries:
            if not e.is_file() or not any(fnmatch.fnmatchcase(e.name, p) for p in include) or any(fnmatch.fnmatchcase(e.name, p) for p in exclude):
                continue
            changed = e.stat().st_mtime
            if now - changed >= quiet_seconds:
                found.append((changed, e.path))
    return [p for _, p in sorted(found)][:limit]


class Lifecycle:
    """Moves of source files; every name carries the key as a prefix, once."""

    def __init__(self, config: Ingestion) -> None:
        self.config = config

    @staticmethod
    def name(key: str, path: str) -> str:
        own = os.path.basename(path) or "source"
        return own if own.startswith(f"{key}-") else f"{key}-{own}"

    def _move(self, path: str, folder: str, key: str) -> str:
        os.makedirs(folder, exist_ok=True)
        target = os.path.join(folder, self.name(key, path))
        if os.path.exists(path) or not os.path.exists(target):  # a repeated move is no error
            os.replace(path, target)
        return target

    def claim(self, path: str, key: str, detected_at: str) -> Unit:
        return Unit(key, self._move(path, self.config.processing, key), detected_at)

    def archive(self, path: str, key: str) -> str:
        return self._move(path, self.config.done, key)

    def fail(self, path: str, key: str, reason: str | None) -> str:
        target = self._move(path, self.config.failed, key)
        with open(target + ".error", "w", encoding="utf-8") as f:
            f.write(reason or "")
        return target

    def processing(self) -> list[Unit]:
        """Files in processing that are named <key>-<name>; when they changed stands for their detection."""
        folder, found = self.config.processing, []
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            path, at = os.path.join(folder, name), name.find("-")
            if at > 0 and os.path.isfile(path):
                seen = datetime.fromtimestamp(os.path.getmtime(path), timezone.utc).isoformat()
                found.append(Unit(name[:at], path, seen))
        return found
