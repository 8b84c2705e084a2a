"""Structured logs: actions, outcomes, fields, a scope of run fields, stage timing."""

from __future__ import annotations

import contextlib
import contextvars
import json
import logging
import time
from collections.abc import Iterator

#: What may be logged.
ACTIONS = frozenset("app_start app_stop command_start command_complete stage_start stage_complete lookup_load source_read artifact_write aggregation_start aggregation_complete diagnostic_emit".split())
OUTCOMES = frozenset({"success", "failure", "unknown"})
FIELDS = frozenset(
    "event.action event.outcome event.duration file.path ioc.run.id ioc.source.id ioc.mode ioc.stage ioc.source.path ioc.source.content_hash ioc.artifact.name ioc.rows ioc.diagnostic.code ioc.diagnostic.category ioc.diagnostic.severity".split()
)

_scope: contextvars.ContextVar[dict[str, object]] = contextvars.ContextVar("scope", default={})
log = logging.getLogger("tamis")


@contextlib.contextmanager
def scope(**fields: object) -> Iterator[None]:
    """Fields (dots as double underscores) that every event inside carries; nested scopes restore the outer one."""
    own = {k.replace("__", "."): v for k, v in fields.items()}
    if unknown := own.keys() - FIELDS:
        raise KeyError(sorted(unknown)[0])
    token = _scope.set({**_scope.get(), **own})
    try:
        yield
    finally:
        _scope.reset(token)


def event(action: str, outcome: str = "unknown", message: str = "", **fields: object) -> dict[str, object]:
    """Log one event and return its fields."""
    if action not in ACTIONS or outcome not in OUTCOMES:
        raise KeyError(action if action not in ACTIONS else outcome)
    own = {**_scope.get(), "event.action": action, "event.outcome": outcome, **{k.replace("__", "."): v for k, v in fields.items()}}
    log.log(logging.ERROR if outcome == "failure" else logging.INFO, message or action, extra={"fields": own})
    return own


@contextlib.contextmanager
def stage(name: str) -> Iterator[None]:
    """Start and end of a stage, with its time in nanoseconds."""
    began = time.perf_counter_ns()
    with scope(ioc__stage=name):
        event("stage_start")
        try:
            yield
        except BaseException:
            event("stage_complete", "failure", event__duration=time.perf_counter_ns() - began)
            raise
        event("stage_complete", "success", event__duration=time.perf_counter_ns() - began)


class JsonFormatter(logging.Formatter):
    """A line of JSON an event."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"@timestamp": self.formatTime(record), "log.level": record.levelname, "message": record.getMessage(), **getattr(record, "fields", {})}
        if record.exc_info:
            out["error.stack_trace"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False, default=str)
