"""Pipeline kernel: envelopes, stages, and a runner that builds one lazy plan."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

from tamis.plans import diagnostics as dia
from tamis.plans import observability as obs


@dataclass(frozen=True)
class Meta:
    run_id: str
    source_id: str
    stage: str = ""
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    attributes: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Envelope:
    """A payload (usually a DataFrame) with the run it belongs to and what was noted on the way."""

    payload: Any
    meta: Meta
    notification: dia.Notification = dia.Notification()

    def with_payload(self, payload: Any, *noted: dia.Diagnostic) -> Envelope:
        return replace(self, payload=payload, notification=self.notification.plus(*noted))


@dataclass(frozen=True)
class Stage:
    """A named step; ``apply`` gets and returns an envelope."""

    name: str
    apply: Callable[[Envelope], Envelope]


@dataclass(frozen=True)
class Pipeline:
    """An ordered list of stages; ``then`` gives a longer one."""

    stages: tuple[Stage, ...] = ()

    def then(self, name: str, apply: Callable[[Envelope], Envelope]) -> Pipeline:
        return Pipeline((*self.stages, Stage(name, apply)))


def envelope(payload: Any, source_id: str, **attributes: Any) -> Envelope:
    return Envelope(payload, Meta(str(uuid.uuid4()), source_id, attributes=attributes))


def run(pipeline: Pipeline, start: Envelope, policy: dia.Policy = dia.fail_fast, sink: Callable[[dia.Diagnostic], None] = dia.logging_sink) -> Envelope:
    """Stages in order; after each the policy sees all that was noted and may stop the run."""
    now = start
    with obs.scope(ioc__run__id=start.meta.run_id, ioc__source__id=start.meta.source_id):
        for stage in pipeline.stages:
            now = replace(now, meta=replace(now.meta, stage=stage.name))
            before = len(now.notification.diagnostics)
            with obs.stage(stage.name):
                now = stage.apply(now)
                for d in now.notification.diagnostics[before:]:
                    sink(d)
                if (stop := policy(now.notification)) is not None:
                    raise dia.Stopped(stop)
    return now
