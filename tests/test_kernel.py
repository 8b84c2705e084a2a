"""Configuration, pipeline kernel, diagnostics and logs."""

from __future__ import annotations

import json
import logging

import pytest

from tamis import config as cfg
from tamis.plans import diagnostics as dia
from tamis.plans import observability as obs
from tamis.plans.kernel import Pipeline, envelope, run


def test_defaults_are_valid():
    c = cfg.load()
    assert [a.name for a in c.enabled()] == ["masks", "ip_list", "address_blacklist", "hashes"]


@pytest.mark.parametrize(
    "override",
    [
        {"engine": "pcre"},
        {"rules": [{"when": ["is-bare-ip"]}]},
        {"artifacts": [{"name": "x", "columns": [{"name": "a", "from": "nope"}]}]},
        {"artifacts": [{"name": "x", "columns": [{"name": "a", "from": "value", "transform": ["shout"]}]}]},
        {"artifacts": [{"name": "x", "columns": [], "include": ["nope"]}]},
        {"aggregation": {"retention-enabled": True}},
        {"aggregation": {"merges": [{"name": "masks", "key-columns": ["mask"], "conflict-policy": "keep-last"}]}},
        {"no-such": 1},
    ],
)
def test_bad_configuration(override):
    with pytest.raises(cfg.ConfigError):
        cfg.load(overrides=override)


def test_files_override(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ioc": {"ingestion": {"quiet-seconds": 3}, "refang": [{"from": "x", "to": "y"}]}}))
    c = cfg.load(str(tmp_path / "a.json"), str(tmp_path / "missing.json"), overrides={"mode": "daemon"})
    assert c.ingestion.quiet_seconds == 3 and c.ingestion.max_attempts == 3 and c.refang == (("x", "y"),) and c.mode == "daemon"


def test_stages_run_in_order_and_policies_stop():
    order = []

    def step(name, *noted):
        def apply(e):
            order.append(name)
            return e.with_payload(e.payload + 1, *noted)

        return apply

    warn, error, fatal = (dia.diagnostic(c, source="s", reason="r", stage="x", item="i") for c in ("SOURCE.EMPTY_TEXT", "PIPELINE.STAGE_FAILED", "SOURCE.READ_FAILED"))
    p = Pipeline().then("a", step("a", warn)).then("b", step("b"))
    sink = dia.CollectingSink()
    assert run(p, envelope(0, "s"), sink=sink).payload == 2 and order == ["a", "b"] and sink == [warn]
    with pytest.raises(dia.Stopped):
        run(p.then("c", step("c", error)).then("d", step("d")), envelope(0, "s"), sink=dia.noop_sink)
    assert order[-1] == "c"
    out = run(p.then("c", step("c", error)), envelope(0, "s"), dia.collect_and_continue)
    assert out.notification.has_errors and not out.notification.has_fatal
    with pytest.raises(dia.Stopped):
        run(p.then("c", step("c", fatal)), envelope(0, "s"), dia.collect_and_continue)


def test_diagnostics(spark):
    assert len(dia.CATALOG) == 17 and len({r[1] for r in dia.CATALOG}) == 7
    a = dia.diagnostic("SOURCE.READ_FAILED", source="{reason}")
    assert dia.render(a) == "Source {reason} could not be read: {reason}"
    assert a == dia.diagnostic("SOURCE.READ_FAILED", source="{reason}") and a != dia.diagnostic("SOURCE.READ_FAILED", source="x")
    rows = dia.rendered(dia.table(spark, [a])).collect()
    assert rows[0]["message"] == dia.render(a)
    assert dia.severity_checks(dia.table(spark, [a])).first().asDict() == {"has_errors": True, "has_fatal": True}
    assert dia.Result(2).map(lambda v: v + 1).value == 3
    with pytest.raises(KeyError):
        dia.diagnostic("NO.SUCH")


def test_events_carry_their_scope():
    with obs.scope(ioc__run__id="r"):
        assert obs.event("app_start")["ioc.run.id"] == "r"
        with pytest.raises(KeyError):
            obs.event("no_such")
    assert "ioc.run.id" not in obs.event("app_stop")
    record = logging.makeLogRecord({"msg": "m", "fields": {"ioc.rows": 1}})
    assert json.loads(obs.JsonFormatter().format(record))["ioc.rows"] == 1
