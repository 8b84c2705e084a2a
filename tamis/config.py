"""Configuration: what to detect, how to classify it, and which artifacts to fill.

Everything has a default and can be overridden by a nested mapping or a JSON
file (YAML too, where a YAML library is installed). Names of predicates, value
providers, transforms and policies are checked when the configuration is built.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any, get_type_hints

#: Variables of the environment that begin so override single properties.
ENVIRONMENT = "TAMIS_"


class ConfigError(ValueError):
    """A configuration that cannot be compiled into a plan."""


#: Indicator types in order of priority, with category and STIX name.
TYPES = (
    ("SHA256", "FILE", "file:hashes.'SHA-256'"),
    ("SHA1", "FILE", "file:hashes.'SHA-1'"),
    ("MD5", "FILE", "file:hashes.MD5"),
    ("URL", "NETWORK", "url"),
    ("IPV4", "NETWORK", "ipv4-addr"),
    ("DOMAIN", "NETWORK", "domain-name"),
)
PRIORITY = tuple(t for t, _, _ in TYPES)
#: Default patterns, markers and refang rules.
PATTERNS = {
    "SHA256": r"\b[0-9a-fA-F]{64}\b",
    "SHA1": r"\b[0-9a-fA-F]{40}\b",
    "MD5": r"\b[0-9a-fA-F]{32}\b",
    "URL": r"""https?://[^\s;,<>"']+""",
    "IPV4": r"""\b(?:\d{1,3}\.){3}\d{1,3}(?:[:/][^\s;,<>"']*)?""",
    "DOMAIN": r"""\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?:/[^\s;,<>"']*)?""",
}
MARKERS = (r"БИБ-\d+", r"Письмо ФСТЭК России[^№]*№\s*[\d/]+")
REFANG = (("hxxps", "https"), ("hxxp", "http"), ("[.]", "."), ("[:]", ":"), ("(dot)", "."), ("[at]", "@"))
UNKNOWN_LABEL = "UNKNOWN"


@dataclass(frozen=True)
class Rule:
    """One classification rule: all predicates of ``when`` hold; a blank code is NULL."""

    when: tuple[str, ...] = ()
    url_match: str | None = None
    host_match: str | None = None


RULES = (
    Rule(("has-query",), "u:hAS,pEX", None),
    Rule(("has-path-or-port",), "u:hEX,dEX", None),
    Rule(("is-subdomain",), "u:hEX", "h:dEX"),
    Rule((), "u:hAS", "h:dAS"),
)


@dataclass(frozen=True)
class ColumnSpec:
    """One output column: provider, optional literal, type gate and transforms."""

    name: str
    source: str = "const"
    value: str | None = None
    when_type: str | None = None
    transform: tuple[str, ...] = ()


@dataclass(frozen=True)
class IdSpec:
    """Sequential ids; start 'auto' follows the largest id of the artifact's lookup."""

    strategy: str = "ascending"
    start: str | int | None = "auto"


@dataclass(frozen=True)
class Artifact:
    """One output list: which types it accepts, its filters, columns and ids."""

    name: str
    columns: tuple[ColumnSpec, ...]
    accepts: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    id: IdSpec | None = None
    path: str = ""
    enabled: bool = True


@dataclass(frozen=True)
class Merge:
    """How rows of an artifact are recognised when sources are aggregated."""

    name: str
    key_columns: tuple[str, ...]
    key_mode: str = "composite"
    conflict_policy: str = "keep-first"


def _constants(*names: str) -> tuple[ColumnSpec, ...]:
    return tuple(ColumnSpec(n) for n in names)


_SEEN = ("score", "time_last_seen", "time_first_seen", "threat_type")
_STRIPPED = ColumnSpec("source", "source.label", transform=("strip-prefix:Письмо ",))
ARTIFACTS = (
    Artifact(
        "masks",
        (ColumnSpec("id", "id"), ColumnSpec("mask", "value", transform=("lower-host",)), ColumnSpec("url_match", "match.url"), ColumnSpec("host_match", "match.host"), *_constants(*_SEEN), ColumnSpec("source", "source.label"), *_constants("description")),
        accepts=("IPV4", "DOMAIN", "URL"), exclude=("is-bare-ip",), id=IdSpec(), path="masks_list_generated.csv",
    ),
    Artifact(
        "ip_list",
        (ColumnSpec("id", "id"), ColumnSpec("ip", "value"), *_constants(*_SEEN), _STRIPPED, *_constants("description")),
        accepts=("IPV4",), include=("is-bare-ip",), id=IdSpec(), path="ip_list_generated.csv",
    ),
    Artifact(
        "address_blacklist",
        (ColumnSpec("forbidden_url", "address.url", transform=("lower-host",)), ColumnSpec("forbidden_ip", "address.ip", transform=("lower-host",))),
        accepts=("IPV4", "DOMAIN", "URL"), path="address_blacklist_generated.csv",
    ),
    Artifact(
        "hashes",
        (ColumnSpec("id", "id"), *(ColumnSpec(f"hash_{t.lower()}", "value", when_type=t, transform=("upper",)) for t in ("MD5", "SHA256", "SHA1")), *_constants(*_SEEN), _STRIPPED, *_constants("description")),
        accepts=("MD5", "SHA1", "SHA256"), id=IdSpec(), path="hashes_list_generated.csv",
    ),
)
MERGES = (
    Merge("masks", ("mask",)),
    Merge("ip_list", ("ip",)),
    Merge("address_blacklist", ("forbidden_url", "forbidden_ip"), "first-non-empty"),
    Merge("hashes", ("hash_md5", "hash_sha1", "hash_sha256"), "first-non-empty"),
)


@dataclass(frozen=True)
class Csv:
    delimiter: str = ";"
    quote: str = '"'
    null_literal: str = "NULL"
    largest_file: int = 0  # rows up to which a list is one file (0: always); larger ones are directories, written by the executors


@dataclass(frozen=True)
class Lookup:
    """Existing lists to leave out: artifact name to CSV path."""

    deduplicate: bool = True
    artifacts: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Ingestion:
    inbox: str = "var/inbox"
    processing: str = "var/processing"
    done: str = "var/done"
    failed: str = "var/failed"
    ledger: str = "var/ledger"
    partitions: str = "dataframe/partitions"
    include: tuple[str, ...] = ("*.htm", "*.html", "*.docx")
    exclude: tuple[str, ...] = ("*.tmp", "*.part", ".*")
    poll_seconds: float = 30.0
    max_files_per_poll: int = 50
    quiet_seconds: float = 10.0
    max_attempts: int = 3
    backoff_seconds: float = 5.0


@dataclass(frozen=True)
class Aggregation:
    enabled: bool = True
    interval_seconds: float = 60.0
    initial_delay_seconds: float = 10.0
    id_index: str = "dataframe/.ioc-id-index.csv"
    merges: tuple[Merge, ...] = MERGES
    retention_enabled: bool = False
    global_ids: bool = True


@dataclass(frozen=True)
class Config:
    patterns: Mapping[str, str] = field(default_factory=lambda: dict(PATTERNS))
    markers: tuple[str, ...] = MARKERS
    refang: tuple[tuple[str, str], ...] = REFANG
    engine: str = "re2j"
    rules: tuple[Rule, ...] = RULES
    artifacts: tuple[Artifact, ...] = ARTIFACTS
    csv: Csv = field(default_factory=Csv)
    lookup: Lookup = field(default_factory=Lookup)
    ingestion: Ingestion = field(default_factory=Ingestion)
    aggregation: Aggregation = field(default_factory=Aggregation)
    charset: str = "windows-1251"
    output_dir: str = "dataframe"
    mode: str = "oneshot"

    def enabled(self) -> tuple[Artifact, ...]:
        """Enabled artifacts, in the order of the configuration."""
        return tuple(a for a in self.artifacts if a.enabled)

    def artifact(self, name: str) -> Artifact:
        return next(a for a in self.artifacts if a.name == name)


def validated(config: Config) -> Config:
    """The configuration itself, or a ConfigError that names what is unknown."""
    from tamis.operators import registry

    def known(kind: str, name: str, allowed: Any) -> None:
        if name not in allowed:
            raise ConfigError(f"unknown {kind}: {name}")

    known("engine", config.engine, {"re2j", "jdk"})
    known("mode", config.mode, {"oneshot", "daemon"})
    for t in config.patterns:
        known("indicator type", t, PRIORITY)
    for rule in config.rules:
        for p in rule.when:
            known("classification predicate", p, registry.PREDICATES)
    names = [a.name for a in config.artifacts]
    if len(set(names)) < len(names):
        raise ConfigError("artifact names must differ")
    for a in config.artifacts:
        for t in a.accepts:
            known("indicator type", t, PRIORITY)
        for p in (*a.include, *a.exclude):
            known("artifact predicate", p, registry.ARTIFACT_PREDICATES)
        for c in a.columns:
            known("value provider", c.source, registry.PROVIDERS)
            if c.when_type is not None:
                known("indicator type", c.when_type, PRIORITY)
            for t in c.transform:
                known("transform", t.split(":", 1)[0], registry.TRANSFORMS)
        if a.id is not None:
            known("id strategy", a.id.strategy, {"ascending", "descending"})
    for m in config.aggregation.merges:
        known("conflict policy", m.conflict_policy, registry.MERGE_POLICIES)
        known("key mode", m.key_mode, registry.KEY_MODES)
        known("artifact", m.name, names)
    if config.aggregation.retention_enabled:
        raise ConfigError("retention is not supported")
    return config


def _build(kind: Any, value: Any) -> Any:
    """A nested mapping as the dataclass ``kind``; hyphens count as underscores."""
    if is_dataclass(kind) and isinstance(value, Mapping):
        hints = get_type_hints(kind)
        alias = {"from": "source"} if kind is ColumnSpec else {}
        own = {alias.get(k, k.replace("-", "_")): v for k, v in value.items()}
        if unknown := set(own) - {f.name for f in fields(kind)}:
            raise ConfigError(f"unknown property of {kind.__name__}: {sorted(unknown)[0]}")
        return kind(**{k: _build(_inner(hints[k]), v) for k, v in own.items()})
    if isinstance(value, list):
        return tuple(_build(kind, v) for v in value)
    return value


def _inner(hint: Any) -> Any:
    """The dataclass that a hint holds, alone, optional or in a tuple."""
    for a in (hint, *getattr(hint, "__args__", ())):
        if is_dataclass(a):
            return a
    return hint


def merged(config: Config, overrides: Mapping[str, Any]) -> Config:
    """``config`` with the given top-level sections replaced, section by section and key by key."""
    hints, changes = get_type_hints(Config), {}
    for key, value in overrides.items():
        name = key.replace("-", "_")
        if name not in hints:
            raise ConfigError(f"unknown property: {key}")
        now = getattr(config, name)
        if is_dataclass(now) and isinstance(value, Mapping):
            built = _build(type(now), value)
            changes[name] = replace(now, **{k.replace("-", "_"): getattr(built, k.replace("-", "_")) for k in value})
        elif name == "refang":
            changes[name] = tuple((r["from"], r["to"]) if isinstance(r, Mapping) else tuple(r) for r in value)
        else:
            changes[name] = _build(_inner(hints[name]), value)
    return validated(replace(config, **changes))


def properties(pairs: Iterable[tuple[str, str]]) -> dict[str, Any]:
    """Overrides from single properties: ``section.key`` and a JSON value, or text that is no JSON."""
    out: dict[str, Any] = {}
    for name, text in pairs:
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        *sections, key = name.removeprefix("ioc.").split(".")
        at = out
        for section in sections:
            at = at.setdefault(section, {})
            if not isinstance(at, dict):
                raise ConfigError(f"property below a value: {name}")
        at[key] = value
    return out


def from_environment(environment: Mapping[str, str]) -> dict[str, Any]:
    """Overrides from variables such as TAMIS_LOOKUP__DEDUPLICATE=false; two underscores divide section and key."""
    return properties((k.removeprefix(ENVIRONMENT).lower().replace("__", "."), v) for k, v in sorted(environment.items()) if k.startswith(ENVIRONMENT))


def load(*paths: str, overrides: Mapping[str, Any] | None = None) -> Config:
    """Defaults, then each file that exists, then overrides."""
    config = validated(Config())
    for path in paths:
        try:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        except FileNotFoundError:
            continue
        if path.endswith((".yml", ".yaml")):
            try:
                import yaml
            except ImportError as e:
                raise ConfigError("YAML files need a YAML library; use JSON") from e
            data = yaml.safe_load(text) or {}
        else:
            data = json.loads(text)
        config = merged(config, data.get("ioc", data))
    return merged(config, overrides or {})
