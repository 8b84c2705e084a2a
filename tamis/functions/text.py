"""Scalar functions over columns: refang, normalise, split addresses, keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what surrounds an indicator without being part of it.
TRIMMED = ";,\"' \t\r\n"
NBSP = " "


def refang(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Ordered literal replacements; each rule sees what the previous one made. Null stays null."""
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalise(value: Column) -> Column:
    """Trim separators, quotes and white space at both ends; a final dot stays."""
    return F.btrim(value, F.lit(TRIMMED))


def without_scheme(value: Column) -> Column:
    """What follows the first ``://``, or all."""
    at = F.instr(value, "://")
    return F.when(at > 0, F.substring(value, at + 3, F.char_length(value))).otherwise(value)


def authority(rest: Column) -> Column:
    """Up to the first slash or question mark."""
    return F.regexp_extract(rest, r"^[^/?]*", 0)


def has_port(auth: Column) -> Column:
    """Only digits, at least one, follow the first colon."""
    return auth.rlike(r"\A[^:]*:[0-9]+\z")


def host(auth: Column) -> Column:
    """The authority without its port; a colon without digits stays."""
    return F.when(has_port(auth), F.substring_index(auth, ":", 1)).otherwise(auth)


def is_bare_address(value: Column) -> Column:
    """The lookup's own test: no colon, slash or question mark."""
    return ~value.rlike("[:/?]")


def marker_label(value: Column) -> Column:
    """Non-breaking blanks become blanks, runs of white space one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(F.replace(value, F.lit(NBSP), F.lit(" ")), r"\s+", " "))


def lower_host(value: Column) -> Column:
    """Scheme and authority in lower case, the rest as it is."""
    head = F.regexp_extract(value, r"(?s)^(?:.*?://)?[^/?]*", 0)
    return F.concat(F.lower(head), F.substring(value, F.char_length(head) + 1, F.char_length(value)))


def strip_prefix(value: Column, prefix: str) -> Column:
    return F.when(F.startswith(value, F.lit(prefix)), F.substring(value, F.lit(len(prefix) + 1), F.char_length(value))).otherwise(value)


def key_part(value: Column) -> Column:
    """Trimmed; empty and any spelling of NULL are null."""
    # The engine that trims keys drops control characters and blanks alike.
    trimmed = F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.when((trimmed != "") & (F.upper(trimmed) != "NULL"), trimmed)


def key_parts(columns: Iterable[str]) -> list[Column]:
    """``column:value`` of each key column; null where the value is missing."""
    return [F.concat(F.lit(f"{c.lower()}:"), key_part(F.col(c))) for c in columns]


def composite_key(parts: list[Column]) -> Column:
    """All parts joined by |; null if one is missing."""
    return F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit("|"), p) if i else (p,))])


def first_key(parts: list[Column]) -> Column:
    """The first part that is there."""
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


#: How a row's key is made from the parts of its key columns.
KEY_MODES: dict[str, Callable[[list[Column]], Column]] = {"composite": composite_key, "first-non-empty": first_key}


def row_key(columns: Iterable[str], mode: str) -> Column:
    """The key of a row, by a mode of ``KEY_MODES``."""
    return KEY_MODES[mode](key_parts(columns))


def dedup_key(kind: Column, value: Column) -> Column:
    return F.concat_ws("|", kind, value)


def parse_id(value: Column) -> Column:
    """Trimmed whole number; null and what doesn't parse are 0."""
    return F.coalesce(F.trim(value).try_cast("bigint"), F.lit(0).cast("bigint"))


def source_key(content: Column) -> Column:
    """Lower-case SHA-256 of a file's bytes."""
    return F.lower(F.sha2(content, 256))
