"""Names of outputs: tokens, portable components, revisions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

_TOKEN = re.compile(r"\{([A-Za-z][A-Za-z0-9_-]*)\}")
_RESERVED = {"CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10))}
_SAME = {"customer": "client", "workflow_name": "workflow"}


class NamingError(ValueError):
    pass


@dataclass(frozen=True)
class Output:
    name: str
    collision: str  # new, identical_noop or revision


def tokens(start: date, end: date, on: date, **more: str) -> dict[str, str]:
    """What a pattern may name: the delivery's date, its period, and more."""
    out = {"YYYY": f"{on:%Y}", "MM": f"{on:%m}", "DD": f"{on:%d}", "period_start": start.isoformat(), "period_end": end.isoformat()}
    return out | {_SAME.get(k, k): str(v).strip() for k, v in more.items()}


def component(text: str) -> str:
    """A portable name: no illegal characters, no dot or space at the end, no device's name."""
    clean = re.sub("-+", "-", re.sub(r'[<>:"/\\|?*\x00-\x1f]', "-", text).strip().rstrip(". "))
    return f"_{clean}" if clean.upper() in _RESERVED else clean


def rendered(pattern: str, values: dict[str, str]) -> str:
    """The pattern with its braced tokens, then bare YYYY, MM and DD, each path component made portable."""

    def value(m: re.Match) -> str:
        if m[1] not in values:
            raise NamingError(f"unknown token: {m[1]}")
        return values[m[1]]

    out = _TOKEN.sub(value, pattern)
    for bare in ("YYYY", "MM", "DD"):
        out = out.replace(bare, values[bare])
    parts = [component(p) for p in out.split("/")]
    if not all(parts):
        raise NamingError("a component of the name is empty")
    return "/".join(parts)


def resolved(name: str, digest: str, existing: dict[str, str]) -> Output:
    """The name to write under: free, taken by the same content, or the next revision `-rN` (existing: name to digest)."""
    stem, dot, suffix = name.rpartition(".")
    stem, suffix = (stem, dot + suffix) if dot and "/" not in suffix else (name, "")
    revision, at = 1, name
    while at in existing:
        if existing[at] == digest:
            return Output(at, "identical_noop")
        revision += 1
        at = f"{stem}-r{revision}{suffix}"
    return Output(at, "new" if at == name else "revision")


def verified(name: str, pattern: str, values: dict[str, str]) -> bool:
    """Whether a name is what the pattern gives, a revision aside."""
    plain = re.sub(r"-r\d+(?=(\.[^./]*)?$)", "", name)
    return plain == rendered(pattern, values)
