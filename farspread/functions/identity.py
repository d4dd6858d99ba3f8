"""Identities of feature spaces and of cached files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from .errors import DescriptorMismatchError


def canonical(value: Any) -> Any:
    """A value that JSON writes the same way wherever it was made: floats as text of ten digits, mappings by key."""
    if isinstance(value, Mapping):
        return {str(k): canonical(value[k]) for k in sorted(value, key=str)}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [canonical(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return format(round(value, 10), ".10g")
    return str(value)


def descriptor_id(fields: Mapping[str, Any]) -> str:
    """16 hexadecimal digits that follow from the fields alone."""
    text = json.dumps(canonical(fields), sort_keys=True, separators=(",", ":"))
    return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()


def cache_key(path: str, size: int, mtime_ns: int, box: Mapping[str, Any] | None = None) -> str:
    """The name of a seed file's cached descriptors: a changed file or box setting has another."""
    text = f"{path}|{size}|{mtime_ns}" + (f"|{descriptor_id(box)}" if box else "")
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def descriptor_diff(a: Mapping[str, Any], b: Mapping[str, Any]) -> list[str]:
    """Fields in which two identities differ, compared in canonical form."""
    a, b = canonical(a), canonical(b)
    return [f"{k}: {a.get(k, '(absent)')!r} != {b.get(k, '(absent)')!r}" for k in sorted({*a, *b}) if a.get(k, "(absent)") != b.get(k, "(absent)")]


def require_compatible(run: Mapping[str, Any], other: Mapping[str, Any], where: str = "seed") -> None:
    if descriptor_id(run) != descriptor_id(other):
        raise DescriptorMismatchError(f"the {where} was described in another feature space: " + "; ".join(descriptor_diff(run, other)))
