"""Settings of a program on the driver: defaults, then a file, then the environment."""

from __future__ import annotations

import re
from collections.abc import Mapping

_PAIR = re.compile(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)")


def _unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def parse_env_file(text: str, known: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines; blank ones and comments are skipped, quotes taken off. Keys that are known already
    are left out: a file overrides nothing, and of a key's lines the first counts."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        m = None if line.lstrip().startswith("#") else _PAIR.match(line)
        if m and m[1] not in out and m[1] not in (known or {}):
            out[m[1]] = _unquoted(m[2])
    return out


def load_settings(defaults: Mapping[str, object], file_text: str = "", env: Mapping[str, str] | None = None, prefix: str = "") -> dict[str, object]:
    """The defaults' keys with their values from 'key: value' lines of a file, then from PREFIX_KEY of the
    environment. Other keys are ignored; a value takes the type of its default."""
    given: dict[str, str] = {}
    for line in file_text.splitlines():
        key, colon, value = line.partition(":")
        if colon and not line.lstrip().startswith("#") and key.strip() in defaults and _unquoted(value):
            given[key.strip()] = _unquoted(re.sub(r"\s#.*$", "", value))
    for key in defaults:
        if (name := f"{prefix}{key}".upper()) in (env or {}):
            given[key] = env[name]

    def typed(key: str, old: object) -> object:
        if key not in given:
            return old
        if isinstance(old, bool):
            return given[key].strip().lower() in ("1", "true", "yes", "on")
        return type(old)(given[key]) if isinstance(old, int | float) else given[key]

    return {k: typed(k, v) for k, v in defaults.items()}
