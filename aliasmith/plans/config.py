"""Job settings."""

from __future__ import annotations

from collections.abc import Mapping


class JobConfigError(ValueError):
    """A job's settings are missing or wrong."""


def require(conf: Mapping[str, object], *keys: str) -> list[object]:
    """The values of required settings; an empty configuration is rejected as such."""
    if not conf:
        raise JobConfigError("config is empty")
    missing = [k for k in keys if conf.get(k) in (None, "")]
    if missing:
        raise JobConfigError(f"missing settings: {', '.join(missing)}")
    return [conf[k] for k in keys]


def as_list(value: object) -> list[str]:
    """A list setting, also when written as comma-separated text."""
    items = value.split(",") if isinstance(value, str) else list(value or [])
    return [str(i).strip() for i in items if str(i).strip()]


def read_properties(text: str) -> dict[str, str]:
    """``key=value`` lines; blank lines and comments are skipped."""
    pairs = [line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#")]
    return {key.strip(): value.strip() for key, value in pairs}
