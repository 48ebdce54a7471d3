"""Sizes, durations and queue policies as configuration files write them."""

from __future__ import annotations

import re

#: Units and policy names (fixed values).
SIZES = {"": 1, "b": 1, "kb": 1000, "mb": 1000**2, "gb": 1000**3, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30}
SECONDS = {"": 1, "s": 1, "m": 60, "h": 3600}
POLICIES = {"fail": "fail", "fail_engine": "fail", "drop_newest": "drop_newest", "drop_oldest": "drop_oldest", "block": "block", "block_with_deadline": "block", "spill": "spill", "spill_to_disk": "spill"}


def _whole(text: str, units: dict[str, int]) -> int:
    found = re.fullmatch(r"([0-9]+)\s*([a-z]*)", text.strip().lower())
    if not found or found[2] not in units:
        raise ValueError(f"not understood: {text!r}")
    return int(found[1]) * units[found[2]]


def parse_bytes(text: str) -> int:
    return _whole(text.replace("_", ""), SIZES)


def parse_duration(text: str) -> int:
    """Seconds."""
    return _whole(text, SECONDS)


def parse_overflow(text: str) -> str:
    try:
        return POLICIES[text.strip().lower()]
    except KeyError:
        raise ValueError(f"not understood: {text!r}") from None
