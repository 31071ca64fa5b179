"""Settings and run identity on the driver: small documents, not data."""

from __future__ import annotations

import hashlib
import json
import math


def merged(base: dict, over: dict) -> dict:
    """base with over's values: nested settings are merged, lists and scalars replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def plain(value):
    """NaN and infinities as None, tuples as lists."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def digest(value) -> str:
    """SHA-256 of the canonical JSON form: sorted keys, no spaces, ASCII, no NaN."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()).hexdigest()


def run_id(settings: dict, inputs: dict[str, str], metadata: str | None, versions: dict[str, str]) -> str:
    """Identity of a run: it depends on settings, input digests, metadata digest and versions, not on their order."""
    return digest({"settings": settings, "inputs": sorted(inputs.items()), "metadata": metadata, "versions": versions})


def settings_errors(s: dict) -> list[str]:
    """What is wrong with settings: fs, low, high, order, window_seconds, overlap, enter, exit, level, schema_version."""
    number = lambda k: isinstance(s.get(k), (int, float)) and not isinstance(s.get(k), bool) and math.isfinite(s[k])
    bad = [f"{k} is not a number" for k in ("fs", "low", "high", "order", "window_seconds", "overlap", "enter", "exit", "level") if not number(k)]
    if bad:
        return bad
    rules = {
        "fs must be positive": s["fs"] > 0,
        "0 < low < high < fs / 2 is needed": 0 < s["low"] < s["high"] < s["fs"] / 2,
        "order must be a positive integer": s["order"] == int(s["order"]) and s["order"] >= 1,
        "a window needs two samples": round(s["window_seconds"] * s["fs"]) >= 2,
        "overlap must be in [0, 1)": 0 <= s["overlap"] < 1,
        "0 <= exit < enter <= 1 is needed": 0 <= s["exit"] < s["enter"] <= 1,
        "level must be a positive integer": s["level"] == int(s["level"]) and s["level"] >= 1,
    }
    return [text for text, ok in rules.items() if not ok]
