"""Layered TOML settings: defaults, then files in order; later keys win one by one."""

from __future__ import annotations

import tomllib
from pathlib import Path

from quillforge.schema import DUPLICATES, GATE, METRIC_IDS, default_thresholds

# Other names of thresholds in settings files.
ALIASES = {
    "classes_per_file": "concrete_types_per_file",
    "types_per_file": "concrete_types_per_file",
    "max_indentation": "max_indentation_depth",
    "local_variables": "local_variables_per_function",
    "arguments": "arguments_per_function",
    "decorators_per_function": "annotations_per_function",
    "attributes_per_function": "annotations_per_function",
}
SECTIONS = ("python", "rust", "shared", "thresholds", "gate")


class SettingsError(ValueError):
    pass


def similar(name: str, known: list[str] | tuple[str, ...]) -> str | None:
    """A known name of nearly the same length that shares most characters."""
    best = max((k for k in known if abs(len(k) - len(name)) <= 2), key=lambda k: sum(a in k for a in name), default=None)
    return best if best is not None and sum(a in best for a in name) >= len(name) - 2 else None


def _section(name: str, values: dict, known: tuple[str, ...]) -> dict[str, int]:
    found = {}
    for key, value in values.items():
        key = ALIASES.get(key, key)
        if key not in known:
            near = similar(key, known)
            raise SettingsError(f"[{name}]: unknown key {key!r}" + (f"; did you mean {near!r}?" if near else ""))
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise SettingsError(f"[{name}] {key}: a whole number from 0 is wanted")
        found[key] = value
    return found


def parse(text: str, strict: bool = True) -> tuple[dict[tuple[str, str], int], dict, list[str]]:
    """(thresholds, gate, errors). Unless strict, a section with an error is left out as a whole."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        if strict:
            raise SettingsError(str(e)) from e
        return {}, {}, [str(e)]
    limits: dict[tuple[str, str], int] = {}
    gate: dict = {}
    errors = []
    for name, values in data.items():
        try:
            if name not in SECTIONS:
                near = similar(name, SECTIONS)
                raise SettingsError(f"unknown section [{name}]" + (f"; did you mean [{near}]?" if near else ""))
            if name == "gate":
                for key, value in values.items():
                    if key not in GATE:
                        raise SettingsError(f"[gate]: unknown key {key!r}")
                    if isinstance(value, bool) != isinstance(GATE[key], bool) or not isinstance(value, (int, float)):
                        raise SettingsError(f"[gate] {key}: wrong kind of value")
                    if key == "min_similarity" and not 0 <= value <= 1 or key == "test_coverage_threshold" and not 0 <= value <= 100:
                        raise SettingsError(f"[gate] {key}: out of range")
                gate |= values
            else:
                found = _section(name, values, METRIC_IDS)
                for language in ("python", "rust") if name in ("shared", "thresholds") else (name,):
                    limits |= {(language, k): v for k, v in found.items()}
        except SettingsError as e:
            if strict:
                raise
            errors.append(str(e))
    return limits, gate, errors


def load(*paths: str, strict: bool = False) -> tuple[dict[tuple[str, str], int], dict]:
    """Defaults overlaid by the files that exist, in order."""
    limits, gate = default_thresholds(), dict(GATE)
    for path in paths:
        if Path(path).is_file():
            more, other, _ = parse(Path(path).read_text(), strict)
            limits |= more
            gate |= other
    return limits, gate


def render(limits: dict[tuple[str, str], int], gate: dict | None = None) -> str:
    """TOML with metrics in registry order."""
    out = []
    for language in ("python", "rust"):
        rows = [(m, limits[language, m]) for m in METRIC_IDS if (language, m) in limits]
        if rows:
            out += [f"[{language}]", *(f"{m} = {v}" for m, v in rows), ""]
    if gate:
        out += ["[gate]", *(f"{k} = {str(v).lower() if isinstance(v, bool) else v}" for k, v in gate.items()), ""]
    return "\n".join(out)


def merge(old: str, new: dict[tuple[str, str], int], languages: set[str], gate: dict | None = None) -> str:
    """A settings file with the sections of the given languages replaced and the others kept."""
    limits, held, _ = parse(old, strict=False) if old.strip() else ({}, {}, [])
    kept = {k: v for k, v in limits.items() if k[0] not in languages}
    return render(kept | new, held | (gate or {}))


__all__ = ["ALIASES", "DUPLICATES", "SettingsError", "load", "merge", "parse", "render", "similar"]
