"""Edits of local files as one transaction: checked, applied from the end, rolled back on failure.

This is a sink for plans of a developer's own tree; it runs on the driver and writes local files."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True, order=True)
class Edit:
    path: str
    start_byte: int
    end_byte: int
    new: str
    old: str = ""
    line: int = 0
    kind: str = "reference"


class EditError(ValueError):
    pass


def check(edits: list[Edit]) -> None:
    """No two edits of a file may overlap; two insertions at one place may not either."""
    for one, two in zip(sorted(edits)[:-1], sorted(edits)[1:], strict=True):
        if one.path == two.path and (two.start_byte < one.end_byte or one.start_byte == two.start_byte):
            raise EditError(f"{one.path}: edits overlap at byte {two.start_byte}")


def apply_to(source: bytes, edits: list[Edit]) -> bytes:
    for edit in sorted(edits, reverse=True):
        if not 0 <= edit.start_byte <= edit.end_byte <= len(source):
            raise EditError(f"{edit.path}: byte {edit.end_byte} is out of range")
        if edit.old and source[edit.start_byte : edit.end_byte] != edit.old.encode():
            raise EditError(f"{edit.path}: the text at byte {edit.start_byte} has changed")
        source = source[: edit.start_byte] + edit.new.encode() + source[edit.end_byte :]
    return source


def apply(root: str, edits: list[Edit]) -> list[str]:
    """Write all edits or none; returns the paths written."""
    check(edits)
    by_path: dict[str, list[Edit]] = {}
    for edit in edits:
        by_path.setdefault(edit.path, []).append(edit)
    before = {path: (Path(root) / path).read_bytes() for path in by_path}
    after = {path: apply_to(before[path], part) for path, part in by_path.items()}
    done: list[str] = []
    try:
        for path in sorted(after):
            done.append(path)
            _write(Path(root) / path, after[path])
    except OSError:
        for path in done:
            _write(Path(root) / path, before[path])
        raise
    return done


def _write(path: Path, data: bytes) -> None:
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "wb") as f:
        f.write(data)
    os.chmod(name, path.stat().st_mode & 0o7777)
    os.replace(name, path)
