"""JSON artifacts: one-row documents that stages leave behind."""

from __future__ import annotations

import json

from siderea.sources.shared import filesystem


def read_json(path: str):
    fs, at = filesystem(path)
    with fs.open_input_stream(at) as f:
        return json.loads(bytes(f.read()).decode("utf-8-sig"))


def write_json(path: str, value, compact: bool = False) -> None:
    """Keys sorted, written whole under a temporary name and moved."""
    fs, at = filesystem(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    text = json.dumps(value, sort_keys=True, separators=(",", ":") if compact else None, indent=None if compact else 2, default=str)
    with fs.open_output_stream(at + ".part") as f:
        f.write(text.encode())
    fs.move(at + ".part", at)
