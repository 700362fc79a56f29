"""Settings of a run as one object: executors don't see the driver's environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

#: Passes of ``--all``, and what each needs beside itself.
PASSES = ("vision", "classify", "interpret", "format", "summary")
NEEDS = {"classify": ("vision",)}


@dataclass(frozen=True)
class Config:
    vision: bool = False
    classify: bool = False
    interpret: bool = False
    format: bool = False
    summary: bool = False
    chat_url: str = ""
    chat_model: str = ""
    state_dir: str = ""

    def enabled(self, *passes: str) -> Config:
        """With these passes and all that they need."""
        todo, on = list(passes), set()
        while todo:
            one = todo.pop()
            if one not in PASSES:
                raise ValueError(f"unknown pass: {one}")
            if one not in on:
                on.add(one)
                todo += NEEDS.get(one, ())
        return replace(self, **dict.fromkeys(on, True))

    def with_values(self, values: Mapping[str, str]) -> Config:
        """With settings given as text (KEY=VALUE)."""
        kinds = {f.name: f.type for f in fields(self)}
        unknown = [k for k in values if k.lower() not in kinds]
        if unknown:
            raise ValueError(f"unknown setting: {', '.join(unknown)}")
        return replace(self, **{k.lower(): (v.lower() in ("1", "true", "yes", "on") if kinds[k.lower()] == "bool" else v) for k, v in values.items()})
