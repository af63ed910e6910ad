"""An installation's settings: a file, then overrides by name, then a check."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Where things lie and how work is done; ``speakers`` is the acoustic diarizer's most."""

    storage: str = "recordings"
    index: str = "index"
    organization: str = "default"
    workers: int = 1
    lock_seconds: int = 3600
    context_tokens: int = 8192
    speakers: int = 4

    def checked(self) -> Settings:
        """The same, if all texts say something and all numbers are 1 at least."""
        for f in fields(self):
            v = getattr(self, f.name)
            if (not v.strip()) if isinstance(v, str) else v < 1:
                raise ValueError(f"{f.name} cannot be {v!r}")
        return self


def _read(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{path} needs a YAML reader; JSON needs none") from None
        return yaml.safe_load(text) or {}
    return json.loads(text)


def loaded(path: str | None = None, lookup: Callable[[str], str | None] = os.environ.get) -> Settings:
    """Settings from a JSON or YAML file, overridden by what ``lookup`` gives for ``PARLANCE_`` and a setting's name.

    A file that is asked for has to be there and may name known settings only.
    A blank override, or one that is no number where a number is wanted, is left out.
    """
    found = {} if path is None else _read(Path(path))
    known = {f.name: type(f.default) for f in fields(Settings)}
    wrong = [k for k, v in found.items() if k not in known or type(v) is not known[k]]
    if wrong:
        raise ValueError(f"{path}: unknown setting or wrong type: {', '.join(map(str, wrong))}")
    out = Settings(**found)
    for name, kind in known.items():
        said = (lookup(f"PARLANCE_{name.upper()}") or "").strip()
        if said and (kind is str or said.isdecimal()):
            out = replace(out, **{name: kind(said)})
    return out.checked()
