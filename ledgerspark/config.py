"""Settings: a YAML or JSON file, then the environment; read by dotted names."""

from __future__ import annotations

import json
import logging
import os
from functools import lru_cache
from typing import Any

try:
    import yaml
except ImportError:  # YAML files need it, JSON files do not
    yaml = None

ENV = "LEDGERSPARK_"
DEFAULTS: dict[str, Any] = {
    "retrieval": {"candidate_top_k": 120, "year_tolerance": 2, "selector": {"min_tables": 2, "max_tables": 16, "score_ratio": 0.35}},
    "execution": {"timeout_sec": 15, "max_attempts": 3},
    "submission": {"fallback_answer": 0.0, "csv_prefix": "data/"},
}


def _merge(base: dict, over: dict) -> dict:
    return base | {k: _merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


class Settings:
    """Values of DEFAULTS, the file at path, and variables such as LEDGERSPARK_EXECUTION__TIMEOUT_SEC; later ones win."""

    def __init__(self, path: str | None = None, env: dict[str, str] | None = None):
        given: dict[str, Any] = {}
        if path:
            with open(path, encoding="utf-8") as f:
                if path.endswith(".json"):
                    given = json.load(f)
                elif yaml:
                    given = yaml.safe_load(f) or {}
                else:
                    raise RuntimeError("YAML settings need the yaml package; give a .json file")
        self._values = _merge(DEFAULTS, given)
        for name, text in sorted((os.environ if env is None else env).items()):
            if name.startswith(ENV):
                keys = name[len(ENV) :].lower().split("__")
                try:
                    value = json.loads(text)
                except ValueError:
                    value = text
                for k in reversed(keys):
                    value = {k: value}
                self._values = _merge(self._values, value)

    def get(self, name: str, default: Any = None) -> Any:
        """The value at a.b.c, or default where a part is missing."""
        at: Any = self._values
        for k in name.split("."):
            if not isinstance(at, dict) or k not in at:
                return default
            at = at[k]
        return at


@lru_cache(maxsize=1)
def settings() -> Settings:
    """Those of this process: the file in LEDGERSPARK_CONFIG, if any."""
    return Settings(os.environ.get(f"{ENV}CONFIG"))


def logger(name: str, level: int = logging.INFO) -> logging.Logger:
    """A logger under this package's; its one handler is added once."""
    root = logging.getLogger("ledgerspark")
    if not root.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        root.addHandler(handler)
        root.setLevel(level)
    return root.getChild(name)
