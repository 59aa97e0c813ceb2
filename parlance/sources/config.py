"""Settings: a JSON (or, with PyYAML, YAML) file of profiles and an environment file."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from pathlib import Path


@lru_cache(maxsize=8)
def load_config(path: str) -> dict:
    """A settings file, read once."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("YAML settings need PyYAML; JSON ones do not") from missing
        return yaml.safe_load(text)
    return json.loads(text)


def absolute(value, root: Path):
    """Local paths (``./`` in front) from the root; everything else as it is."""
    return str((root / value).resolve()) if isinstance(value, str) and value.startswith(("./", ".\\")) else value


def model_config(path: str, profile: str | None = None) -> dict:
    """The active profile's blocks with absolute paths, and the settings that hold for all profiles."""
    settings, root = load_config(path), Path(path).resolve().parent.parent
    profile = profile or settings.get("profile", "local")
    out = {module: {k: absolute(v, root) for k, v in values.items()} for module, values in settings[profile].items()}
    caches = {k: absolute(settings.get(k, f"./cache/{d}"), root) for k, d in (("hf_cache", "huggingface"), ("torch_cache", "torch"))}
    return out | caches | {"device": settings.get("device", "cuda"), "profile": profile, "llm": settings.get("llm", {})}


@lru_cache(maxsize=8)
def env_file(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file; comments and blank lines aside, quotes around a value go."""
    found: dict[str, str] = {}
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not key.startswith("#"):
                found[key.strip()] = value.strip().strip("\"'")
    return found


def get_env(key: str, default: str | None = None, path: str = ".env") -> str | None:
    """A variable of the environment, else of the file, else the default."""
    return os.environ.get(key, env_file(path).get(key, default))
