"""Typed settings from a YAML or JSON text, with environment variables that win over it."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from rawi.sources.files import substituted

#: Environment variables and the settings that they set.
OVERRIDES = {
    "RAWI_LOCAL_KNOWLEDGE_PATH": ("data", "local_knowledge_path"),
    "RAWI_RHYME_DICT_PATH": ("data", "rhyme_dict_path"),
    "SERPAPI_KEY": ("data", "search_api_key"),
    "OPENAI_API_KEY": ("llm", "openai", "api_key"),
    "ANTHROPIC_API_KEY": ("llm", "anthropic", "api_key"),
    "GEMINI_API_KEY": ("llm", "gemini", "api_key"),
}


@dataclass(frozen=True)
class Data:
    local_knowledge_path: str | None = None
    rhyme_dict_path: str | None = None
    search_api_key: str | None = None
    enable_search: bool = False


@dataclass(frozen=True)
class Settings:
    data: Data = field(default_factory=Data)
    llm: dict[str, dict] = field(default_factory=dict)
    rest: dict = field(default_factory=dict)


def _read(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return json.loads(text or "{}")
    return yaml.safe_load(text) or {}


def settings(text: str = "", env: dict[str, str] | None = None) -> Settings:
    """Settings of a text; ``${NAME}`` in it comes from the environment, and so do the ``OVERRIDES``.

    A key for searches switches them on.  Unknown entries of ``data`` are an
    error; other sections stay in ``rest``.
    """
    env = dict(os.environ) if env is None else env
    tree = _read(substituted(text, env))
    for name, path in OVERRIDES.items():
        if env.get(name):
            at = tree
            for step in path[:-1]:
                at = at.setdefault(step, {})
            at[path[-1]] = env[name]
    data = dict(tree.pop("data", None) or {})
    unknown = set(data) - set(Data.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown data settings {', '.join(sorted(unknown))}")
    if env.get("SERPAPI_KEY"):
        data["enable_search"] = True
    return Settings(Data(**data), tree.pop("llm", None) or {}, tree)
