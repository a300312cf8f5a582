"""Settings: dataclass defaults, then a file, then the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

ENV_PREFIX = "ATTESTA_"


@dataclass(frozen=True)
class RunSettings:
    max_iterations: int = 3
    cost_cap_usd: float = 5.0
    data_dir: str = "data"


@dataclass(frozen=True)
class SearchSettings:
    results_per_query: int = 10


@dataclass(frozen=True)
class FetchSettings:
    user_agent: str = "AttestaBot/0.1"
    per_domain_rps: float = 1.0
    max_bytes: int = 5_000_000


@dataclass(frozen=True)
class ChunkSettings:
    target_tokens: int = 512
    overlap_tokens: int = 64
    min_tokens: int = 48


@dataclass(frozen=True)
class DedupSettings:
    cosine_threshold: float = 0.92
    simhash_hamming_max: int = 3


@dataclass(frozen=True)
class RetrieveSettings:
    ann_top_k: int = 200
    rerank_top_k: int = 40


@dataclass(frozen=True)
class TriageSettings:
    confidence_floor: float = 0.3
    passage_chars: int = 6000
    context_tokens: int = 8192


@dataclass(frozen=True)
class VerifySettings:
    enabled: bool = True
    floor: float = -8.0
    max_rewrites: int = 2
    chars_per_chunk: int = 1500
    chars_total: int = 6000


@dataclass(frozen=True)
class ReportSettings:
    max_sections: int = 12
    corpus_budget_tokens: int = 45_000
    section_budget_tokens: int = 6_000


@dataclass(frozen=True)
class Settings:
    run: RunSettings = field(default_factory=RunSettings)
    search: SearchSettings = field(default_factory=SearchSettings)
    fetch: FetchSettings = field(default_factory=FetchSettings)
    chunk: ChunkSettings = field(default_factory=ChunkSettings)
    dedup: DedupSettings = field(default_factory=DedupSettings)
    retrieve: RetrieveSettings = field(default_factory=RetrieveSettings)
    triage: TriageSettings = field(default_factory=TriageSettings)
    verify: VerifySettings = field(default_factory=VerifySettings)
    report: ReportSettings = field(default_factory=ReportSettings)

    def snapshot(self) -> dict[str, Any]:
        return asdict(self)


def _leaves(tree: Mapping[str, Any], at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Any]]:
    """Path and value of everything in a tree of mappings that is not a mapping; empty mappings count as values."""
    for key, value in tree.items():
        if isinstance(value, Mapping) and value:
            yield from _leaves(value, (*at, key))
        else:
            yield (*at, key), value


def overlay(*sources: Mapping[str, Any]) -> dict[str, Any]:
    """One tree from several: of values at one path the last one counts, and a value
    also hides what earlier sources have below its path. No input changes."""
    flat: dict[tuple[str, ...], Any] = {}
    for source in sources:
        for path, value in _leaves(source):
            if value != {} or not any(p[: len(path)] == path for p in flat):
                hidden = [p for p in flat if p[: len(path)] == path or path[: len(p)] == p]
                for p in hidden:
                    del flat[p]
                flat[path] = value
    tree: dict[str, Any] = {}
    for path, value in flat.items():
        node = tree
        for key in path[:-1]:
            node = node.setdefault(key, {})
        node[path[-1]] = value
    return tree


def _build(cls: type, values: Mapping[str, Any]) -> Any:
    hints = get_type_hints(cls)
    given: dict[str, Any] = {}
    for f in fields(cls):
        if f.name not in values:
            continue
        kind, raw = hints[f.name], values[f.name]
        if is_dataclass(kind):
            given[f.name] = _build(kind, raw)
        elif kind is bool and isinstance(raw, str):
            given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
        else:
            given[f.name] = kind(raw)
    return cls(**given)


def _read(path: Path) -> dict[str, Any]:
    body = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        loaded = json.loads(body) if body.strip() else {}
    else:
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError(f"reading {path} needs PyYAML; use a .json file instead") from exc
        loaded = yaml.safe_load(body) or {}
    if not isinstance(loaded, dict):
        raise ValueError(f"{path}: settings are expected as key and value, found {type(loaded).__name__}")
    return loaded


def _from_env(env: Mapping[str, str]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name, value in env.items():
        if name.startswith(ENV_PREFIX) and "__" in name:
            section, key = name[len(ENV_PREFIX) :].lower().split("__", 1)
            out.setdefault(section, {})[key] = value
    return out


def load_settings(path: str | Path | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """Defaults, overlaid by a YAML or JSON file, overlaid by variables such as
    ``ATTESTA_RUN__COST_CAP_USD``. The file may also be named in ``ATTESTA_CONFIG``."""
    env = os.environ if env is None else env
    path = path or env.get(ENV_PREFIX + "CONFIG")
    values: dict[str, Any] = {}
    if path:
        file = Path(path)
        if not file.is_file():
            raise FileNotFoundError(f"no settings file at {file}")
        values = _read(file)
    return _build(Settings, overlay(values, _from_env(env)))
