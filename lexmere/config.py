"""Configuration and ontology, read by the driver."""

from __future__ import annotations

import copy
import os
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import yaml

ENV_PREFIX = "LEXMERE_"
DEFAULTS: dict[str, Any] = {
    "storage": {"path": "lexmere-data"},
    "embedding": {"model": "seeded", "dimensions": 768, "batch_size": 32},
    "chunking": {"max_size": 2000, "window": 3, "threshold": 0.3},
    "search": {"top_k": 10, "rrf_k": 60, "floor": 0.3, "excluded_types": ["heading", "toc", "inventory"], "rerank": "identity"},
    "extraction": {"backend": "regex", "recorded": None},
}


def _merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for k, v in over.items():
        out[k] = _merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load_config(path: str | None = None, env: Mapping[str, str] | None = None, search: tuple[str, ...] = ("lexmere.yaml", "config.yaml")) -> dict[str, Any]:
    """Explicit path, else LEXMERE_CONFIG, else the first file of ``search``, over the defaults.

    LEXMERE_<SECTION>__<KEY> variables win over files. An explicit path that is missing is an error.
    """
    env = os.environ if env is None else env
    named = path or env.get(f"{ENV_PREFIX}CONFIG")
    if named and not os.path.exists(named):
        raise FileNotFoundError(named)
    found = named or next((p for p in search if os.path.exists(p)), None)
    out = copy.deepcopy(DEFAULTS)
    if found:
        with open(found, encoding="utf-8") as f:
            out = _merged(out, yaml.safe_load(f) or {})
    for name, value in env.items():
        if name.startswith(ENV_PREFIX) and "__" in name:
            section, key = name.removeprefix(ENV_PREFIX).lower().split("__", 1)
            out = _merged(out, {section: {key: yaml.safe_load(value)}})
    return out


@dataclass(frozen=True)
class Ontology:
    """Allowed entity and relation types: non-empty, unique and disjoint."""

    entity_types: tuple[str, ...]
    relation_types: tuple[str, ...]

    def __post_init__(self) -> None:
        for name in ("entity_types", "relation_types"):
            kinds = getattr(self, name)
            if not kinds or any(not isinstance(k, str) or not k for k in kinds):
                raise ValueError(f"{name} must be a non-empty list of names")
            if len(set(kinds)) != len(kinds):
                raise ValueError(f"{name} has duplicates")
        if both := set(self.entity_types) & set(self.relation_types):
            raise ValueError(f"types are both entities and relations: {sorted(both)}")


#: The default ontology.
DEFAULT_ONTOLOGY = Ontology(
    ("Document", "Section", "Chunk", "Person", "Org", "Product", "Concept", "Claim", "Metric"),
    ("PART_OF", "MENTIONS", "DEFINED_AS", "AUTHORED_BY", "CITES", "SUPPORTS", "CONTRADICTS", "RELATED_TO", "INSTANCE_OF"),
)


def load_ontology(path: str) -> Ontology:
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if not isinstance(raw, Mapping):
        raise ValueError("an ontology file maps entity_types and relation_types to lists")
    return Ontology(tuple(raw.get("entity_types") or ()), tuple(raw.get("relation_types") or ()))
