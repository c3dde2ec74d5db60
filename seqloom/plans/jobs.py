"""Job specifications: a YAML file names operations in order; objects come from a registry, never from code in the file."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

OPERATIONS = ("train", "evaluate", "analyze")
ANALYSES = ("variant_effect_prediction", "in_silico_mutagenesis", "prediction")
_VARIABLE = re.compile(r"\$\{(\w+)\}")


@dataclass(frozen=True)
class Deferred:
    """A registered callable with keywords, made only when the job runs."""

    make: Callable[..., Any]
    keywords: Mapping[str, Any] = field(default_factory=dict)

    def bound(self, **more) -> Deferred:
        return Deferred(self.make, {**self.keywords, **more})


class Registry:
    def __init__(self):
        self.known: dict[str, Callable[..., Any]] = {}

    def register(self, name: str, make: Callable[..., Any]) -> None:
        self.known[name] = make

    def find(self, name: str) -> Callable[..., Any]:
        if name not in self.known:
            raise KeyError(f"{name} is not registered")
        return self.known[name]


def substituted(text: str, environment: Mapping[str, str] | None = None) -> str:
    """``${NAME}`` from the environment; an unknown name is an error."""
    env = os.environ if environment is None else environment
    return _VARIABLE.sub(lambda m: env[m[1]], text)


def load(text: str, registry: Registry, environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    """A specification with ``!obj:name {keywords}``, ``!import name`` and ``!float`` nodes."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_multi_constructor("!obj:", lambda loader, name, node: Deferred(registry.find(name), loader.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else {}))
    Loader.add_constructor("!import", lambda loader, node: registry.find(loader.construct_scalar(node)))
    Loader.add_constructor("!float", lambda loader, node: float(loader.construct_scalar(node)))
    spec = yaml.load(substituted(text, environment), Loader=Loader)  # noqa: S506: a SafeLoader with a registry
    check(spec)
    return spec


def check(spec: Mapping[str, Any]) -> None:
    ops = spec.get("ops", [])
    unknown = [o for o in ops if o not in OPERATIONS]
    if not ops or unknown:
        raise ValueError(f"ops must be some of {OPERATIONS}: {ops}")


def instantiate(node: Any) -> Any:
    """Make every deferred object, inner ones first."""
    if isinstance(node, Deferred):
        return node.make(**{k: instantiate(v) for k, v in node.keywords.items()})
    if isinstance(node, Mapping):
        return {k: instantiate(v) for k, v in node.items()}
    if isinstance(node, list | tuple):
        return type(node)(instantiate(v) for v in node)
    return node


def execute(spec: Mapping[str, Any], **given) -> list[tuple[str, Any]]:
    """Run the operations in listed order; analyses in their fixed order. ``given`` (a session, a model) is bound late."""
    done = []
    for op in spec["ops"]:
        node = spec[op]
        parts = [(a, node[a]) for a in ANALYSES if a in node] if op == "analyze" and isinstance(node, Mapping) else [(op, node)]
        for name, part in parts:
            done.append((name, instantiate(part.bound(**given) if isinstance(part, Deferred) else part)))
    return done


def output_name(source: str, suffix: str) -> str:
    """The file's name without folders and its last extension, then the suffix."""
    return f"{os.path.basename(source).rsplit('.', 1)[0]}_{suffix}"
