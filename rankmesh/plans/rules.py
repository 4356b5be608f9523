"""Tuner rules: JSON text that makes a pattern cheaper for some groups, sizes and element types."""

from __future__ import annotations

import json
from collections.abc import Mapping

from rankmesh.plans.families import PATTERNS
from rankmesh.plans.shapes import Request, Tuner

#: Names of patterns in rules -> the patterns of ``families``.
NAMES = {
    "mesh": "mesh",
    "meshoneshot": "mesh",
    "meshtwoshot": "mesh",
    "ring": "ring",
    "rhd": "halving_doubling",
    "nhr": "uneven_ring",
    "nb": "uneven_bruck",
    "ahc": "asymmetric_levels",
    "star": "star",
}


def load(text: str) -> dict[str, list[Mapping]]:
    """Rules by operator (its name without underscores), from ``{"version": 1, "op_types": {name: {"rules": [...]}}}``."""
    table = json.loads(text)
    if table.get("version") != 1:
        raise ValueError(f"no such version of rules: {table.get('version')}")
    rules = {}
    for name, entry in table.get("op_types", {}).items():
        for rule in entry.get("rules", []):
            if "template" not in rule or "match" not in rule:
                raise ValueError(f"a rule of {name} needs match and template")
            if not float(rule.get("cost", 0.0)) >= 0 and rule.get("cost") != -1:
                raise ValueError(f"a rule of {name} has no legal cost: {rule['cost']}")
        rules[name.lower().replace("_", "")] = list(entry.get("rules", []))
    return rules


def matches(rule: Mapping, ranks: int, size: int, dtype: str) -> bool:
    """Whether the group's ranks and the bytes that a rank holds lie in the rule's ranges, ends included, and the type, where it names one, is the same."""
    match = rule["match"]
    if not match.get("min_ranks", 0) <= ranks <= match.get("max_ranks", ranks):
        return False
    if not match.get("min_bytes", 0) <= size <= match.get("max_bytes", size):
        return False
    return match.get("data_type", dtype).lower() == dtype


def shape_of(template: str) -> str | None:
    """The plan shape for a rule's template; of several patterns in one name, that of the first."""
    own = template.lower()
    for name in sorted(NAMES, key=len, reverse=True):
        if own.startswith(name):
            return PATTERNS[NAMES[name]].shape
    return None


def tuner(rules: Mapping[str, list[Mapping]], operator: str, q: Request, count: int) -> Tuner:
    """The first rule that matches sets the cost of its pattern's plan shape (-1 removes it); without one, costs stay."""

    def tune(costs: dict[str, float]) -> dict[str, float]:
        for rule in rules.get(operator.lower().replace("_", ""), []):
            shape = shape_of(rule["template"])
            if shape in costs and matches(rule, q.comm.size, count * q.dtype.size, q.dtype.name):
                return costs | {shape: float(rule.get("cost", 0.0))}
        return costs

    return tune
