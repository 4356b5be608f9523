"""Groups of ranks from a rank table: JSON text that says which instance of each network layer a rank belongs to."""

from __future__ import annotations

import json

from rankmesh.model import MOST_LEVELS, Comm


def from_rank_table(text: str) -> Comm:
    """A group from ``{"rank_count": n, "rank_list": [{"rank_id": r, "level_list": [{"net_layer": k, "net_instance_id": name}, ...]}, ...]}``.

    Other keys are ignored. Level k of the group has a number for each instance of
    the k-th lowest layer, in order of the lowest rank in it. ValueError if ranks
    aren't 0 to n - 1, a rank lacks a layer that another has, or an instance of one
    layer is spread over several of the layer above.
    """
    table = json.loads(text)
    ranks = {}
    for entry in table["rank_list"]:
        own = {int(level["net_layer"]): str(level["net_instance_id"]) for level in entry.get("level_list", [])}
        if ranks.setdefault(int(entry["rank_id"]), own) is not own:
            raise ValueError(f"rank {entry['rank_id']} comes twice")
    size = len(ranks)
    if sorted(ranks) != list(range(size)) or size != int(table.get("rank_count", size)):
        raise ValueError("ranks have to be 0 to the number of ranks less one")
    layers = sorted({k for own in ranks.values() for k in own})
    if len(layers) > MOST_LEVELS:
        raise ValueError(f"a hierarchy has {MOST_LEVELS} levels at most")
    levels: list[tuple[int, ...]] = []
    for layer in layers:
        if missing := [r for r in range(size) if layer not in ranks[r]]:
            raise ValueError(f"rank {missing[0]} has no layer {layer}")
        number: dict[str, int] = {}
        levels.append(tuple(number.setdefault(ranks[r][layer], len(number)) for r in range(size)))
    for low, high in zip(levels, levels[1:]):
        if len(set(zip(low, high, strict=True))) != len(set(low)):
            raise ValueError("an instance of a layer is spread over several of the layer above")
    return Comm(size, tuple(levels))
