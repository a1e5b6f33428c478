"""Named sets of thresholds."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Recipe:
    min_chars: int = 300
    max_chars: int = 8192
    quality: float = 6.0
    similarity: float = 0.85
    min_density: float = 0.35
    entropy: float = 3.0


#: Fixed values.
RECIPES = {
    "strict": Recipe(500, 4096, 7.5, 0.80, 0.45, 3.5),
    "balanced": Recipe(300, 8192, 6.0, 0.85, 0.35, 3.0),
    "lenient": Recipe(150, 16384, 4.0, 0.90, 0.25, 2.5),
}


def recipe(name: str = "balanced", config: str | None = None, **overrides) -> Recipe:
    """A named recipe, then the settings of a JSON file, then explicit ones; each outranks the one before."""
    found = RECIPES[name]
    if config is not None:
        with open(config) as file:
            found = replace(found, **{k: v for k, v in json.load(file).items() if k in asdict(found)})
    return replace(found, **{k: v for k, v in overrides.items() if v is not None})


def save(chosen: Recipe, path: str) -> None:
    with open(path, "w") as file:
        json.dump(asdict(chosen), file, indent=2)
