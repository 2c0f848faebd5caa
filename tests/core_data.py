"""A small catalog and layouts for the tests."""

from __future__ import annotations

import json
import random

PARTS = {
    "o1": ("chair", [("seat", "wood", "brown", "flat", "smooth"), ("leg", "metal", "black", "cylinder", "")]),
    "o2": ("table", [("top", "wood", "white", "rectangle", "glossy"), ("leg", "wood", "white", "cylinder", None)]),
    "o3": ("lamp", [("shade", "fabric", "white", "cone", "soft"), ("base", "metal", "gold", "cylinder", None)]),
    "o4": ("book", [("cover", "paper", "red", "rectangle", "smooth")]),
    "o5": ("chair", [("seat", "plastic", "blue", "curved", "smooth")]),
    "o6": ("rock", []),
}
FIELDS = ("name", "material", "color", "shape", "texture")


def catalog_lines(extra: int = 0) -> str:
    def entry(name, parts):
        return {"object": name, "components": [{k: v for k, v in zip(FIELDS, p) if v is not None} for p in parts]}

    lines = [json.dumps({k: entry(*PARTS[k]) for k in ("o1", "o2")}), "", json.dumps({"o3": entry(*PARTS["o3"])})]
    lines += [json.dumps({k: entry(*PARTS[k])}) for k in ("o4", "o5", "o6")]
    rng = random.Random(1)
    values = {"material": "wood metal glass stone paper wax".split(), "color": "red blue green white black pink".split(), "shape": "round flat long square curved thin".split(), "texture": "smooth rough soft glossy matte bumpy".split()}
    for i in range(extra):
        parts = [("part" + str(j), *[rng.choice(values[a]) for a in ("material", "color", "shape", "texture")]) for j in range(rng.randint(1, 3))]
        lines.append(json.dumps({f"x{i:03d}": entry(f"thing{i}", parts)}))
    return "\n".join(lines) + "\n"


def layouts() -> list[dict]:
    box = lambda name, at, turn, half: dict(name=name, position=list(map(float, at)), rotation=float(turn), size=[half] * 3)
    three = [box("obj_0", (0, 1.6, 0), 0, 1.6), box("obj_1", (4, 1, 1), 90, 1.0), box("obj_2", (0.2, 3.8, 0.1), 0, 0.6)]
    first = dict(id=0, description="The [obj_1] is beside the [obj_0].", objects=three, relations=[dict(subject="obj_1", relation="beside", reference="obj_0")])
    rng = random.Random(3)
    made = [first]
    for i in range(1, 12):
        n = rng.randint(2, 9)
        objects = [{"name": f"obj_{k}", "position": [rng.uniform(-5, 5), 1.0, rng.uniform(-5, 5)], "rotation": 15.0 * k, "size": [rng.uniform(0.5, 1.8) for _ in range(3)]} for k in range(n)]
        made.append({"id": i, "description": "Some things.", "objects": objects, "relations": []})
    made.append({"id": 99, "description": "One.", "objects": made[1]["objects"][:1], "relations": []})
    return made
