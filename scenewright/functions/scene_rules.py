"""The rules of a scene description for one text, where a provider decides whether to ask again; tables are checked by ``operators.dsl``."""

from __future__ import annotations

import json
import re

from ..enums import LEAST_OBJECTS, MOST_OBJECTS, RELATIONS, SIZES

_FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)


def _listed(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _object_error(o, i: int) -> str | None:
    o = o if isinstance(o, dict) else {}
    for f in ("name", "size", "rotation"):
        if f not in o:
            return f"Object {i}: missing required field '{f}'"
    if not isinstance(o["name"], str) or not o["name"].strip(" "):
        return f"Object {i}: 'name' must be a non-empty string"
    if not isinstance(o["size"], str) or o["size"] not in SIZES:
        return f"Object {i}: invalid size '{o['size']}'. Must be one of {_listed(SIZES)}"
    if not isinstance(o["rotation"], int | float):
        return f"Object {i}: 'rotation' must be a number"
    return None


def _relation_error(r, i: int, names: list[str]) -> str | None:
    r = r if isinstance(r, dict) else {}
    for f in ("subject", "relation", "reference"):
        if f not in r:
            return f"Relation {i}: missing required field '{f}'"
    for f in ("subject", "reference"):
        if r[f] not in names:
            return f"Relation {i}: {f} '{r[f]}' not found in objects"
    if r["subject"] == r["reference"]:
        return f"Relation {i}: subject and reference cannot be the same object"
    if r["relation"] not in RELATIONS:
        return f"Relation {i}: invalid relation '{r['relation']}'. Must be one of {_listed(RELATIONS)}"
    return None


def scene_error(response: str | None) -> str | None:
    """The message of the first rule that fails, or None."""
    block = _FENCED.search(response or "")
    try:
        d = json.loads(block[1] if block else response or "")
    except ValueError:
        return "Invalid JSON"
    if not isinstance(d, dict):
        return "Invalid JSON"
    if "description" not in d and "descirption" not in d:
        return "Missing required field 'description'"
    if "objects" not in d:
        return "Missing required field 'objects'"
    objects = d["objects"]
    if not isinstance(objects, list):
        return "'objects' must be a list"
    if not LEAST_OBJECTS <= len(objects) <= MOST_OBJECTS:
        return f"Object count must be between {LEAST_OBJECTS} and {MOST_OBJECTS}, got {len(objects)}"
    for i, o in enumerate(objects):
        if error := _object_error(o, i):
            return error
    for size in ("largest", "smallest"):
        if all(o["size"] != size for o in objects):
            return f"Missing required '{size}' sized object"
    if "relations" not in d:
        return "Missing required field 'relations'"
    if not isinstance(d["relations"], list):
        return "'relations' must be a list"
    names = [o["name"] for o in objects]
    for i, r in enumerate(d["relations"]):
        if error := _relation_error(r, i, names):
            return error
    text = str(d.get("description", d.get("descirption", ""))).lower()
    for n in names:
        if n.lower() not in text:
            return f"Description must contain object name '{n}'"
    return "Object names must be different" if len(set(names)) < len(names) else None
