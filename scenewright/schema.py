"""Schemas of the library's inputs and outputs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

COMPONENT = "struct<name:string,material:string,color:string,shape:string,texture:string>"
#: A line of a catalog file: object ids, each with its name and components.
CATALOG_LINE = f"map<string,struct<object:string,components:array<{COMPONENT}>>>"
RELATION = "struct<subject:string,relation:string,reference:string>"
LAYOUT = f"id bigint, description string, objects array<struct<name:string,position:array<double>,rotation:double,size:array<double>>>, relations array<{RELATION}>"
TASK = "question_id bigint, point string, category string, question string, options array<string>, answer string"

#: Question types, with the configurations that each can be asked in.
KINDS: dict[str, list[dict[str, str]]] = {
    **{k: [{"distance_type": t} for t in ("closest", "farthest")] for k in ("what_distance", "where_distance", "list_attribute_distance", "count_attribute_distance")},
    **{k: [{}] for k in ("what_attribute", "list_attribute", "count_attribute", "count_object")},
    **{k: [{"frequency_type": t} for t in ("most", "least")] for k in ("frequent_object", "list_attribute_frequent", "count_attribute_frequent")},
    **{k: [{"size_type": t} for t in ("largest", "smallest")] for k in ("what_size", "list_attribute_size", "count_attribute_size")},
    "where_size": [{"size_type": t, "reference_mode": m} for t in ("largest", "smallest") for m in ("with_reference", "reference_to_target", "no_reference")],
}


@dataclass(frozen=True)
class TaskPlan:
    """What to generate: the question type, the options of a question (2 to 6), the seed, and the type's configuration."""

    generator_type: str
    num_options: int = 4
    seed: int = 42
    generator_config: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.generator_type not in KINDS:
            raise ValueError(f"unknown generator type {self.generator_type!r}")
        if self.num_options not in range(2, 7):
            raise ValueError(f"a question has 2 to 6 options, not {self.num_options}")
        allowed = KINDS[self.generator_type]
        for name in allowed[0]:
            default = "with_reference" if name == "reference_mode" else None
            if self.generator_config.get(name, default) not in {c[name] for c in allowed}:
                raise ValueError(f"{self.generator_type} needs {name}, one of {sorted({c[name] for c in allowed})}")

    def to_dict(self) -> dict:
        return asdict(self)
