"""Engine settings with their ranges; values outside are refused."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Name -> (least, most).
RANGES = {
    "ef_search": (10, 10_000),
    "batch_max": (1, 1024),
    "build_lists": (0, 65_536),
    "train_rows": (1, 1_000_000),
    "cost_scale": (1e-9, 1e9),
    "parallelism": (1, 1_000_000),
}
STRATEGIES = ("auto", "exact", "sq8", "ivf", "ivf_sq8")
PRECISIONS = ("sq8", "full")


@dataclass(frozen=True)
class Settings:
    """enable: off leaves only exact search. force_strategy: auto routes by cost. ef_search: the
    candidate budget of approximate strategies. precision: full leaves strategies that compare 8-bit codes out of automatic choice.
    batch_max: queries served by one pass over the base. build_lists: inverted lists, 0 for the
    square root of the row count. train_rows: bound on the sample that centroids are fitted on.
    cost_scale, parallelism: of the cost model."""

    enable: bool = True
    force_strategy: str = "auto"
    ef_search: int = 100
    precision: str = "sq8"
    batch_max: int = 64
    build_lists: int = 0
    train_rows: int = 50_000
    cost_scale: float = 1.0
    parallelism: int = 8

    def __post_init__(self):
        for name, (least, most) in RANGES.items():
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name}: {getattr(self, name)} is outside {least} to {most}")
        if self.force_strategy not in STRATEGIES:
            raise ValueError(f"force_strategy: one of {', '.join(STRATEGIES)}")
        if self.precision not in PRECISIONS:
            raise ValueError(f"precision: one of {', '.join(PRECISIONS)}")

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)

    @classmethod
    def of(cls, spark) -> Settings:
        """Defaults overridden by `nearfield.<name>` settings of the session."""
        found = {}
        for name, kind in cls.__annotations__.items():
            value = spark.conf.get(f"nearfield.{name}", None)
            if value is not None:
                found[name] = {"bool": lambda v: v.lower() in ("true", "on", "1"), "int": int, "float": float}.get(kind, str)(value)
        return cls(**found)
