"""Column roles of a modelling table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class TableSpec:
    """Which columns are the row id, the 0/1 target, 0/1 flags and numeric features.

    Flags are model inputs that are never scaled; numerics are scaled.
    ``features`` keeps the scaled-table order: numerics first, then flags.
    """

    id: str
    label: str
    numerics: tuple[str, ...] = field(default_factory=tuple)
    flags: tuple[str, ...] = field(default_factory=tuple)

    @property
    def features(self) -> list[str]:
        return [*self.numerics, *self.flags]

    def only(self, columns) -> "TableSpec":
        keep = list(columns)
        return replace(
            self,
            numerics=tuple(c for c in self.numerics if c in keep),
            flags=tuple(c for c in self.flags if c in keep),
        )

    def without(self, columns) -> "TableSpec":
        drop = set(columns)
        return replace(
            self,
            numerics=tuple(c for c in self.numerics if c not in drop),
            flags=tuple(c for c in self.flags if c not in drop),
        )


# The driver-table fixture used by tests, queries and the bench.
EV_SPEC = TableSpec(
    id="event_id",
    label="label",
    numerics=("value", "hr", "k", "usr_events", "usr_value", "const"),
    flags=("night", "even_user", "big"),
)

# Same rows, the learnable target and three informative features.
LEARN_SPEC = TableSpec(id="event_id", label="learn", numerics=("value", "hr", "k"), flags=())

# The same target from features with few values, for boosting's thresholds.
LEARN_BOOST = TableSpec(id="event_id", label="learn", numerics=("hr", "k", "usr_events"), flags=("night", "even_user", "big"))
