"""Gates of one's own: expression builders that are registered by name and checked before a plan is made of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..plans.plan import ACTIONS

#: What an input may be declared as, and how its type is told.
KINDS = ("number", "boolean", "string", "any")


@dataclass(frozen=True)
class Gate:
    """build takes the input columns by name and returns the action, a string column. inputs: column name to kind."""

    name: str
    build: Callable[[Mapping[str, Column]], Column]
    inputs: Mapping[str, str]

    def action(self, df: DataFrame) -> Column:
        """The action over df, a batch or a stream; refused where df lacks an input or the builder gives no string."""
        types = {f.name: f.dataType for f in df.schema.fields}
        lacking = sorted(set(self.inputs) - set(types))
        if lacking:
            raise ValueError(f"gate {self.name}: no column {', '.join(lacking)}")
        for column, kind in self.inputs.items():
            found = types[column]
            fits = kind == "any" or (isinstance(found, NumericType) if kind == "number" else found.typeName() == kind)
            if not fits:
                raise ValueError(f"gate {self.name}: column {column} is {found.simpleString()}, not {kind}")
        out = self.build({c: F.col(f"`{c}`") for c in self.inputs})
        if not isinstance(df.select(out.alias("action")).schema["action"].dataType, StringType):
            raise ValueError(f"gate {self.name}: the action must be a string")
        return out


_GATES: dict[str, Gate] = {}


def register_gate(name: str, build: Callable[[Mapping[str, Column]], Column], inputs: Mapping[str, str], replace: bool = False) -> Gate:
    """Make a gate known by name. It is an expression, so it costs no more than a built-in one and runs on streams as well."""
    unknown = sorted(set(inputs.values()) - set(KINDS))
    if unknown:
        raise ValueError(f"gate {name}: unknown kind {', '.join(unknown)}")
    if name in _GATES and not replace:
        raise ValueError(f"gate {name} is registered")
    _GATES[name] = Gate(name, build, dict(inputs))
    return _GATES[name]


def unregister_gate(name: str) -> None:
    _GATES.pop(name, None)


def gate_names() -> list[str]:
    return sorted(_GATES)


def gate_actions(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """The actions of registered gates over df, by name."""
    unknown = sorted(set(names) - set(_GATES))
    if unknown:
        raise ValueError(f"no gate {', '.join(unknown)}")
    return {name: _GATES[name].action(df) for name in names}


def unknown_actions(df: DataFrame, column: str = "action") -> DataFrame:
    """Rows whose action is none of the known ones, for checking a gate of one's own; null counts as unknown."""
    return df.where(~F.coalesce(F.col(column).isin(*ACTIONS), F.lit(False)))
