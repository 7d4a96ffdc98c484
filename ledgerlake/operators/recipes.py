"""Recipes: named queries with typed parameters. A condition whose parameter isn't given disappears."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.errors import EngineError
from ledgerlake.operators import governed

TYPES = {"datetime": (datetime,), "date": (date,), "string": (str,), "int": (int,), "decimal": (int, float), "bool": (bool,)}


@dataclass(frozen=True)
class Param:
    name: str
    kind: str
    required: bool = False


@dataclass(frozen=True)
class Bound:
    """A condition that compares a field of a recipe's table with its parameter, so that what is given can be checked against the field before it runs."""

    table: str
    field: str
    operation: str = "eq"

    def __call__(self, value: object) -> Column:
        return governed.COMPARE[self.operation](F.col(self.field), value)


@dataclass(frozen=True)
class Recipe:
    """build gets the tables, the checked values and the joined condition (None if none is left)."""

    name: str
    params: tuple[Param, ...]
    build: Callable[[dict[str, DataFrame], dict, Column | None], DataFrame]
    conditions: tuple[tuple[str, Callable[[object], Column]], ...] = ()
    needs: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        known = {p.name for p in self.params}
        if not re.fullmatch(r"[a-z][a-z0-9_]{0,63}", self.name):
            raise EngineError("params_invalid", "a recipe's name is lower-case letters, digits and underscores")
        if any(p.kind not in TYPES for p in self.params) or any(c not in known for c, _ in self.conditions):
            raise EngineError("params_invalid", f"{self.name} has a parameter of no known type or a condition on no parameter")

    def checked(self, given: dict) -> dict:
        known = {p.name: p for p in self.params}
        if wrong := [*(k for k in given if k not in known), *(p.name for p in self.params if p.required and given.get(p.name) is None)]:
            raise EngineError("recipe_param", f"unknown or missing: {', '.join(wrong)}")
        for k, v in given.items():
            if v is not None and (not isinstance(v, TYPES[known[k].kind]) or (isinstance(v, bool) and known[k].kind != "bool")):
                raise EngineError("recipe_param", f"{k} is a {known[k].kind}")
        return {k: v for k, v in given.items() if v is not None}

    def probe(self, tables: dict[str, DataFrame], policy: governed.Policy, given: dict) -> None:
        """Refuses what a query would refuse: each given value is checked, as it came and before a token is looked up, by the rules for its field."""
        for name, make in self.conditions:
            if isinstance(make, Bound) and given.get(name) is not None:
                value = given[name]
                shown = value if isinstance(value, str) else str(value)
                governed.check_condition(tables[make.table], policy, governed.Condition(make.field, make.operation, shown), make.table)

    def governed(self, tables: dict[str, DataFrame], policy: governed.Policy, **given: object) -> DataFrame:
        """The recipe's rows under a policy: values are probed, tokens stand for what they mean, and the rows are masked, scrubbed of what
        the tokens stand for, and guarded. Parameters that take tokens are strings."""
        values = self.checked(given)
        self.probe(tables, policy, values)
        found: dict[str, list[str]] = {}
        parts = []
        for name, make in self.conditions:
            if name in values:
                bound = isinstance(make, Bound)
                parts.append(governed.condition(tables[make.table], policy, governed.Condition(make.field, make.operation, values[name]), make.table, found) if bound else make(values[name]))
        rows = self.build(tables, values, reduce(lambda a, b: a & b, parts) if parts else None)
        revealed = [(s, token) for token, spelled in found.items() for s in spelled]
        scrubbed = rows.sparkSession.createDataFrame(revealed, "spelling string, token string") if revealed else None
        return governed.mask_rows(rows, policy, scrubbed)

    def run(self, tables: dict[str, DataFrame], **given: object) -> DataFrame:
        values = self.checked(given)
        parts = [make(values[k]) for k, make in self.conditions if k in values]
        return self.build(tables, values, reduce(lambda a, b: a & b, parts) if parts else None)


class Book:
    """Layers of recipes; a later layer's recipe of the same name wins."""

    def __init__(self, *layers: dict[str, Recipe]) -> None:
        self.recipes = {name: (r, n) for n, layer in enumerate(layers) for name, r in layer.items()}

    def get(self, name: str) -> Recipe:
        if name not in self.recipes:
            raise EngineError("recipe_unknown", "there is no such recipe")
        return self.recipes[name][0]

    def applicable(self, tables: set[str]) -> dict[str, bool]:
        return {name: set(r.needs) <= tables for name, (r, _) in sorted(self.recipes.items())}
