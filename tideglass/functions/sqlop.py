"""Relational operators as parameterised SQL over DataFrames.

An Op is one SQL text in the dialect that Spark and DuckDB share: `{name}` stands for an input DataFrame, `:name` for
a parameter with a default. Calling it plans the text with Catalyst over the given DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

_TABLE = re.compile(r"\{(\w+)\}")
_PARAM = re.compile(r"(?<![:\w]):([a-z]\w*)")


def literal(value: Any) -> str:
    """A value as a SQL literal; lists become parenthesised lists."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "(" + ", ".join(map(literal, value)) + ")"
    if "\\" in str(value):
        raise ValueError("backslashes are read differently by SQL dialects")
    return "'" + str(value).replace("'", "''") + "'"


class Op:
    """An operator; its inputs are the tables that the text names."""

    def __init__(self, doc: str, text: str, **defaults: Any):
        self.__doc__, self.text, self.defaults = doc, text.strip(), defaults
        self.tables = list(dict.fromkeys(_TABLE.findall(text)))
        self.other: str | None = None
        self.plan: Callable[..., DataFrame] | None = None

    def against(self, text: str) -> Op:
        """Sets a text of another shape that says the same; it is what results are held against."""
        self.other = text.strip()
        return self

    def by(self, plan: Callable[..., DataFrame]) -> Op:
        """Sets a plan that gives the text's rows at less cost; it takes the input tables and the parameters by name."""
        self.plan = plan
        return self

    def sql(self, **params: Any) -> str:
        return self._filled(self.text, params)

    def _filled(self, text: str, params: dict[str, Any]) -> str:
        if unknown := params.keys() - self.defaults.keys():
            raise TypeError(f"unknown parameters: {sorted(unknown)}")
        values = self.defaults | params
        return _PARAM.sub(lambda m: literal(values[m[1]]), text)

    def __call__(self, **given: Any) -> DataFrame:
        frames = {k: given.pop(k) for k in self.tables}
        if self.plan:
            self.sql(**given)  # refuses unknown parameters
            return self.plan(**frames, **(self.defaults | given))
        spark = next(iter(frames.values())).sparkSession
        return spark.sql(self.sql(**given), **frames)

    def oracle(self) -> str:
        """What DuckDB runs to check the operator: the other text if there is one, else the operator's own."""
        if self.other:
            return _TABLE.sub(r"\1", self._filled(self.other, {}))
        # The one function that the dialects name differently; both sequences include their end.
        return _TABLE.sub(r"\1", self.sql()).replace("explode(sequence(", "unnest(generate_series(")
