"""A catalogue of retrieval operators: table-valued tools with a name, a category, a risk and a parameter schema.

A tool takes a batch of questions as a DataFrame and gives a DataFrame. Tools are looked up by name; unknown
names and dangerous tools without leave are refused before any plan is made. Strategies (routers, rerankers,
compressors) are functions that give columns, and are looked up the same way.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

#: Kinds of tools and their risks, the mildest first.
CATEGORIES = ("retrieval", "analysis", "maintenance", "export", "system")
RISKS = ("SAFE", "CAUTION", "DANGEROUS")
_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    description: str
    category: str = "retrieval"
    risk: str = "SAFE"
    version: str = "1.0"
    given: tuple[str, ...] = ("queries",)

    def schema(self) -> dict:
        """Parameters a caller may set, as a JSON schema; what the catalogue puts in itself is left out."""
        properties, required = {}, []
        for p in inspect.signature(self.run, eval_str=True).parameters.values():
            if p.name in self.given:
                continue
            properties[p.name] = {"type": _TYPES.get(p.annotation, "string")}
            if p.default is inspect.Parameter.empty:
                required.append(p.name)
            else:
                properties[p.name]["default"] = p.default
        return {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": properties, "required": required}}


@dataclass
class Catalogue:
    """Tools and strategies by name; ``resources`` are put into the parameters that bear their names."""

    tools: dict[str, Tool] = field(default_factory=dict)
    strategies: dict[tuple[str, str], Callable[..., Column]] = field(default_factory=dict)
    resources: dict[str, object] = field(default_factory=dict)

    def tool(self, description: str, name: str | None = None, category: str = "retrieval", risk: str = "SAFE", version: str = "1.0"):
        """Decorator that enters a function; its signature becomes the schema."""
        if category not in CATEGORIES or risk not in RISKS:
            raise ValueError(f"unknown category or risk: {category}, {risk}")

        def enter(function):
            given = tuple(p for p in inspect.signature(function).parameters if p == "queries" or p in self.resources)
            key = name or function.__name__
            if key in self.tools:
                raise ValueError(f"two tools named {key}")
            self.tools[key] = Tool(key, function, description, category, risk, version, given)
            return function

        return enter

    def strategy(self, kind: str, name: str):
        """Decorator for a replaceable part: a function of columns to a column."""

        def enter(function):
            self.strategies[kind, name] = function
            return function

        return enter

    def pick(self, kind: str, name: str) -> Callable[..., Column]:
        if (kind, name) not in self.strategies:
            known = sorted(n for k, n in self.strategies if k == kind)
            raise ValueError(f"no {kind} named {name}; there are {known}")
        return self.strategies[kind, name]

    def execute(self, name: str, queries: DataFrame | None = None, allow: str = "CAUTION", **parameters) -> DataFrame:
        """Plan of a tool on a batch of questions. Failed tasks are tried again by Spark."""
        tool = self.tools.get(name)
        if tool is None:
            raise ValueError(f"no tool named {name}; there are {sorted(self.tools)}")
        if RISKS.index(tool.risk) > RISKS.index(allow):
            raise PermissionError(f"{name} is {tool.risk}, and only {allow} is allowed")
        wanted = {p: queries if p == "queries" else self.resources[p] for p in tool.given}
        unknown = set(parameters) - set(tool.schema()["parameters"]["properties"])
        missing = set(tool.schema()["parameters"]["required"]) - set(parameters)
        if unknown or missing:
            raise TypeError(f"{name}: unknown {sorted(unknown)}, missing {sorted(missing)}")
        return tool.run(**wanted, **parameters)

    def listing(self, spark: SparkSession) -> DataFrame:
        """The catalogue as a table."""
        rows = [(t.name, t.category, t.risk, t.version, len(t.schema()["parameters"]["properties"])) for t in self.tools.values()]
        return spark.createDataFrame(rows, "name string, category string, risk string, version string, n_parameters int")


def bounded_rounds(queries: DataFrame, catalogue: Catalogue, plan: Callable[[DataFrame, int], list[tuple[str, DataFrame]]], most: int, key: str = "qid") -> DataFrame:
    """A bounded loop of tool calls over a batch: each round is a plan over the questions still open.

    ``plan(open_queries, round)`` names the tools of a round and the questions each gets; a question is closed
    by the first round that finds rows for it. Rounds are few and fixed, questions as many as there are.
    """
    answers: list[DataFrame] = []
    still = queries
    for number in range(most):
        found = reduce(DataFrame.unionByName, [catalogue.execute(name, asked) for name, asked in plan(still, number)])
        answers.append(found)
        still = still.join(found.select(key).distinct(), key, "left_anti")
    return reduce(DataFrame.unionByName, answers)
