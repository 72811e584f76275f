"""Named functions that agents and SQL statements can call: registration, look-up and search."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"[a-z][a-z0-9_]*")
#: the SQL types of annotated parameters
TYPES = {"int": "long", "float": "double", "str": "string", "bool": "boolean"}


@dataclass(frozen=True)
class Tool:
    app: str
    name: str
    call: Callable
    description: str = ""
    category: str = "general"
    tags: tuple[str, ...] = ()
    essential: bool = False
    returns: str = "string"
    parameters: tuple[tuple[str, str, bool], ...] = field(default=())  # name, type, required

    @property
    def full_name(self) -> str:
        return f"{self.app}.{self.name}"


class Registry:
    def __init__(self):
        self._tools: dict[str, Tool] = {}

    def tool(self, app: str, name: str, description: str = "", category: str = "general", tags: tuple[str, ...] = (), essential: bool = False, returns: str = "string", schema: dict[str, str] | None = None):
        """A decorator. Names are lower case; parameters come from ``schema`` (name to SQL type), else from the function's signature."""
        for n in (app, name):
            if not isinstance(n, str) or not NAME.fullmatch(n):
                raise ValueError(f"no name: {n!r}")
        if schema is not None and not (isinstance(schema, dict) and all(isinstance(t, str) for t in schema.values())):
            raise TypeError("a schema gives each parameter's type")

        def wrap(f: Callable) -> Callable:
            signature = inspect.signature(f).parameters.values()
            kinds = schema or {p.name: TYPES.get(getattr(p.annotation, "__name__", str(p.annotation)), "string") for p in signature if p.name != "self"}
            required = {p.name for p in signature if p.default is inspect.Parameter.empty}
            doc = description or (inspect.getdoc(f) or "").split("\n")[0]
            self.add(Tool(app, name, f, doc, category, tuple(tags), essential, returns, tuple((k, t, k in required) for k, t in kinds.items())))
            return f

        return wrap

    def add(self, tool: Tool) -> None:
        if tool.full_name in self._tools:
            raise ValueError(f"{tool.full_name} is there already")
        self._tools[tool.full_name] = tool

    def get(self, app: str, name: str) -> Tool | None:
        return self._tools.get(f"{app}.{name}")

    def of_app(self, app: str) -> list[Tool]:
        return [t for t in self._tools.values() if t.app == app]

    def of_category(self, category: str) -> list[Tool]:
        return [t for t in self._tools.values() if t.category == category]

    def table(self, spark: SparkSession) -> DataFrame:
        """The registry as rows, which ``filters.search_tools`` searches."""
        rows = [(t.app, t.name, t.description, t.category, list(t.tags), t.essential, len(t.parameters)) for t in self._tools.values()]
        return spark.createDataFrame(rows, "app string, name string, description string, category string, tags array<string>, essential boolean, n_parameters int")

    def statistics(self) -> dict:
        count = lambda key: {k: sum(key(t) == k for t in self._tools.values()) for k in sorted({key(t) for t in self._tools.values()})}
        return {"total": len(self._tools), "essential": sum(t.essential for t in self._tools.values()), "by_app": count(lambda t: t.app), "by_category": count(lambda t: t.category)}

    def publish(self, spark: SparkSession) -> list[str]:
        """Every function under ``app_name`` in SQL statements of the session."""
        for t in self._tools.values():
            spark.udf.register(f"{t.app}_{t.name}", t.call, t.returns)
        return [f"{t.app}_{t.name}" for t in self._tools.values()]


@dataclass(frozen=True)
class FilterField:
    name: str
    kind: str
    label: str = ""
    options: tuple[str, ...] = ()
    default: object = None


@dataclass(frozen=True)
class Connector:
    name: str
    app_group: str
    auth: str
    filters: tuple[FilterField, ...]
    schedule_minutes: int


class ConnectorBuilder:
    """A connector's settings, put together step by step and checked at the end."""

    KINDS = ("string", "boolean", "datetime", "list", "number", "multiselect")

    def __init__(self, name: str):
        self._name, self._group, self._auth, self._filters, self._schedule = name, "", "none", {}, 60

    def in_group(self, group: str) -> ConnectorBuilder:
        self._group = group
        return self

    def with_auth(self, auth: str) -> ConnectorBuilder:
        self._auth = auth
        return self

    def every(self, minutes: int) -> ConnectorBuilder:
        self._schedule = minutes
        return self

    def add_filter_field(self, f: FilterField) -> ConnectorBuilder:
        if f.kind not in self.KINDS:
            raise ValueError(f"no kind of filter: {f.kind!r}")
        if f.name in self._filters:
            raise ValueError(f"filter {f.name} is there already")
        self._filters[f.name] = f
        return self

    def build(self) -> Connector:
        if not self._name.strip() or not self._group.strip() or self._schedule < 1:
            raise ValueError("a connector has a name, a group and a schedule of a minute or more")
        return Connector(self._name.strip(), self._group, self._auth, tuple(self._filters.values()), self._schedule)
