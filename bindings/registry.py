"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from clientlens.params import Params
from clientlens.session import forget, scratch_path, shuffles_freed, tune, written
from clientlens.sources import standins
from clientlens.sources.readers import Tables

PARAMS = Params()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}
#: Roles that other plans compute; their SQL is a view of the same name.
DERIVED: dict[str, Callable[[Context], DataFrame]] = {}

_SOURCE = re.compile(r"(?:FROM|JOIN)\s+([a-z_0-9]+)")


class Context:
    """Driver tables as attributes, bank roles through ``role``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark, folder)
        self.tables = Tables(spark, folder)
        self.p = PARAMS
        self.roles: dict[str, DataFrame] = {}
        self.stages: dict[str, DataFrame] = {}
        self.staging = False

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.tables, name)

    def role(self, name: str) -> DataFrame:
        if name not in self.roles:
            self.roles[name] = DERIVED[name](self) if name in DERIVED else standins.role(self.tables, name, self.stages.get("order-lines"))
        return self.roles[name]

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame that several plans of a query use: stored once where the query asks for it (``staging``), else lazy."""
        if not self.staging:
            return build()
        if name not in self.stages:
            with shuffles_freed(self.spark):
                self.stages[name] = written(build(), name)
        return self.stages[name]

    def drop(self, name: str) -> None:
        """Delete a stored frame that only stored ones were made of."""
        if name in self.stages:
            forget(self.stages.pop(name))

    def order_lines(self) -> DataFrame:
        """Lines with their order's customer; once they are stored, the roles made of both read them."""
        return self.shared("order-lines", lambda: standins.order_lines(self.tables))

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    @cached_property
    def accounts(self) -> DataFrame:
        """Main and other accounts opened with a transaction."""
        return self.role("accounts")

    @cached_property
    def every_account(self) -> DataFrame:
        return self.role("accounts").unionByName(self.role("deposit_accounts"))


VIEWS["every_account"] = "SELECT * FROM accounts UNION ALL SELECT * FROM deposit_accounts"


def view(name: str, sql: str) -> None:
    """Shared piece of oracle SQL."""
    VIEWS[name] = sql


def _text(name: str) -> str | None:
    if name in VIEWS:
        return VIEWS[name]
    return standins.role_sql(name) if name in standins.ROLE_SQL else None


def compose(sql: str) -> str:
    """Prefix the views and roles a statement reads, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _SOURCE.findall(text):
            body = _text(name)
            if body is not None and name not in order:
                visit(body)
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({_text(n)})" for n in order) + "\n" + sql


def query(name: str, sql: str | None = None):
    """Register a function of a Context; without SQL only its rows can be checked."""
    def register(build: Callable[[Context], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Context(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register
