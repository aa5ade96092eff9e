"""Named queries over the driver tables, each with its check SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from skein.plans.fixtures import Fixtures, oracle


class Query(NamedTuple):
    run: Callable[[Fixtures], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Fixtures], DataFrame]], Callable]:
    def register(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(fn, oracle(sql) if sql else None)
        return fn

    return register


def load_all() -> dict[str, Query]:
    from skein.plans import (  # noqa: F401
        catalog_pages,
        catalog_reader,
        catalog_scalars,
        catalog_streams,
        catalog_tables,
    )

    return CATALOG
