"""Query registry: each entry pairs a Spark plan with the same question in plain SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from veil.plans.derived import DERIVED, Tables


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    oracle: str | None
    why_rows_only: str | None = None


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: str, oracle: str | None = None, rows_only: str | None = None):
    """Register a query under a readable name for the given inventory ids."""

    def wrap(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        text = with_derived(oracle) if oracle else None
        REGISTRY[name] = Entry(name, tuple(ids.split()), build, text, rows_only)
        return build

    return wrap


def _needed(sql: str, seen: list[str]) -> list[str]:
    """Derived tables a text refers to, dependencies first."""
    for name, body in DERIVED.items():
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(body, seen)
            if name not in seen:
                seen.append(name)
    return seen


def _means(sql: str) -> str:
    """`exact_mean(x)` written out: decimals are summed and divided once, as `functions.numbers` does."""
    return re.sub(r"exact_mean\(([^()]*)\)", r"round(CAST(sum(CAST(\1 AS DECIMAL(38, 12))) AS DOUBLE) / count(\1), 6)", sql)


def with_derived(sql: str) -> str:
    """Prefix a text with the derived tables it names as common table expressions."""
    sql = _means(sql)
    names = _needed(sql, [])
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({DERIVED[n].strip()})" for n in names)
    body = sql.strip()
    if re.match(r"(?is)^with\s+recursive\s", body):
        return f"WITH RECURSIVE {ctes},\n{body[body.lower().index('recursive') + 9:].strip()}"
    if re.match(r"(?is)^with\s", body):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"


def load() -> dict[str, Entry]:
    """Import every plan module once and return the filled registry."""
    from veil.plans import (  # noqa: F401
        answers,
        catalogue,
        evaluation,
        masking,
        ordered,
        privacy,
        prompts,
        quality,
        report,
        rounds,
        skills,
        sources,
        streams,
    )

    return REGISTRY


def callable_for(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # epoch and date texts must not depend on where the session runs
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return entry.build(Tables(spark, sf_dir))

    return run
