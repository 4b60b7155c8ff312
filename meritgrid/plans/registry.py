"""Named queries, their domain views and the SQL texts that check them."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from meritgrid.session import spread

HERE = Path(__file__).parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPREAD = ("orgs",)  # views of short rows and much work on each

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str) -> Callable[[Callable[["Views"], DataFrame]], Callable[["Views"], DataFrame]]:
    """Register ``fn(views)`` as the query ``name``."""

    def register(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        return fn

    return register


class SqlBlock:
    def __init__(self, kind: str, name: str, uses: list[str], sql: str):
        self.kind, self.name, self.uses, self.sql = kind, name, uses, sql


_HEADER = re.compile(r"^-- (cte|query): (\w+)(?: uses: ([\w ]+))?\s*$")


def read_blocks(path: Path) -> list[SqlBlock]:
    blocks: list[SqlBlock] = []
    lines: list[str] = []
    for line in path.read_text().splitlines():
        head = _HEADER.match(line)
        if head:
            lines = []
            blocks.append(SqlBlock(head[1], head[2], (head[3] or "").split(), ""))
        elif blocks:
            lines.append(line)
            blocks[-1].sql = "\n".join(lines).strip()
    return blocks


def _with_clause(name: str, blocks: dict[str, SqlBlock], done: dict[str, str]) -> None:
    for used in blocks[name].uses:
        _with_clause(used, blocks, done)
    if blocks[name].kind == "cte" and name not in done:
        done[name] = blocks[name].sql


def expand(name: str, blocks: dict[str, SqlBlock]) -> str:
    """The block's SQL behind a WITH clause of every view it needs."""
    done: dict[str, str] = {}
    _with_clause(name, blocks, done)
    done.pop(name, None)
    sql = blocks[name].sql
    if not done:
        return sql
    ctes = ",\n".join(f"{key} AS (\n{text}\n)" for key, text in done.items())
    if own := re.match(r"(?i)with(\s+recursive)?\s+", sql):
        return f"WITH{own[1] or ''} {ctes},\n{sql[own.end():]}"
    return f"WITH {ctes}\n{sql}"


def fixture_blocks() -> dict[str, SqlBlock]:
    return {b.name: b for b in read_blocks(HERE / "fixtures.sql")}


def oracle_sql() -> dict[str, str]:
    blocks = fixture_blocks()
    for path in sorted((HERE / "oracles").glob("*.sql")):
        for block in read_blocks(path):
            if block.name in blocks:
                raise ValueError(f"duplicate SQL block {block.name}")
            blocks[block.name] = block
    return {n: expand(n, blocks) for n, b in blocks.items() if b.kind == "query"}


class Views:
    """The driver tables and the domain views of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._fixtures = fixture_blocks()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if f"fx_{name}" in self._fixtures:
            found = self.sql(expand(f"fx_{name}", self._fixtures))
            return spread(found) if name in SPREAD else found
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
