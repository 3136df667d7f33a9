"""The library as tools: small answers over its tables, and the gate before anything that writes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import clamp
from .functions.text import WRITING_TOOL
from .operators import graph as G
from .operators import stores as S

WRITES = re.compile(WRITING_TOOL)


@dataclass
class Library:
    """Read tools over nodes and edges, with the limits that keep answers small."""

    nodes: DataFrame
    edges: DataFrame

    def search(self, words: str, limit: int = 25) -> list[dict]:
        return [r.asDict() for r in G.find_nodes(self.nodes, words, limit=clamp(limit, 1, 50)).collect()]

    def neighbours(self, node: str, depth: int = 1) -> dict:
        found, edges = G.neighbourhood(self.edges, [node], clamp(depth, 1, 3))
        rows = self.nodes.join(found, "id", "left_semi").orderBy("ord").limit(60).collect()
        if not any(r.id == node for r in rows) and self.nodes.where(F.col("id") == node).isEmpty():
            return {"node": None, "nodes": [], "edges": []}
        return {"node": node, "nodes": [r.asDict() for r in rows], "edges": [r.asDict() for r in edges.limit(80).collect()]}

    def entities(self, kind: str | None = None, limit: int = 100) -> list[dict]:
        rows = self.nodes.where("type = 'entity'")
        rows = rows.where(F.col("kind") == kind) if kind and "kind" in rows.columns else rows
        return [r.asDict() for r in rows.orderBy(F.desc("mentions"), "ord").limit(clamp(limit, 1, 200)).collect()]

    def counts(self) -> dict:
        return {r.type: r.n for r in self.nodes.groupBy("type").agg(F.count("*").alias("n")).collect()} | {"edges": self.edges.count()}


def recall(memories: DataFrame, query: str, now, k: int = 6) -> str:
    """A block of what the library remembers about a question; '' where that is nothing."""
    rows = S.recall(memories, query, clamp(k, 1, 20), now).collect()
    return "\n".join(f"- [{r.kind}] {r.text.strip()}" for r in rows)


def is_write(server_writable: bool, tool: str) -> bool:
    return server_writable and bool(WRITES.search(tool))


def call(tool: str, arguments: dict, run: Callable[[str, dict], str], *, writable: bool, writes_on: bool = False, approved: bool = False) -> dict:
    """Reads run; writes only with writes switched on and approval, else a preview comes back. Nothing is allowed by default."""
    if not is_write(writable, tool):
        if WRITES.search(tool):
            return {"status": "error", "error": "this server can't write"}
        return {"status": "ok", "result": run(tool, arguments)}
    if not writes_on:
        return {"status": "error", "error": "writes are off"}
    if not approved:
        return {"status": "approval_required", "preview": {"tool": tool, "arguments": arguments}}
    return {"status": "ok", "result": run(tool, arguments)}
