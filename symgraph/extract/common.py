"""What readers of single files share: their result, and their use over a table of files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from symgraph.schema import CALL, EDGE, NODE, SYMBOL


@dataclass
class Parsed:
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    #: (severity, line, message) of what a tolerant reader passed over.
    diagnostics: list[dict] = field(default_factory=list)


#: The columns of a node that a reader need not give.
BLANK_NODE = {"namespace": None, "signature": None, "parent_fqn": None, "is_virtual": None, "is_pure_virtual": None, "is_static": None, "is_const": None, "is_abstract": None}

_STRUCT = lambda fields: "struct<" + re.sub(r"(\w+) ([\w<>]+)", r"\1:\2", fields) + ">"
_PARTS = ("nodes", "edges", "symbols", "calls", "errors", "diagnostics")
_CALL_FIELDS = CALL.removeprefix("call_id long, ") + ", kind string"
_OUT = (
    f"file string, nodes array<{_STRUCT('label string, ' + NODE)}>, edges array<{_STRUCT(EDGE)}>, symbols array<{_STRUCT(SYMBOL)}>, calls array<{_STRUCT(_CALL_FIELDS)}>, "
    "errors array<string>, diagnostics array<struct<severity:string,line:int,message:string>>"
)


def extract(files: DataFrame, parse: Callable[[bytes, str], Parsed]) -> DataFrame:
    """(file, nodes, edges, symbols, calls, errors, diagnostics) of files (path, content): one row for each file, whatever its content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = parse(content if content is not None else b"", path)
                rows.append({"file": path} | {part: getattr(found, part) for part in _PARTS})
            yield pd.DataFrame(rows, columns=["file", *_PARTS])

    return files.select("path", "content").mapInPandas(run, _OUT)
