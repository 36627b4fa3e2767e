"""Report sinks (K1, K2): documents from small result tables, files from large ones."""

from __future__ import annotations

import json
import math
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row


def _plain(v: Any) -> Any:
    """Values as JSON has them: rows as objects, dates as ISO text, infinite and undefined numbers as null."""
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, list | tuple):
        return [_plain(x) for x in v]
    if isinstance(v, float):
        return None if not math.isfinite(v) else int(v) if v.is_integer() else v
    return v.isoformat() if isinstance(v, date | datetime) else v


def document(tables: dict[str, DataFrame], *, most: int = 5000, **fields: Any) -> str:
    """K1: a two-space JSON document of a report's fields and its (bounded) tables.

    A table of more than `most` rows is not for a document: write it with `save`.
    """
    out = dict(fields)
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows: use save")
        out[name] = _plain(rows)
    return json.dumps(out, indent=2, ensure_ascii=False)


def write(path: str, text: str) -> None:
    Path(path).write_text(text, encoding="utf-8")


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """K1 for large results: files written by the executors."""
    df.write.mode("overwrite").format(kind).save(path)


def console(df: DataFrame, n: int = 20, width: int = 45) -> str:
    """K2: the first n rows, padded."""
    rows = df.limit(n).collect()
    lines = [[c[:width] for c in df.columns], *[[f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)[:width] for v in r] for r in rows]]
    widths = [max(len(x[i]) for x in lines) for i in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in lines)
