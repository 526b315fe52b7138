"""Files for people and other programs: change lists as CSV, drafts, proposals and reports as JSON lines. Each task writes its own; nothing passes through one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_list(changes: DataFrame, path: str) -> None:
    """CSV with a header in each file; times as ISO text, nulls as nothing. Arrays and structs stand as JSON."""
    cols = [F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in changes.dtypes]
    changes.select(*cols).write.mode("errorifexists").option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def proposals(rows: DataFrame, path: str, nulls: bool = False) -> None:
    """JSON lines; nulls are left out unless asked for."""
    rows.write.mode("errorifexists").option("ignoreNullFields", not nulls).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)
