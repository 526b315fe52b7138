"""Taking rows in by their seq: batches whose rows, rejects and offset are one commit, so that what was stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mnesis.sources.commits import Change, Store

REJECT = "seq long, error string"


def guarded(rows: DataFrame, make: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, size: int = 32) -> DataFrame:
    """What make() makes of the rows (with seq), `size` at a time: a row for each of its rows, of the schema and with `seq` and `error`. Where make() fails, rows are tried
    one by one; those that fail come with the error and nulls."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [n for n in fields.fieldNames() if n != "seq"]
    out = StructType([*rows.select("seq").schema, *[StructField(f.name, f.dataType, True) for f in fields if f.name != "seq"], StructField("error", StringType())])

    def tried(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            made = make(part)
            if len(made) != len(part):
                raise ValueError(f"{len(made)} rows for {len(part)}")
            got = pd.DataFrame({n: made[n].to_numpy() for n in names})
            got.insert(0, "seq", part["seq"].to_numpy())
            got["error"] = None
            yield got
        except Exception as e:  # noqa: BLE001 - a bad row must not hold up the others
            if len(part) > 1:
                for i in range(len(part)):
                    yield from tried(part.iloc[i : i + 1])
            else:
                got = pd.DataFrame({"seq": part["seq"].to_numpy(), **{n: [None] for n in names}})
                got["error"] = f"{type(e).__name__}: {e}"[:500]
                yield got

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), size):
                yield from tried(b.iloc[i : i + size])

    return rows.mapInPandas(run, out)


def ingest(store: Store, table: str, rows: DataFrame, make: Callable[[DataFrame], DataFrame], stream: str, span: int = 100_000, most: int | None = None) -> int:
    """Take in the rows whose seq is beyond the stream's offset, `span` numbers of seq at a time, `most` batches at most; how many were taken.

    make(batch) gives the table's rows with `seq` and `error`; those with an error go to the table `rejects` (seq, error). Offsets are marks of the commits, so that a batch
    is there with its rejects and its offset, or not at all. Rows without a seq are not taken. seq of a source that grows must rise.
    """
    done = 0
    top = rows.agg(F.max("seq").alias("top")).first().top
    while top is not None and (most is None or done < most):
        after = store.marks().get(stream, -1)
        if after >= top:
            break
        first = rows.where(F.col("seq") > after).agg(F.min("seq").alias("s")).first().s
        last = min(top, first + span - 1)
        made = make(rows.where((F.col("seq") >= first) & (F.col("seq") <= last))).persist()
        good = made.where("error IS NULL")
        bad = made.where("error IS NOT NULL").select("seq", "error")
        store.commit("ingest", {table: Change("append", good), "rejects": Change("append", bad)}, mark=(stream, int(last)))
        made.unpersist()
        done += 1
    return done
