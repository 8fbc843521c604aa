"""Writers (S8, S10; S9 is with the features)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage_order(stage: str) -> list[Column]:
    """Seed first, then Feedback 0, 1, 2 … by number."""
    return [(F.col(stage) != "Seed").cast("int"), F.coalesce(F.regexp_extract(stage, r"(\d+)\s*$", 1).try_cast("int"), F.lit(-1)), F.col(stage)]


def stage_table(df: DataFrame, domain: str = "domain", stage: str = "stage") -> DataFrame:
    """Text columns of the stage table, numbers with six decimals, in order."""
    cols = []
    for c in df.columns:
        kind = df.schema[c].dataType.typeName()
        cols.append(F.format_string("%.6f", F.col(c)).alias(c.replace("pass_at_", "pass@")) if kind == "double" else F.col(c).cast("string").alias(c))
    return df.orderBy(domain, *stage_order(stage)).select(*cols)


def write_stage_csv(df: DataFrame, path: str, domain: str = "domain", stage: str = "stage") -> None:
    """One CSV file with a header."""
    stage_table(df, domain, stage).coalesce(1).write.mode("overwrite").csv(path, header=True)


def union_rows(dfs: list[DataFrame]) -> DataFrame:
    """Rows of all tables as text: columns as first seen, empty text for what a table lacks."""
    columns = list(dict.fromkeys(c for df in dfs for c in df.columns))
    text = [df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]) for df in dfs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), text).select(*columns).fillna("")


def union_rows_csv(dfs: list[DataFrame], path: str) -> None:
    union_rows(dfs).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_text_files(df: DataFrame, root: str) -> int:
    """A file for each row (``path``, below ``root``, and ``content``), written by the tasks; returns how many.

    A file appears whole, under another name first, so a task that runs twice does no harm.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                full = f"{base}/{path}"
                store.create_dir(full.rsplit("/", 1)[0], recursive=True)
                own = f"{full.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(content.encode())
                store.move(own, full)
            yield pd.DataFrame({"files": [len(pdf)]})

    return df.select("path", "content").mapInPandas(write, "files long").groupBy().sum("files").first()[0] or 0
