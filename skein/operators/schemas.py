"""Schemas of the tables that operators take and give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

NODES = "id string, seq string, dp double"
EDGES = "src string, dst string, overlap int"
PATHS = "name string, ord long, path array<string>, cov double"
LINKS = "a string, b string, cnt long"
PAIRS = "pair long, fseq string, rseq string"


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with the schema's columns, in its order and types; a missing column is an error that names it."""
    fields = StructType.fromDDL(ddl).fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in fields])
