"""What the operators share: tables in the shared folder, inputs that may be read again, and ids of any type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.frame import with_row_id
from larkspur.plans.store import kept as keep
from larkspur.plans.store import shared_folder

__all__ = ["fresh", "is_whole", "keep", "named", "numbered", "settled", "shared_folder"]

_SCANS = frozenset({"LogicalRelation", "Project", "Filter"})


def settled(df: DataFrame) -> DataFrame:
    """df, or a table of it if it is more than a scan of files.

    Operators that number rows by their order need a lost task to read the same rows in the same
    order when it runs again. A scan does; what follows a shuffle does not.
    """

    def scans(plan) -> bool:
        below = plan.children()
        return plan.nodeName() in _SCANS and all(scans(below.apply(i)) for i in range(below.size()))

    return df if scans(df._jdf.queryExecution().optimizedPlan()) else keep(df, "settled")


def fresh(taken, *names: str) -> list[str]:
    """These names, each with as many underscores more as it takes to clash with none of those taken."""
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def numbered(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Columns _id and _text, where _id is the rank of an id that is not a whole number, and the table of ranks."""
    rows = docs.select(F.col(doc_id).alias("_name"), F.col(text).alias("_text"))
    ranks = keep(with_row_id(rows.select("_name").where("_name is not null").distinct(), "_name", name="_id"), "ranks")
    return keep(rows.join(ranks, "_name", "left").select("_id", "_text"), "numbered"), ranks


def named(df: DataFrame, ranks: DataFrame, **columns: str) -> DataFrame:
    """df with columns of ranks replaced by the ids: column = new name."""
    for column, name in columns.items():
        ids = ranks.select(F.col("_id").alias("_rank"), F.col("_name").alias("_found"))
        rest = [F.col("_found").alias(name) if c == column else F.col(f"`{c}`") for c in df.columns]
        df = df.join(ids, F.col(column) == F.col("_rank"), "left").select(*rest)
    return df
