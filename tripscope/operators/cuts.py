"""Cuts of one relation by several dimensions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_each(df: DataFrame, dims: list[str], measures: dict[str, str], min_rows: int = 1) -> DataFrame:
    """One row per (dimension, member) for every dimension, from a single scan with ``GROUPING SETS``.

    ``measures`` maps a name to an aggregate expression; ``n`` is always included and gates small members.
    """
    rows = df.withColumns({f"__{d}": F.coalesce(F.col(d).cast("string"), F.lit("NA")) for d in dims})
    keys = [f"__{d}" for d in dims]
    wide = rows.groupingSets([[k] for k in keys], *keys).agg(
        F.count("*").alias("n"),
        *[F.expr(e).alias(a) for a, e in measures.items()],
        *[F.grouping(k).alias(f"__is{k}") for k in keys],
    )
    dimension = F.lit(None).cast("string")
    for k in keys:
        dimension = F.when(F.col(f"__is{k}") == 0, F.lit(k[2:])).otherwise(dimension)
    return wide.filter(F.col("n") >= min_rows).select(dimension.alias("dimension"), F.coalesce(*keys).alias("member"), "n", *measures)


def by_each_sql(dims: list[str], measures: dict[str, str], min_rows: int = 1) -> str:
    """The same as a union of plain group-bys; ``{src}`` stands for the input."""
    parts = [
        f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), 'NA') AS member, count(*) AS n, "
        + ", ".join(f"{e} AS {a}" for a, e in measures.items())
        + f" FROM ({{src}}) GROUP BY 2 HAVING count(*) >= {min_rows}"
        for d in dims
    ]
    return " UNION ALL ".join(parts)
