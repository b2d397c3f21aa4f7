"""Ranking by vector similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import cos_similarity


def ranked(df: DataFrame, vector: str, query: list[float], k: int, tie: str) -> DataFrame:
    """The k rows nearest to a query vector by cosine, with ``score``: k rows a task reach the driver side."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.withColumn("score", cos_similarity(F.col(vector), q)).orderBy(F.desc("score"), tie).limit(k)


def cosine_udf(query: list[float]) -> Column:
    """The same score by numpy over Arrow batches, for wide vectors."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    q = np.asarray(query, np.float64)

    @pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(m @ q / (np.linalg.norm(m, axis=1) * np.linalg.norm(q)))

    return score
