from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources.balance import balanced_predicates


def sizes(df, predicates):
    """Rows of each part; every row has to meet one condition."""
    met = [F.expr(p).cast("int") for p in predicates]
    counts = df.agg(*[F.sum(F.coalesce(m, F.lit(0))).alias(f"p{i}") for i, m in enumerate(met)],
                    F.count_if(sum((F.coalesce(m, F.lit(0)) for m in met), F.lit(0)) != 1).alias("wrong"),
                    F.count(F.lit(1)).alias("all")).first()
    assert counts.wrong == 0 and sum(counts[:len(met)]) == counts["all"]
    return list(counts[:len(met)])


def test_uneven_keys(spark):
    df = spark.range(40_000).selectExpr("CAST(pow(id / 100.0D, 3) AS BIGINT) AS block")
    found = sizes(df, balanced_predicates(df, "block", 8))
    assert len(found) == 8 and max(found) <= 2 * 5000
    # Equal strides would give half of the rows to the first of eight parts.
    assert df.where("block < 64000000 / 8").count() > 2 * 5000


@pytest.mark.parametrize("hot", ["7", "0", "29999"])
def test_a_hot_value_is_divided(spark, hot):
    df = spark.range(30_000).selectExpr(
        f"IF(id % 3 = 0, {hot}, id) AS block", "id * id AS token", "'x' AS extra")
    found = sizes(df, balanced_predicates(df, "block", 10, spread="token"))
    assert max(found) <= 2 * 3000
    whole = sizes(df, balanced_predicates(df, "block", 10))
    assert max(whole) >= 10_000


def test_nulls_one_value_and_empty(spark):
    nulls = spark.range(1000).selectExpr("IF(id % 4 = 0, NULL, id) AS block", "IF(id % 5 = 0, NULL, id) AS token")
    assert sum(sizes(nulls, balanced_predicates(nulls, "block", 4, "token"))) == 1000
    one = spark.range(1000).selectExpr("5L AS block", "NULLIF(id, 3) AS token")
    assert max(sizes(one, balanced_predicates(one, "block", 4, "token"))) <= 500
    unset = spark.range(10).selectExpr("5L AS block", "CAST(NULL AS BIGINT) AS token")
    assert sum(sizes(unset, balanced_predicates(unset, "block", 4, "token"))) == 10
    empty = nulls.limit(0)
    assert balanced_predicates(empty, "block", 4, "token") == ["TRUE"]
    assert balanced_predicates(nulls, "block", 1) == ["TRUE"]
    with pytest.raises(ValueError):
        balanced_predicates(spark.range(3).selectExpr("CAST(id AS STRING) AS s"), "s", 4)
    with pytest.raises(ValueError):
        balanced_predicates(nulls, "block", 0)
