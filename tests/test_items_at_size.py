"""Sheets over more parts than six digits number, against their SQL."""

import pytest
from conftest import oracle, result

from tidemark.plans import catalogue


@pytest.mark.parametrize("name", ["real_items__Z21_P11", "sheet_errors__P13_J14"])
def test_parts_of_seven_digits(spark, tmp_path, name):
    from conftest import SF, TABLES

    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    (tmp_path / "part.parquet").unlink()
    part = spark.read.parquet(f"{SF}/part.parquet")
    shifted = part.unionByName(part.withColumn("p_partkey", part.p_partkey + 1_199_970)).unionByName(part.withColumn("p_partkey", part.p_partkey + 119_990))
    shifted.toPandas().to_parquet(tmp_path / "part.parquet")
    assert result(catalogue.QUERIES[name](spark, str(tmp_path))) == oracle(catalogue.ORACLE_SQL[name], str(tmp_path))
