"""Factor queries leave no stage in one method that the JVM would not compile."""

import pytest

from quantloom.plans import factors

LIMIT = "spark.sql.codegen.hugeMethodLimit"


@pytest.mark.parametrize("name", ["factors_alpha_5", "factors_alpha_6"])
def test_factor_queries_limit_generated_methods(spark, name):
    spark.conf.unset(LIMIT)
    factors.queries()[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(LIMIT)) <= 8000
