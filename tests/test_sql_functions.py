"""SQL functions against the column functions they are made of."""

import pytest
from pyspark.sql import functions as F

from hearthline.functions import SQL_FUNCTIONS, register_sql_functions

TEXTS = [
    None, "", " a  b\t c ", "$1,234.567", "85%", "12/31/99", "2024-02-30", "2024-01-02", "t", "{a,b}", "it's \\ x", "N/A",
    "-3:04:05.5", "10:11:12", "2024-01-02 03:04:05.25", "Entire home", "10.0", "-12.5", "7", "\u00a0\u00e9\u2003", "NaN",
]


@pytest.fixture(scope="module")
def values(spark):
    register_sql_functions(spark, "my_")
    rows = [(v, None if i % 7 == 6 else float(i * 37 - 40)) for i, v in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "s string, n double")


@pytest.mark.parametrize("name", list(SQL_FUNCTIONS))
def test_sql_function_equals_its_column(spark, values, name):
    make, parameters = SQL_FUNCTIONS[name]
    kinds = [p.split()[1] for p in parameters.split(", ")]
    given = ["s" if kind == "STRING" else f"cast(n as {kind})" for kind in kinds]
    called = spark.sql(f"select my_{name}({', '.join(given)}) as x from {{v}}", v=values)
    direct = values.select(make(*(F.expr(e) for e in given)).alias("x"))
    assert repr(called.collect()) == repr(direct.collect())
    assert called.schema["x"].dataType == direct.schema["x"].dataType
    plan = called._jdf.queryExecution().executedPlan().toString()
    assert "my_" not in plan and "Python" not in plan
