"""What Catalyst made of a query, as facts that tests can hold it to."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def operators(df: DataFrame) -> Counter:
    """How often each physical operator stands in the initial plan."""
    tree = plan_text(df).split("\n\n")[0]
    return Counter(re.findall(r"(?:^|[-+: ]{2,}|\* )([A-Z]\w+)(?: \w+)? \(\d+\)", tree, re.M))


def pushed_filters(df: DataFrame) -> list[str]:
    return [x.strip() for found in re.findall(r"PushedFilters: \[(.*)\]", plan_text(df)) for x in found.split(", ") if x.strip()]


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (.*)", plan_text(df))
