"""Numbers anywhere in nested records."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from siltstone.functions.numbers import NUMBER

_NUMBER = re.compile(NUMBER)


def harvest(record: object) -> set[float]:
    """The numbers of a record at every depth: values, and what stands in strings and keys; truth values are none."""
    found: set[float] = set()
    left = [record]
    while left:
        x = left.pop()
        if isinstance(x, str):
            found.update(float(t) for t in _NUMBER.findall(x))
        elif isinstance(x, dict):
            left += [*x.keys(), *x.values()]
        elif isinstance(x, list):
            left += x
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            found.add(float(x))
    return found


@F.pandas_udf(ArrayType(DoubleType()))
def json_numbers(texts: pd.Series) -> pd.Series:
    """harvest() of JSON texts, in ascending order; null stays null, and what is no JSON is an error."""
    return texts.map(lambda t: sorted(harvest(json.loads(t, parse_int=float))), na_action="ignore")


def record_numbers(record: Column) -> Column:
    """The numbers of a struct, map or array at every depth, names of fields included."""
    return json_numbers(F.to_json(record, {"ignoreNullFields": "false"}))
