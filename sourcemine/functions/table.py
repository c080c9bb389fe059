"""Table functions for SQL."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from sourcemine.operators.parse import parse_source

NAME = "python_units"
COLUMNS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("code", T.StringType()),
    ]
)


@udtf
class PythonUnits:
    """Functions and methods of one Python source: ``kind, class_name, name, line, code``.

    ``SELECT f.path, u.* FROM files f, LATERAL python_units(f.content) u``.  A source that
    is null or does not parse gives no row.  Every definition of a repeated name counts.
    """

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(content.dataType, T.StringType):
            raise ValueError(f"{NAME} takes the text of a source, not {content.dataType.simpleString()}")
        return AnalyzeResult(schema=COLUMNS)

    def eval(self, content: str) -> Iterator[tuple]:
        if content is None:
            return
        warnings.simplefilter("ignore")
        try:
            units = parse_source(content.replace("\r\n", "\n").replace("\r", "\n"))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        for unit in units:
            if unit["kind"] == "function":
                yield "function", None, unit["name"], unit["line"], unit["code"]
            for method, code in zip(unit["methods"], unit["method_code"]):
                yield "method", unit["name"], f"{unit['name']}.{method['name']}", method["line"], code


def register_python_units(spark: SparkSession) -> None:
    spark.udtf.register(NAME, PythonUnits)
