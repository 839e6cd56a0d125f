"""Tones as a table function, for SQL: SELECT * FROM tone_params(TABLE(requests) PARTITION BY basename).

The function is polymorphic: it takes a table with the columns basename, tone and version, whatever
else it has, and gives its rows back, each once for every parameter of its tone, with the columns draw (the
parameter's place), name and values. `only => 'eq'` leaves the parameters of one name. Columns are checked
when a query is planned, unknown tones when it runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .effects import TONES, draw

NEEDED = ("basename", "tone", "version")
MADE = StructType().add("draw", IntegerType()).add("name", StringType()).add("values", ArrayType(DoubleType()))
#: Requests whose draws a task remembers.
REMEMBERED = 10_000


class ToneParams:
    @staticmethod
    def analyze(requests: AnalyzeArgument, only: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not requests.isTable:
            raise ValueError("tone_params takes a table: tone_params(TABLE(requests))")
        names = requests.dataType.fieldNames()
        if missing := [c for c in NEEDED if c not in names]:
            raise ValueError(f"tone_params needs the columns {', '.join(missing)}")
        if clash := [c for c in MADE.fieldNames() if c in names]:
            raise ValueError(f"tone_params makes columns that are there already: {', '.join(clash)}")
        if only is not None and only.value not in {name for params in TONES.values() for name, _ in params}:
            raise ValueError(f"no tone has a parameter {only.value!r}")
        return AnalyzeResult(schema=StructType([*requests.dataType.fields, *MADE.fields]))

    def __init__(self) -> None:
        self.known: dict[tuple, list] = {}

    def eval(self, requests: Row, only: str | None = None) -> Iterator[tuple]:
        tone, version, basename = requests["tone"], requests["version"], requests["basename"]
        if tone is None or version is None or basename is None:
            return
        if tone not in TONES:
            raise ValueError(f"{tone!r} is no tone")
        if (key := (tone, version, basename)) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = draw(tone, version, basename)[0]
        for n, (name, values) in enumerate(self.known[key]):
            if only in (None, name):
                yield (*requests, n, name, [float(v) for v in values])


def register(spark: SparkSession) -> None:
    """Makes tone_params known to the session's SQL."""
    spark.udtf.register("tone_params", udtf(ToneParams))
