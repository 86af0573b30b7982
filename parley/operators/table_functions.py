"""Table functions for SQL: what an operator does with a table, called by its name in a query."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class PhraseSpans:
    """``phrase_spans(TABLE(t), 'key')``: the longest runs of marked words of each key, as ``(key, start, phrase, n)``.

    ``t`` has the key column, of any type, and ``pos``, ``word`` and ``kw`` (whether a word is marked; null: no).
    Its rows are dealt by key and come in the order of ``pos``; one key's state is one run. A gap in ``pos`` ends a run.
    """

    def __init__(self) -> None:
        self.key = self.start = self.last = None
        self.words: list[str] = []

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or not isinstance(table.dataType, StructType):
            raise ValueError("the first argument is a table: TABLE(t)")
        if not key.isConstantExpression or not isinstance(key.value, str):
            raise ValueError("the second argument names the key column")
        fields = {f.name: f for f in table.dataType.fields}
        missing = [c for c in (key.value, "pos", "word", "kw") if c not in fields]
        if missing:
            raise ValueError(f"the table lacks {', '.join(missing)}")
        schema = StructType().add(key.value, fields[key.value].dataType).add("start", IntegerType()).add("phrase", StringType()).add("n", LongType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn("pos")])

    def _run(self) -> Iterator[tuple]:
        if self.words:
            yield self.key, self.start, " ".join(self.words), len(self.words)
        self.words = []

    def eval(self, table: Row, key: str) -> Iterator[tuple]:
        if self.words and (not table["kw"] or table["pos"] != self.last + 1):
            yield from self._run()
        if table["kw"]:
            if not self.words:
                self.key, self.start = table[key], table["pos"]
            self.words.append(table["word"])
            self.last = table["pos"]

    def terminate(self) -> Iterator[tuple]:
        yield from self._run()


def register(spark: SparkSession) -> None:
    """The table functions under their names, for ``spark.sql``."""
    spark.udtf.register("phrase_spans", udtf(PhraseSpans, useArrow=False))
