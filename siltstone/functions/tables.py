"""Table functions for SQL: a fold over the ordered rows of a group, in Python, where a caller's own chunker or extractor should run from SQL. What the library has built in
stays native (``operators/chunking``)."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from siltstone.operators.chunking import MAX_CHARS


class Fold:
    """What a caller writes: made once per group with the call's further arguments; ``add`` sees the group's rows in order and ``end`` what is left. Both give rows. Only what the fold
    itself keeps is held, never a whole group."""

    returns: str = ""
    partition_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()

    def add(self, row: Row) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        return ()


def register(spark: SparkSession, name: str, fold: type[Fold]) -> None:
    """``SELECT * FROM name(TABLE(rows), more, arguments)``: rows are partitioned and ordered as the fold says, so the caller needn't. A table without the columns that
    it needs is refused while the query is analysed."""
    returns, partition_by, order_by = StructType.fromDDL(fold.returns), fold.partition_by, fold.order_by

    class Folded:
        def __init__(self) -> None:
            self.fold: Fold | None = None

        @staticmethod
        def analyze(rows: AnalyzeArgument, *more: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} takes a table: {name}(TABLE(...))")
            have = {f.name for f in rows.dataType.fields}
            if missing := sorted({*partition_by, *order_by} - have):
                raise ValueError(f"{name} needs the columns {missing}")
            for m in more:
                if not m.isConstantExpression:
                    raise ValueError(f"further arguments of {name} must be constant")
            return AnalyzeResult(returns, partitionBy=[PartitioningColumn(c) for c in partition_by], orderBy=[OrderingColumn(c) for c in order_by])

        def eval(self, rows: Row, *more: Any) -> Iterable[tuple]:
            if self.fold is None:
                self.fold = fold(*more)
            yield from self.fold.add(rows)

        def terminate(self) -> Iterable[tuple]:
            if self.fold is not None:
                yield from self.fold.end()

    spark.udtf.register(name, udtf(Folded))


class PackTurns(Fold):
    """Turns (call_id, turn_index, speaker, text) to chunks, as ``chunking.pack`` makes them: the example that a caller's own chunker starts from."""

    returns = "chunk_id string, call_id string, chunk_index int, turn_start int, turn_end int, speakers string, text string"
    partition_by, order_by = ("call_id",), ("turn_index",)

    def __init__(self, max_chars: int = MAX_CHARS):
        self.max_chars, self.index, self.chars, self.turns = max_chars, 0, 0, []

    def add(self, row: Row) -> Iterable[tuple]:
        n = len(row["text"])
        if self.turns and self.chars + n > self.max_chars:
            yield from self.end()
            self.chars, self.turns = 0, []
        self.chars += n
        self.turns.append(row)

    def end(self) -> Iterable[tuple]:
        if self.turns:
            self.index += 1
            call, at = self.turns[0]["call_id"], [t["turn_index"] for t in self.turns]
            text = "\n".join(f"turn:{t['turn_index']} speaker:{t['speaker']}: {t['text']}" for t in self.turns)
            yield f"{call}:chunk-{self.index:03d}", call, self.index, min(at), max(at), ",".join(sorted({t["speaker"] for t in self.turns})), text


def register_all(spark: SparkSession) -> None:
    register(spark, "pack_turns", PackTurns)
