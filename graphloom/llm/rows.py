"""Functions of a row's text, run in Arrow batches beside the row's other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from graphloom.functions.ship import ship
from graphloom.llm.staging import packed, unpacked

#: Rows of a batch that are worked on at a time: texts may be long.
AT_ONCE = 256


def with_text_results(docs: DataFrame, text_col: str, results: dict[str, tuple[str, pa.DataType]], function: Callable[[list[str | None]], list[list]], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with a column for each of ``results``.

    ``results`` names each new column's SQL and Arrow type; ``function`` maps
    some texts to a list of values for each. Columns of ``docs`` with such a
    name are replaced; others may have any name. The text crosses to Python
    once, also where it is among the columns that stay.
    """
    ship(docs.sparkSession)
    new = {c.lower() for c in results}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    inside = text_col in names and docs.schema[text_col].dataType.simpleString() == "string"
    source = docs.select(packed(docs, names), *([] if inside else [F.col(text_col).cast("string").alias("_text")]))
    place = names.index(text_col) if inside else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                texts = batch.column(0).flatten()[place] if inside else batch.column(1)
                found = function(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, (_, kind) in zip(found, results.values()))], ["_doc", *results])

    parsed = _parse_datatype_string(", ".join(f"{c} {kind}" for c, (kind, _) in results.items()))
    schema = StructType([StructField("_doc", source.schema["_doc"].dataType), *parsed.fields])
    return source.mapInArrow(run, schema).select(*unpacked(names), *results)
