"""Import extraction as an Arrow function over a column, a table function, and for single files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from graphloom.functions.lexer import Import, parse_source
from graphloom.functions.paths import language_of_name
from graphloom.functions.ship import ship
from graphloom.schema import IMPORTS

__all__ = ["init_parser", "parse_source", "parse_file", "with_imports", "imports_of", "register_parse_imports"]

_FIELDS = [pa.field("source", pa.string()), pa.field("specifiers", pa.list_(pa.string())), pa.field("type", pa.string()), pa.field("line", pa.int32())]


def _listed(imports: list[list[Import]]) -> pa.Array:
    """One list of structs for each file."""
    every = [x for found in imports for x in found]
    columns = zip(*every) if every else [()] * len(_FIELDS)
    structs = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _FIELDS)], fields=_FIELDS)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, imports))], pa.int32()), structs)


def init_parser(language: str = "typescript") -> Callable[[str | None], list[Import]]:
    """A parser of sources in ``language``; ValueError for one that is not supported. The scanner has no state to set up."""
    parse_source("", language)
    return lambda source: parse_source(source, language)


def parse_file(path: str) -> list[Import]:
    """The imports of one file on the driver; ValueError for an unsupported extension."""
    language = language_of_name(path)
    if language is None:
        raise ValueError(f"Unsupported file type: {path}")
    with open(path, encoding="utf-8", errors="replace") as file:
        return parse_source(file.read(), language)


def with_imports(sources: DataFrame) -> DataFrame:
    """``sources`` (path, language, content) as (path, imports, errors), parsed in Arrow batches.

    A null content, a file that could not be read, gives no imports and one error.
    """
    ship(sources.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            imports, errors = [], []
            for language, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    if content is None:
                        raise ValueError("the file cannot be read")
                    imports.append(parse_source(content, language))
                    errors.append([])
                except Exception as e:  # recorded for the file; the others go on
                    imports.append([])
                    errors.append([str(e)])
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed(imports), pa.array(errors, pa.list_(pa.string()))], ["path", "imports", "errors"])

    return sources.select("path", "language", "content").mapInArrow(run, f"path string, imports {IMPORTS}, errors array<string>")


def imports_of(parsed: DataFrame) -> DataFrame:
    """One row for each import: path, idx (from 0, in document order), source, specifiers, type, line."""
    return parsed.select("path", F.posexplode("imports").alias("idx", "i")).select("path", "idx", "i.source", "i.specifiers", "i.type", "i.line")


def register_parse_imports(spark: SparkSession, name: str = "parse_imports") -> None:
    """Registers a table function for SQL: ``parse_imports(source, language)``."""
    ship(spark)

    @udtf(returnType="source string, specifiers array<string>, type string, line int")
    class ParseImports:
        def eval(self, source: str, language: str):
            for x in parse_source(source, language):
                yield x.source, x.specifiers, x.type, x.line

    spark.udtf.register(name, ParseImports)
