"""Table functions for SQL: symbols, calls and contracts of sources.

Each comes in two forms. ``extract_symbols(path, content)`` stands in a LATERAL join, a call for each row; rows are
pickled in batches, since Arrow would take each call's results as a table. ``symbols_of_files(TABLE(t))`` takes a table whole, with the columns file and content, and reads
it batch by batch; it also keeps the file, and gives files that can't be read a row with their error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.files import LANGUAGES, extract_source
from .contracts import PARAMETERS, contracts_of

SYMBOL = "type string, name string, qualified_name string, line int, `column` int, end_line int, docstring string, parent string, language string"
CALL = "caller_type string, caller_name string, caller_line int, call_text string, language string"
CONTRACT = f"parent string, name string, qualified_name string, parameters {PARAMETERS}, return_type string, raises array<string>, preconditions array<string>, postconditions array<string>"


def _names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).fieldNames()


def _language(path: str | None) -> str | None:
    return LANGUAGES.get((path or "").rsplit(".", 1)[-1].lower())


def _symbols(path: str | None, content: bytes | None) -> list[dict]:
    language = _language(path)
    found = extract_source(language, path, content or b"")[0] if language else []
    return [s | {"qualified_name": f"{s['parent']}.{s['name']}" if s["parent"] else s["name"], "language": language} for s in found]


def _calls(path: str | None, content: bytes | None) -> list[dict]:
    language = _language(path)
    return [c | {"language": language} for c in (extract_source(language, path, content or b"")[1] if language else [])]


def _contracts(path: str | None, content: bytes | None) -> list[dict]:
    return contracts_of((content or b"").decode("utf-8", "replace"), path or "") if path is None or _language(path) == "python" else []


def _rowwise(read, schema: str):
    names = _names(schema)

    class Rowwise:
        """A row of a join: sources that can't be read, or in no known language, give no rows."""

        def eval(self, path: str, content: bytes) -> Iterator[tuple]:
            try:
                found = read(path, bytes(content) if content is not None else None)
            except Exception:  # a broken file ends no query; the form that takes tables tells its error
                return
            for x in found:
                yield tuple(x[n] for n in names)

    return udtf(Rowwise, returnType=schema, useArrow=False)  # with Arrow, each row's results would be a frame of their own


def _whole(read, schema: str):
    names, full = _names(schema), f"file string, {schema}, error string"
    arrow = to_arrow_schema(StructType.fromDDL(full))

    class Whole:
        """A table with the columns file and content, batch by batch."""

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            out = []
            for path, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    out += [{"file": path, "error": None} | {n: x[n] for n in names} for x in read(path, content)]
                except Exception as e:  # a broken file is a row
                    out.append({"file": path, "error": f"{type(e).__name__}: {e}"})
            yield pa.Table.from_pylist(out, schema=arrow)

    return arrow_udtf(Whole, returnType=full)


def _contract_rows():
    names = _names(CONTRACT)

    class Contracts:
        """Contracts of a Python source's functions; none of a source that doesn't parse."""

        def eval(self, source: str) -> Iterator[tuple]:
            for x in contracts_of(source or ""):
                yield tuple([dict(p) for p in x[n]] if n == "parameters" else x[n] for n in names)

    return udtf(Contracts, returnType=CONTRACT, useArrow=False)


def register(spark: SparkSession) -> None:
    """Names the functions in the session: extract_symbols and extract_calls (path, content), extract_contracts (source); symbols_of_files, calls_of_files and contracts_of_files (TABLE)."""
    made = {
        "extract_symbols": _rowwise(_symbols, SYMBOL), "extract_calls": _rowwise(_calls, CALL), "extract_contracts": _contract_rows(),
        "symbols_of_files": _whole(_symbols, SYMBOL), "calls_of_files": _whole(_calls, CALL), "contracts_of_files": _whole(_contracts, CONTRACT),
    }
    for name, f in made.items():
        spark.udtf.register(name, f)
