"""Function contracts from Python sources, and what breaks between two versions of them.

Sources are read with the syntax tree in Arrow batches; the comparison is a set of array expressions over the
parameters, so it runs inside the JVM.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMETERS = "array<struct<name:string,type_hint:string,is_optional:boolean,default_value:string>>"
CONTRACT = f"file string, parent string, name string, qualified_name string, parameters {PARAMETERS}, return_type string, raises array<string>, preconditions array<string>, postconditions array<string>"
# Kinds of changes, their severities, and the most general types.
HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"
GENERAL = ("Any", "object")
PENALTY = 0.3


def section(doc: str, title: str) -> list[str]:
    """Non-empty lines of a Google-style section, up to the next line that ends in a colon."""
    out, inside = [], False
    for line in doc.split("\n"):
        text = line.strip()
        if text.lower().startswith(title.lower() + ":"):
            inside = True
        elif inside and text.endswith(":"):
            break
        elif inside and text:
            out.append(text)
    return out


def contract(node: ast.FunctionDef, parent: str | None, file: str) -> dict:
    show = lambda x: ast.unparse(x) if x is not None else None
    a, doc = node.args, ast.get_docstring(node) or ""
    free = len(a.args) - len(a.defaults)
    parameters = [{"name": p.arg, "type_hint": show(p.annotation), "is_optional": k >= free, "default_value": show(a.defaults[k - free]) if k >= free else None} for k, p in enumerate(a.args)]
    parameters += [{"name": p.arg, "type_hint": show(p.annotation), "is_optional": True, "default_value": None} for p in a.kwonlyargs]
    return {
        "file": file, "parent": parent, "name": node.name, "qualified_name": f"{parent}.{node.name}" if parent else node.name, "parameters": parameters, "return_type": show(node.returns),
        "raises": [n for x in section(doc, "Raises") if ":" in x and (n := x.split(":")[0].strip())],
        "preconditions": [x for x in section(doc, "Args") if "requires" in x.lower() or "must" in x.lower()], "postconditions": section(doc, "Returns"),
    }


def contracts_of(source: str, file: str = "") -> list[dict]:
    """Contracts of the module's functions and its classes' methods; none of a source that doesn't parse, and none of async functions."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = [contract(n, None, file) for n in tree.body if isinstance(n, ast.FunctionDef)]
    return out + [contract(n, c.name, file) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for n in c.body if isinstance(n, ast.FunctionDef)]


def extract_contracts(sources: DataFrame, file: str = "file", source: str = "source") -> DataFrame:
    """A row per function of (file, source) rows."""
    names = [c.split()[0] for c in CONTRACT.replace(PARAMETERS, "x").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [c for f, s in zip(df["file"], df["source"], strict=True) for c in contracts_of(s or "", f)]
            yield pd.DataFrame(rows, columns=names)

    return sources.select(F.col(file).alias("file"), F.col(source).cast("string").alias("source")).mapInPandas(run, CONTRACT)


def narrowed(old: Column, new: Column) -> Column:
    """Whether a type became narrower: from the most general ones, out of a Union, or out of an Optional."""
    lost = lambda w: F.contains(old, F.lit(w)) & ~F.contains(new, F.lit(w))
    return (old != new) & (old.isin(*GENERAL) | lost("Union") | lost("Optional"))


def compare(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("qualified_name",)) -> DataFrame:
    """(key, breaking array<struct<type,severity,elements>>, notes array<string>, is_compatible, score) of contracts in both."""
    cols = ("parameters", "return_type", "raises", "preconditions")
    o = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in cols])
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in cols])
    j = o.join(n, list(key))
    names = lambda ps: F.transform(ps, lambda p: p["name"])
    required = lambda ps: names(F.filter(ps, lambda p: ~p["is_optional"]))
    op, np_ = F.col("o_parameters"), F.col("n_parameters")
    change = lambda kind, severity, elements: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.array_sort(elements).alias("elements"))
    removed, demanded = F.array_except(names(op), names(np_)), F.array_except(required(np_), required(op))
    pairs = F.flatten(F.transform(op, lambda a: F.transform(F.filter(np_, lambda b: b["name"] == a["name"]), lambda b: F.struct(a["name"].alias("name"), a["type_hint"].alias("old"), b["type_hint"].alias("new")))))
    changed = F.transform(F.filter(pairs, lambda p: F.coalesce(narrowed(p["old"], p["new"]), F.lit(False))), lambda p: change("PARAMETER_TYPE_CHANGED", HIGH, F.array(p["name"])))
    gone, more = F.array_except("o_raises", "n_raises"), F.array_except("n_raises", "o_raises")
    some = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), F.array(x)).otherwise(F.array().cast("array<struct<type:string,severity:string,elements:array<string>>>"))
    stricter = (F.size("o_preconditions") > 0) & (F.size("n_preconditions") > F.size("o_preconditions"))
    breaking = F.concat(
        some(F.size(removed) > 0, change("PARAMETER_REMOVED", HIGH, removed)), some(F.size(demanded) > 0, change("PARAMETER_REQUIRED_NOW", HIGH, demanded)), changed,
        some(narrowed(F.col("o_return_type"), F.col("n_return_type")), change("RETURN_TYPE_NARROWED", MEDIUM, F.array(F.lit("return")))),
        some(F.size(more) > 0, change("EXCEPTION_ADDED", LOW, more)), some(stricter, change("PRECONDITION_ADDED", MEDIUM, F.array(F.lit("preconditions")))),
    )
    added = F.array_except(names(np_), names(op))
    optional = (F.size(added) > 0) & (F.size(F.array_except(added, required(np_))) == F.size(added))
    note = lambda cond, text, xs: F.when(cond, F.concat(F.lit(text), F.array_join(F.array_sort(xs), ", ")))
    notes = F.array_compact(F.array(note(F.size(gone) > 0, "Removed exceptions: ", gone), note(optional, "Added optional parameters: ", added)))
    out = j.select(*key, breaking.alias("breaking"), notes.alias("notes"))
    return out.withColumn("is_compatible", F.size("breaking") == 0).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - PENALTY * F.size("breaking"))))
