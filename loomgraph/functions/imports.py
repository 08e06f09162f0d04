"""Import resolution as string expressions."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modules of the standard library that newer versions have dropped, and two of its site hooks.
DROPPED = (
    "aifc", "asynchat", "asyncore", "audioop", "binhex", "cgi", "cgitb", "chunk", "crypt", "distutils", "imghdr", "imp",
    "lib2to3", "mailcap", "msilib", "nis", "ossaudiodev", "parser", "pipes", "smtpd", "sndhdr", "sunau", "symbol",
    "telnetlib", "test", "uu", "xdrlib", "typing_extensions", "sitecustomize", "usercustomize",
)
STDLIB = tuple(sorted({*sys.stdlib_module_names, *DROPPED}))


def _dirs(file: Column) -> Column:
    """The folders of a file's path."""
    parts = F.split(F.regexp_replace(file, r"\\", "/"), "/")
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: (p != "") & (p != "."))


def _up(dirs: Column, levels: Column) -> Column:
    return F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - levels, F.lit(0)))


def resolve_python(module: Column, from_file: Column) -> Column:
    """A relative module as a dotted path from the file's folder, one level up for each dot but the first; others as they are."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(module, r"^\.+", "")
    path = F.concat(_up(_dirs(from_file), dots - 1), F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>")))
    return F.when(dots > 0, F.array_join(path, ".")).otherwise(module)


def resolve_typescript(path: Column, from_file: Column) -> Column:
    """A relative path from the file's folder, without its extension; packages as they are."""
    up = F.size(F.filter(F.split(path, "/"), lambda p: p == ".."))
    names = F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    joined = F.array_join(F.concat(_up(_dirs(from_file), up), names), "/")
    return F.when(path.startswith("./") | path.startswith("../"), F.regexp_replace(joined, r"\.(?:tsx?|jsx?)$", "")).otherwise(path)


def import_names(statement: Column) -> Column:
    """Names an import statement binds: aliases in place of what they stand for, ``*`` as itself, brackets ignored."""
    after = F.regexp_replace(F.trim(statement), r"(?s)^(?:from\s+\S+\s+)?import\s+", "")
    parts = F.split(F.regexp_replace(after, r"[()]", ""), ",")
    bound = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"(?s)^.*\s+as\s+", "")))
    return F.filter(bound, lambda p: p != "")


def is_stdlib(module: Column) -> Column:
    return F.substring_index(module, ".", 1).isin(*STDLIB)
