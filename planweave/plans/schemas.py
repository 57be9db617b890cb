"""Schemas as Python source: a class of column names for each dataset, and typed columns in flow bodies."""

from __future__ import annotations

import keyword
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Columns:
    """The columns of a schema as attributes: a name that the schema lacks is an AttributeError when the body runs."""

    def __init__(self, schema: T.StructType):
        self.__dict__.update({n: F.col(f"`{n}`") for n in schema.names})

    def __getattr__(self, name: str) -> Column:
        raise AttributeError(f"no column {name}; there are {', '.join(sorted(self.__dict__))}")


def _class(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"\W+|_", name) if p) or "Dataset"


def render(schemas: dict[str, T.StructType]) -> str:
    """A module with a class for each dataset, sorted by name: `column = "column"`, and SCHEMA as DDL."""
    out = ['"""Column names of the datasets. Generated."""', ""]
    for name in sorted(schemas):
        out += ["", f"class {_class(name)}:", f"    DATASET = {name!r}", f"    DDL = {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schemas[name])!r}"]
        for f in schemas[name]:
            field = re.sub(r"\W", "_", f.name)
            field = f"_{field}" if not field or field[0].isdigit() or keyword.iskeyword(field) or field in ("DATASET", "DDL") else field
            out.append(f"    {field} = {f.name!r}")
        out.append("")
    return "\n".join(out).rstrip() + "\n"


def namespace(source: str) -> dict[str, Any]:
    scope: dict[str, Any] = {}
    exec(compile(source, "schemas", "exec"), scope)  # noqa: S102  what render() wrote
    return {k: v for k, v in scope.items() if isinstance(v, type)}
