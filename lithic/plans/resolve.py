"""Strict resolution of a model against the files it is read from.

Columns are found by name, whatever the case; extra ones are ignored.  An optional
column may be absent and is null then.  A required one that is absent, a type that
differs in any way, a group where a plain column is declared, or a missing part of a
nested column is an error: nothing is widened or filled in silently.
"""

from __future__ import annotations

from dataclasses import dataclass

from lithic.plans.model import Column, Model


class InvalidData(ValueError):
    """A file is not what the model or the limits say."""


@dataclass(frozen=True)
class FileColumn:
    path: str
    physical: str
    logical: str
    optional: bool
    digits: str
    time: str


def parse_schema(text: str) -> list[FileColumn]:
    rows = [line.split("\t") for line in text.split("\n") if line]
    return [FileColumn(p, ph, lo, opt == "True", d, t) for p, ph, lo, opt, d, t in rows]


def _same_type(column: Column, found: FileColumn) -> bool:
    kind = column.leaf
    if found.physical not in kind.physical or found.logical not in kind.logical:
        return False
    if kind.name.startswith("decimal"):
        return found.digits == kind.name[8:-1]
    if kind.name == "timestamp_micros":
        return found.time.startswith("micro") and found.time.endswith("True")
    if kind.name == "timestamp_local":
        return found.time.startswith("micro") and found.time.endswith("False")
    if kind.name == "timestamp_int96":
        return found.physical == "INT96" or found.time.endswith("True")
    return True


def _leaves(column: Column, prefix: str, optional: bool) -> list[tuple[str, Column, bool]]:
    """(path in the file, leaf column, whether it is required) of a column's leaves."""
    path = f"{prefix}{column.name}"
    if column.kind == "leaf":
        return [(path, column, not column.nullable and not optional)]
    if column.kind == "record":
        return [x for c in column.model.columns for x in _leaves(c, f"{path}.", True)]
    if column.kind == "map":
        return [x for x in _leaves(column.element, f"{path}.key_value.", True)]
    inner = column.element
    if inner.kind == "record":
        return [x for c in inner.model.columns for x in _leaves(c, f"{path}.list.element.", True)]
    return [(f"{path}.list.element", inner, False)]


#: Other names that writers give a list's inner groups.
_LIST_NAMES = (".bag.array_element", ".list.item", ".array")


def resolve(model: Model, schema: str, file: str = "the file") -> dict[str, bool]:
    """Column name -> whether the file has it; InvalidData if the file doesn't fit the model."""
    found: dict[str, FileColumn] = {}
    for c in parse_schema(schema):
        found.setdefault(c.path.lower(), c)  # of equal names the first counts
    roots = {p.split(".")[0] for p in found}
    present: dict[str, bool] = {}
    for column in model.columns:
        name = column.name.lower()
        present[column.name] = name in roots
        if name not in roots:
            if not column.nullable:
                raise InvalidData(f"{file}: required column '{column.name}' of {model.name} is missing")
            continue
        if column.kind == "leaf" and name not in found:
            raise InvalidData(f"{file}: column '{column.name}' is a group; {model.name} has {column.leaf.name}")
        for path, leaf, _ in _leaves(column, "", column.nullable):
            here = _find(found, path.lower())
            if here is None:
                raise InvalidData(f"{file}: column '{path}' of {model.name} is missing")
            if leaf.leaf is not None and not _same_type(leaf, here):
                raise InvalidData(f"{file}: column '{path}' is {here.physical}/{here.logical}{here.digits and f'({here.digits})'}{here.time and f'({here.time})'}; {model.name} has {leaf.leaf.name}")
    return present


def _find(found: dict[str, FileColumn], path: str) -> FileColumn | None:
    """A leaf by its path, with any of the usual names of a list's inner groups."""
    if path in found:
        return found[path]
    for other in _LIST_NAMES:
        if (p := path.replace(".list.element", other)) in found:
            return found[p]
    return None
