"""Record models: a declared, fixed schema, checked when the class is made.

    @record
    class Trade:
        key: int = column(order=1, sort_key=True)
        region: Optional[str] = column("area")
        price: Decimal = column(precision=12, scale=2)

A declaration that breaks a rule raises ModelError with the rule's code; what is
merely unusual warns.
"""

from __future__ import annotations

import enum
import inspect
import types as py_types
import typing
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

from lithic.plans import types as ct

DEPTH = 6


class ModelError(TypeError):
    """A model breaks a rule; code names it."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class ModelWarning(UserWarning):
    pass


@dataclass(frozen=True)
class Options:
    """What column() says about a field; see column()."""

    name: str | None = None
    order: int | None = None
    type: str | None = None
    precision: int | None = None
    scale: int | None = None
    timestamp: str | None = None
    field_id: int | None = None
    encoding: str = "default"
    sort_key: bool = False
    ignore: bool = False


def column(name: str | None = None, **options: typing.Any) -> typing.Any:
    """Options of a field: name, order, type, precision, scale, timestamp ("int96", "micros", "local"), field_id, encoding, sort_key, ignore."""
    return Options(name, **options)


@dataclass(frozen=True)
class Column:
    """One column of a model; children for a nested record, element for a list or the values of a map."""

    name: str
    attribute: str
    kind: str  # leaf, record, list or map
    nullable: bool
    options: Options
    leaf: ct.ColumnType | None = None
    model: Model | None = None
    element: Column | None = None
    values: Mapping[int, str] = field(default_factory=dict, hash=False, compare=False)

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "record":
            return self.model.schema
        if self.kind == "list":
            return T.ArrayType(self.element.spark_type, self.element.nullable)
        if self.kind == "map":
            return T.MapType(T.StringType(), self.element.spark_type, self.element.nullable)
        return self.leaf.spark

    @property
    def prunable(self) -> bool:
        return self.kind == "leaf" and self.leaf.prunable and not self.values

    @property
    def field(self) -> T.StructField:
        meta: dict[str, typing.Any] = {}
        if self.options.field_id is not None:
            meta["parquet.field.id"] = self.options.field_id
        if self.values:
            meta["values"] = {str(k): v for k, v in self.values.items()}
        return T.StructField(self.name, self.spark_type, self.nullable, meta)


@dataclass(frozen=True)
class Model:
    name: str
    columns: tuple[Column, ...]
    cls: type | None = field(default=None, compare=False)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([c.field for c in self.columns])

    @property
    def flat(self) -> bool:
        return all(c.kind == "leaf" for c in self.columns)

    @property
    def prunable(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if c.prunable)

    def __getitem__(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


def _optional(annotation: typing.Any) -> tuple[typing.Any, bool]:
    if typing.get_origin(annotation) in (typing.Union, py_types.UnionType):
        kinds = [a for a in typing.get_args(annotation) if a is not type(None)]
        if len(kinds) == 1:
            return kinds[0], True
    return annotation, False


def _leaf(owner: str, name: str, annotation: typing.Any, options: Options) -> tuple[ct.ColumnType | None, dict[int, str]]:
    said = options.type or ct.from_python(annotation)
    values = {int(m.value): m.name for m in annotation} if isinstance(annotation, type) and issubclass(annotation, enum.Enum) and said else {}
    if said == "decimal" or options.precision is not None or options.scale is not None:
        precision, scale = options.precision if options.precision is not None else 38, options.scale if options.scale is not None else (18 if options.precision is None else 0)
        if said != "decimal":
            raise ModelError("D5", f"{owner}.{name}: precision and scale are for decimals only")
        if not 1 <= precision <= ct.MAX_PRECISION or not 0 <= scale <= precision:
            raise ModelError("D5", f"{owner}.{name}: decimal({precision},{scale}) needs 1 to {ct.MAX_PRECISION} digits and a scale of 0 to as many")
        return ct.decimal_type(precision, scale), {}
    if options.timestamp:
        if said not in ("timestamp_micros", "timestamp_int96", "timestamp_local") or options.timestamp not in ("int96", "micros", "local"):
            raise ModelError("D6", f"{owner}.{name}: timestamp={options.timestamp!r} does not fit {said}")
        said = f"timestamp_{options.timestamp}"
    return ct.TYPES.get(said), values


def _column(owner: str, attribute: str, annotation: typing.Any, options: Options, open_: tuple[type, ...], depth: int) -> Column:
    if depth > DEPTH:
        raise ModelError("D12", f"{owner}.{attribute}: nested deeper than {DEPTH}")
    annotation, nullable = _optional(annotation)
    name = options.name or attribute
    origin = typing.get_origin(annotation)
    if isinstance(annotation, typing.TypeVar) or getattr(annotation, "__parameters__", ()):
        raise ModelError("D9", f"{owner}.{attribute}: generic types have no schema")
    if origin in (list, tuple, dict) or annotation in (list, dict):
        args = [a for a in typing.get_args(annotation) if a is not Ellipsis]
        if not args or origin is tuple and len(args) != 1 or origin is dict and args[0] is not str:
            raise ModelError("D6", f"{owner}.{attribute}: {annotation} is not a list of one type or a map from str")
        inner = _column(owner, attribute, args[-1], Options("element", type=options.type, precision=options.precision, scale=options.scale, timestamp=options.timestamp), open_, depth + 1)
        if inner.kind in ("list", "map"):
            raise ModelError("D6", f"{owner}.{attribute}: a list of lists or maps is not supported")
        if inner.kind == "record" and any(c.kind != "leaf" for c in inner.model.columns):
            raise ModelError("D6", f"{owner}.{attribute}: records in a list hold plain columns only")
        return Column(name, attribute, "map" if origin is dict else "list", nullable, options, element=inner)
    nested = isinstance(annotation, type) and (getattr(annotation, "__record__", None) or annotation in open_)
    if nested:
        if annotation in open_:
            raise ModelError("D11", f"{owner}.{attribute}: {annotation.__name__} holds itself")
        model = describe(annotation, open_, depth + 1)
        if any(c.kind in ("list", "map") for c in model.columns):
            raise ModelError("D6", f"{owner}.{attribute}: a list inside a record column is not supported")
        # A group is always optional in the file.
        return Column(name, attribute, "record", True, options, model=model)
    leaf, values = _leaf(owner, attribute, annotation, options)
    if leaf is None:
        raise ModelError("D6", f"{owner}.{attribute}: type {annotation!r} is not supported")
    return Column(name, attribute, "leaf", nullable, options, leaf=leaf, values=values)


def describe(cls: type, open_: tuple[type, ...] = (), depth: int = 0) -> Model:
    """The model of a record class: base classes' columns first, then by order, then as declared."""
    owner, columns = cls.__name__, []
    if getattr(cls, "__parameters__", ()):
        raise ModelError("D9", f"{owner}: generic classes have no schema")
    hints = typing.get_type_hints(cls, localns={owner: cls})
    seen: dict[str, tuple[typing.Any, Options]] = {}
    for base in reversed(cls.__mro__):
        for name in inspect.get_annotations(base):
            given = base.__dict__.get(name)
            seen[name] = hints[name], given if isinstance(given, Options) else Options()
    for name, (said, options) in seen.items():
        if options.ignore or typing.get_origin(said) is typing.ClassVar:
            continue
        if name.startswith("_"):
            warnings.warn(ModelWarning(f"D4: {owner}.{name} is private and no column"), stacklevel=3)
            continue
        columns.append(_column(owner, name, said, options, (*open_, cls), depth))
    columns.sort(key=lambda c: (c.options.order is None, c.options.order or 0))
    if not columns:
        warnings.warn(ModelWarning(f"D3: {owner} has no columns"), stacklevel=3)
    names = [c.name.lower() for c in columns]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ModelError("D2", f"{owner}: column name used twice: {', '.join(sorted(twice))}")
    model = Model(owner, tuple(columns), cls)
    ids = [i for c in columns for i in _field_ids(c)]
    if twice := {i for i in ids if ids.count(i) > 1}:
        raise ModelError("D17", f"{owner}: field id used twice: {', '.join(map(str, sorted(twice)))}")
    for c in columns:
        if c.options.sort_key and not (c.kind == "leaf" and (c.prunable or c.leaf.name.startswith("timestamp"))):
            raise ModelError("D13", f"{owner}.{c.attribute}: {c.kind if c.kind != 'leaf' else c.leaf.name} columns can't be sort keys")
    return model


def _field_ids(c: Column) -> list[int]:
    own = [c.options.field_id] if c.options.field_id is not None else []
    return own + [i for k in (c.model.columns if c.model else ()) for i in _field_ids(k)] + ([i for i in _field_ids(c.element)] if c.element else [])


_registered: dict[str, type] = {}


def record(cls: type) -> type:
    """Class decorator: checks the declaration and puts the model in cls.__record__."""
    cls.__record__ = describe(cls)
    key = f"{cls.__module__}.{cls.__qualname__}"
    known = _registered.get(key)
    if known is not None and known.__record__ != cls.__record__:
        raise ModelError("D14", f"{key} is declared twice with different columns")
    _registered[key] = cls
    return cls


def model_of(model: Model | type) -> Model:
    return model if isinstance(model, Model) else model.__record__
