"""Declarative field mapping: which columns of a DataFrame are indexed, and as what."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_TYPES = ("text", "keyword", "code", "symbol")
TYPES = (*TEXT_TYPES, "numeric", "boolean", "datetime", "vector")
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"
MAX_DEPTH = 32


class MappingError(ValueError):
    """A mapping or a document id that breaks the rules."""


@dataclass
class FieldMapping:
    type: str = "text"
    analyzer: str = "standard"
    store: bool = True
    index: bool = True
    term_vectors: bool = True
    dims: int = 0
    language: str = ""
    name: str = ""


def text_field(analyzer: str = "standard") -> FieldMapping:
    return FieldMapping("text", analyzer)


def keyword_field() -> FieldMapping:
    return FieldMapping("keyword", "keyword", term_vectors=False)


def code_field() -> FieldMapping:
    return FieldMapping("code", "code")


def symbol_field(language: str = "auto") -> FieldMapping:
    return FieldMapping("symbol", "", language=language)


def numeric_field() -> FieldMapping:
    return FieldMapping("numeric", "")


def boolean_field() -> FieldMapping:
    return FieldMapping("boolean", "")


def datetime_field() -> FieldMapping:
    return FieldMapping("datetime", "")


def vector_field(dims: int) -> FieldMapping:
    return FieldMapping("vector", "", dims=dims)


@dataclass
class DocumentMapping:
    """Fields by name; ``sub`` maps nested structs; ``dynamic`` adds unmapped columns by their type."""

    fields: dict[str, FieldMapping] = field(default_factory=dict)
    sub: dict[str, DocumentMapping] = field(default_factory=dict)
    dynamic: bool = True
    enabled: bool = True

    def add(self, name: str, m: FieldMapping) -> DocumentMapping:
        self.fields[name] = m
        return self

    def add_sub(self, name: str, m: DocumentMapping) -> DocumentMapping:
        self.sub[name] = m
        return self


def static_document() -> DocumentMapping:
    return DocumentMapping(dynamic=False)


@dataclass
class IndexMapping:
    default: DocumentMapping | None = field(default_factory=DocumentMapping)
    types: dict[str, DocumentMapping] = field(default_factory=dict)
    type_field: str = "_type"
    default_analyzer: str = "standard"

    def add_type(self, name: str, m: DocumentMapping) -> IndexMapping:
        self.types[name] = m
        return self

    def validate(self) -> None:
        if self.default is None:
            raise MappingError("a default mapping is needed")
        for m in (self.default, *self.types.values()):
            for name, f in m.fields.items():
                if f.type not in TYPES:
                    raise MappingError(f"field {name}: no type {f.type!r}")

    def analyzer_of(self, name: str) -> str:
        """The analyzer of a field, for highlighting: the default mapping's, then any type's, then the default."""
        for m in (self.default, *self.types.values()):
            at, path = m, name.split(".")
            while at is not None and len(path) > 1:
                at, path = at.sub.get(path[0]), path[1:]
            if at is not None and path[0] in at.fields:
                return at.fields[path[0]].analyzer or self.default_analyzer
        return self.default_analyzer


@dataclass(frozen=True)
class MappedField:
    """A field of the index: its dotted name, the expression that holds it, and its mapping; ``when`` limits it to rows."""

    name: str
    value: Column
    mapping: FieldMapping
    when: Column | None = None


def guess(t: T.DataType) -> FieldMapping | None:
    """The dynamic mapping of a column type; None for types that are not indexed."""
    if isinstance(t, T.StringType):
        return text_field()
    if isinstance(t, T.BooleanType):
        return boolean_field()
    if isinstance(t, (T.NumericType,)):
        return numeric_field()
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return datetime_field()
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType)):
        return vector_field(0)
    return None


def _walk(schema: T.StructType, m: DocumentMapping, prefix: str, when: Column | None, depth: int, default: str) -> list[MappedField]:
    if not m.enabled or depth > MAX_DEPTH:
        return []
    out: list[MappedField] = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        col = F.col(".".join(f"`{p}`" for p in path.split(".")))
        if f.name in m.sub and isinstance(f.dataType, T.StructType):
            out += _walk(f.dataType, m.sub[f.name], path + ".", when, depth + 1, default)
            continue
        how = m.fields.get(f.name) or (guess(f.dataType) if m.dynamic else None)
        if how is None:
            continue
        dynamic = f.name not in m.fields
        if dynamic and how.type == "text" and default != "standard":
            how = text_field(default)
        if dynamic and how.type == "text":
            stamp = col.rlike(RFC3339)  # strings that are timestamps are datetimes, value by value
            out.append(MappedField(path, F.when(~stamp, col), how, when))
            out.append(MappedField(path, F.when(stamp, F.try_to_timestamp(col)), datetime_field(), when))
        else:
            out.append(MappedField(path, col, how, when))
    return out


def mapped_fields(df: DataFrame, mapping: IndexMapping, id_col: str = "doc_id") -> list[MappedField]:
    """The fields that ``mapping`` makes of the columns of ``df``; with types, each limited to the rows of its type."""
    schema = T.StructType([f for f in df.schema.fields if f.name != id_col])
    if not mapping.types:
        return _walk(schema, mapping.default, "", None, 0, mapping.default_analyzer)
    kind = F.col(f"`{mapping.type_field}`") if mapping.type_field in df.columns else F.lit(None).cast("string")
    out: list[MappedField] = []
    for name, m in mapping.types.items():
        out += _walk(schema, m, "", kind == name, 0, mapping.default_analyzer)
    return out + _walk(schema, mapping.default, "", ~F.coalesce(kind.isin(list(mapping.types)), F.lit(False)), 0, mapping.default_analyzer)


def timestamps(col: Column, t: T.DataType) -> Column:
    """A datetime field's values: timestamps as they are, strings in the four accepted layouts, else null."""
    if not isinstance(t, T.StringType):
        return col.cast("timestamp")
    day = F.try_to_timestamp(F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}\z"), col), F.lit("yyyy-MM-dd"))
    plain = F.try_to_timestamp(F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\z"), col), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.coalesce(F.try_to_timestamp(F.when(col.rlike(RFC3339), col)), plain, day)


def valid_id(doc_id: Column) -> Column:
    """Whether an id is not empty, has 512 bytes or fewer, and neither a slash nor a control character."""
    s = doc_id.cast("string")
    return s.isNotNull() & F.octet_length(s).between(1, 512) & ~F.contains(s, F.lit("/")) & ~s.rlike(r"[\x00-\x1f]")
