"""Schemas with single inheritance, kept on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from framepack.errors import SchemaError


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    optional: bool = False
    compression: str | None = None


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    extends: str | None = None
    hints: tuple = field(default=())


class SchemaRegistry:
    """Schemas by name; registering a name again replaces it."""

    def __init__(self) -> None:
        self._schemas: dict[str, Schema] = {}

    def register(self, schema: Schema) -> None:
        if not schema.name:
            raise SchemaError("a schema needs a name")
        if not schema.fields:
            raise SchemaError(f"schema {schema.name!r} has no fields")
        names = [f.name for f in schema.fields]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise SchemaError(f"schema {schema.name!r} has fields twice: {', '.join(twice)}")
        self._schemas[schema.name] = schema

    def get(self, name: str) -> Schema | None:
        return self._schemas.get(name)

    def has(self, name: str) -> bool:
        return name in self._schemas

    def names(self) -> list[str]:
        return list(self._schemas)

    def clear(self) -> None:
        self._schemas.clear()

    def delete(self, name: str) -> bool:
        return self._schemas.pop(name, None) is not None

    def resolved(self, name: str) -> Schema:
        """The schema with its ancestors' fields before its own; a child's field replaces an ancestor's of the same name."""
        chain: list[Schema] = []
        at: str | None = name
        while at is not None:
            if at in [s.name for s in chain]:
                raise SchemaError(f"schema {name!r} inherits from itself through {at!r}")
            if (s := self._schemas.get(at)) is None:
                raise SchemaError(f"schema {at!r} is not registered")
            chain.append(s)
            at = s.extends
        fields: dict[str, Field] = {}
        for s in reversed(chain):
            fields |= {f.name: f for f in s.fields}
        return Schema(name, tuple(fields.values()), None, self._schemas[name].hints)


global_schemas = SchemaRegistry()


def register_schema(schema: Schema) -> None:
    global_schemas.register(schema)


def get_schema(name: str) -> Schema | None:
    return global_schemas.get(name)


def list_schemas() -> list[str]:
    return global_schemas.names()
