"""Values inside structs, arrays and maps: one expression for each column, built by a walk over its type.

A walk hands a class down: what names a thing inside a struct, array or map that stands for an organisation or a person is of that
class, if its own name says nothing. Rows of contacts have the class that their type says. Keys of maps are names of fields,
so the class of a map's value is worked out in its row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ledgerlake.functions import tokens

# Marks of field names, of containers that stand for somebody, of fields that name what they are in, and of contacts.
NAME_RULES = (
    ("email", ("email", "mail")),
    ("phone", ("phone", "tel", "fax")),
    ("snils", ("snils",)),
    ("iban", ("iban",)),
    ("card", ("card",)),
    ("acc", ("account", "acct")),
    ("ogrn", ("ogrn",)),
    ("kpp", ("kpp",)),
    ("inn", ("inn", "tin")),
    ("dob", ("birth", "dob")),
    ("doc", ("passport",)),
    ("addr", ("address", "addr")),
    ("org", ("name",)),
)
CONTAINERS = (
    ("org", ("contractor", "counterparty", "organization", "organisation", "company", "supplier", "vendor", "customer", "client", "partner", "контрагент", "организация", "партнер", "партнёр")),
    ("person", ("employee", "person", "manager", "author", "responsible", "сотрудник", "физлицо", "физическоелицо", "ответственный")),
)
NAMING = frozenset({"description", "presentation", "title", "label", "text", "fullname", "наименование", "представление", "фио"})
CONTACT_ROWS = frozenset({"contact", "contacts", "контактнаяинформация"})
CONTACT_TYPE, CONTACT_VALUES = frozenset({"type", "тип"}), frozenset({"presentation", "value", "представление", "значение", "значенияполей"})
CONTACT_OPEN = frozenset({"line_number", "linenumber", "ref_key", "valid_from", "действуетс"})
CONTACT_CLASSES = {"Телефон": "phone", "Факс": "phone", "АдресЭлектроннойПочты": "email", "Адрес": "addr", "phone": "phone", "fax": "phone", "email": "email", "address": "addr"}
CONTACT_OTHERS = ("ВебСтраница", "Skype", "Другое", "web", "skype", "other")
NAME_CLASSES = ("org", "person")
GUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
EXTENSION = r"(?i)[\s,;]*(?:доб(?:авочный)?|ext|вн)\.?\s*\d{1,6}$"


def words_of(name: str) -> list[str]:
    return re.sub(r"([a-zа-яё0-9])([A-ZА-ЯЁ])", r"\1_\2", name).lower().split("_")


def class_of_name(name: str) -> str | None:
    return next((kind for kind, marks in NAME_RULES if any(p in marks for p in words_of(name))), None)


def class_of_container(name: str) -> str | None:
    """The class that a container hands down; that of a name too, where a struct stands for the one it names."""
    parts = {*words_of(name), name.lower()}
    own = next((kind for kind, marks in CONTAINERS if parts & {*marks}), None)
    return own or (kind if (kind := class_of_name(name)) in NAME_CLASSES else None)


@dataclass(frozen=True)
class Leaf:
    """A string inside a column. name is that of the nearest field; kind its class, `keep` for an open one, None for free text. In maps kind is
    a column, empty for free text. contact is the class of the contact row that it is in, as a column."""

    value: Column
    path: str
    name: str
    kind: str | Column | None
    contact: Column | None = None


def has_strings(dtype: DataType) -> bool:
    if isinstance(dtype, StructType):
        return any(has_strings(f.dataType) for f in dtype.fields)
    if isinstance(dtype, (ArrayType, MapType)):
        return has_strings(dtype.elementType if isinstance(dtype, ArrayType) else dtype.valueType)
    return isinstance(dtype, StringType)


def class_of_key(key: Column, manual: dict[str, str], inherited: str | None) -> Column:
    """The class that a map's key gives its value; an empty string for free text."""
    spaced = F.regexp_replace(key, r"([a-zа-яё0-9])([A-ZА-ЯЁ])", "$1_$2")
    parts = F.split(F.lower(spaced), "_")
    out = F.when(F.lower(key).isin(*sorted(NAMING)), F.lit(inherited)) if inherited else F.lit(None).cast("string")
    for kind, marks in reversed(NAME_RULES):
        out = F.when(F.arrays_overlap(parts, F.array(*map(F.lit, marks))), kind).otherwise(out)
    for name, kind in manual.items():
        out = F.when(key == name, F.lit(kind)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def representation(x: Column) -> Column:
    """The text of a contact's value, by which it is one value in every form: `value` of JSON, the presentation of XML, else the text."""
    json = F.when(F.startswith(F.trim(x), F.lit("{")), F.get_json_object(x, "$.value"))
    xml = F.when(F.startswith(F.trim(x), F.lit("<")), F.nullif(F.regexp_extract(x, r'(?:Представление|[Pp]resentation)="([^"]*)"', 1), F.lit("")))
    for written, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        xml = F.replace(xml, F.lit(written), F.lit(sign))
    return F.coalesce(F.when(F.trim(json) != "", json), xml, x)


def contact_class(kind: Column | None, *values: Column) -> Column:
    """The class of a contact row: by its type, by the type inside a JSON value, else by what the first value that isn't null looks like."""
    types = [*([F.trim(kind)] if kind is not None else []), *(F.when(F.startswith(F.trim(v), F.lit("{")), F.get_json_object(v, "$.type")) for v in values)]
    classes = F.create_map(*(F.lit(x) for kv in CONTACT_CLASSES.items() for x in kv))
    of_type = F.coalesce(*(F.when(t.isNotNull(), F.try_element_at(classes, t)) for t in types))

    def by_look(text: Column) -> Column:
        number = F.regexp_replace(F.trim(text), EXTENSION, "")
        phone = number.rlike(r"^[\d\s()+\-.,/]+$") & (F.length(F.regexp_replace(number, r"\D", "")) >= 5)
        return F.when(text.rlike(r"[^\s@]+@[^\s@]+\.[^\s@]+"), "email").when(phone, "phone").otherwise("addr")

    return F.coalesce(of_type, bound(F.coalesce(*(representation(v) for v in values)), by_look))


def contact_json(x: Column) -> Column:
    """Whether a text is a contact's value as JSON, by its type."""
    kind = F.when(F.startswith(F.trim(x), F.lit("{")), F.get_json_object(x, "$.type"))
    return F.coalesce(F.trim(kind).isin(*CONTACT_CLASSES, *CONTACT_OTHERS), F.lit(False))


def is_contact_row(dtype: StructType, name: str) -> bool:
    fields = {f.name.lower() for f in dtype.fields if isinstance(f.dataType, StringType)}
    values = fields & CONTACT_VALUES
    return bool(values) and (bool(CONTACT_ROWS & {*words_of(name), name.lower()}) or (bool(fields & CONTACT_TYPE) and len(values) > 1))


class Rebuild:
    """Columns of the type they had, with make(leaf) for each string."""

    def __init__(self, make: Callable[[Leaf], Column]) -> None:
        self.leaf = make

    def other(self, c: Column) -> Column:
        return c

    def struct(self, c: Column, parts: dict[str, Column]) -> Column:
        return F.when(c.isNotNull(), F.struct(*(x.alias(name) for name, x in parts.items())))

    def each(self, c: Column, dtype: ArrayType, of: Callable[[Column], Column]) -> Column:
        return F.transform(c, of)

    def values(self, c: Column, dtype: MapType, of: Callable[[Column, Column], Column]) -> Column:
        return F.transform_values(c, of)


class Gather:
    """One array, of elements of the type `kind`, with pick(leaf) for each string for which that isn't None."""

    def __init__(self, pick: Callable[[Leaf], Column | None], kind: str) -> None:
        self.pick, self.none = pick, F.expr(f"cast(array() as array<{kind}>)")

    def leaf(self, leaf: Leaf) -> Column:
        got = self.pick(leaf)
        return self.none if got is None else F.array(got)

    def other(self, c: Column) -> Column:
        return self.none

    def struct(self, c: Column, parts: dict[str, Column]) -> Column:
        return F.concat(*parts.values())

    def each(self, c: Column, dtype: ArrayType, of: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(F.coalesce(c, F.expr(f"cast(array() as {dtype.simpleString()})")), of))

    def values(self, c: Column, dtype: MapType, of: Callable[[Column, Column], Column]) -> Column:
        pairs = F.map_entries(F.coalesce(c, F.expr(f"cast(map() as {dtype.simpleString()})")))
        return F.flatten(F.transform(pairs, lambda p: of(p["key"], p["value"])))


def walk(c: Column, dtype: DataType, name: str, manual: dict[str, str], to: Rebuild | Gather, path: str = "", inherited: str | None = None, contact: Column | None = None) -> Column:
    """What `to` makes of a column's strings. manual has classes by path (`items.note`) or by name; inherited is the class that containers
    hand down, contact that of the contact row around."""
    path = path or name
    if not has_strings(dtype):
        return to.other(c)
    own = manual.get(path, manual.get(name))
    if isinstance(dtype, StringType):
        kind = own or class_of_name(name)
        if contact is not None and own in (None, "scan"):
            closed = name.lower() not in CONTACT_OPEN | CONTACT_TYPE and not name.lower().endswith(("_key", "_type"))
            return to.leaf(Leaf(c, path, name, None if closed else "keep", contact if closed else None))
        if kind is None and inherited and name.lower() in NAMING:
            kind = inherited
        return to.leaf(Leaf(c, path, name, None if kind == "scan" else kind))
    handed = own if own in NAME_CLASSES else class_of_container(name) or inherited
    if isinstance(dtype, ArrayType):
        return to.each(c, dtype, lambda x: walk(x, dtype.elementType, name, manual, to, path, handed, contact))
    if isinstance(dtype, MapType):
        if isinstance(dtype.valueType, StringType) and isinstance(dtype.keyType, StringType):
            return to.values(c, dtype, lambda k, v: to.leaf(Leaf(v, path, name, class_of_key(k, manual, handed))))
        return to.values(c, dtype, lambda k, v: walk(v, dtype.valueType, name, manual, to, path, handed))
    row = None
    if is_contact_row(dtype, name):
        fields = {f.name.lower(): f.name for f in dtype.fields if isinstance(f.dataType, StringType)}
        kind = next((c[fields[t]] for t in sorted(CONTACT_TYPE) if t in fields), None)
        row = contact_class(kind, *(c[fields[v]] for v in sorted(CONTACT_VALUES) if v in fields))
    return to.struct(c, {f.name: walk(c[f.name], f.dataType, f.name, manual, to, f"{path}.{f.name}", handed, row) for f in dtype.fields})


def rewrite(df: DataFrame, manual: dict[str, str], make: Callable[[Leaf], Column], only: Callable[[str, DataType], bool] = lambda name, dtype: True) -> DataFrame:
    """df with make(leaf) for every string of every column that `only` takes."""
    to = Rebuild(make)
    mine = lambda f: has_strings(f.dataType) and only(f.name, f.dataType)
    return df.select(*(walk(F.col(f"`{f.name}`"), f.dataType, f.name, manual, to).alias(f.name) if mine(f) else F.col(f"`{f.name}`") for f in df.schema.fields))


def gather(df: DataFrame, manual: dict[str, str], pick: Callable[[Leaf], Column | None], kind: str, only: Callable[[str, DataType], bool] = lambda name, dtype: True) -> Column:
    """One array of pick(leaf), elements of the type `kind`, over every string of every column that `only` takes."""
    to = Gather(pick, kind)
    parts = [walk(F.col(f"`{f.name}`"), f.dataType, f.name, manual, to) for f in df.schema.fields if has_strings(f.dataType) and only(f.name, f.dataType)]
    return F.concat(*parts) if parts else to.none


def token_of_leaf(leaf: Leaf, secret: bytes, signs: int = 10, mark: str = "") -> Column:
    """The leaf's value as its class's token, in front of which stands `mark`; free text, GUIDs, tokens and nulls as they are. Of fields that are named as
    values or contacts, a contact's JSON is closed by its type."""
    x = leaf.value
    open_ = x.rlike(GUID) | tokens.is_token(x)
    if isinstance(leaf.kind, Column):
        closed = lambda kind: F.when(kind.isin("", "keep", "scan") | open_, x).otherwise(F.concat(F.lit(mark), tokens.token_of(kind, x, secret, signs)))
        return bound(leaf.kind, closed)
    if leaf.kind == "keep":
        return x
    if leaf.kind is not None:
        return F.when(open_, x).otherwise(F.concat(F.lit(mark), tokens.token(leaf.kind, x, secret, signs)))
    if leaf.contact is None and not (leaf.name.lower() in CONTACT_VALUES or CONTACT_ROWS & {*words_of(leaf.name)}):
        return x
    kind = leaf.contact if leaf.contact is not None else contact_class(None, x)
    closed = bound(F.struct(kind.alias("kind"), representation(x).alias("text")), lambda v: F.concat(F.lit(mark), tokens.token_of(v["kind"], v["text"], secret, signs)))
    return F.when(open_ | (F.lit(False) if leaf.contact is not None else ~contact_json(x)), x).otherwise(closed)
