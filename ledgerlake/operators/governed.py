"""One path from a request to governed rows: checks, the query itself, masking in two passes, the guard and the budget."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ledgerlake.errors import EngineError
from ledgerlake.functions import checksums, tokens
from ledgerlake.operators import known as lookup
from ledgerlake.operators import masking, nested, query
from ledgerlake.operators import textsearch as search
from ledgerlake.sources.tables import entity, spread

#: Classes whose values are names that free text may repeat.
NAME_CLASSES = nested.NAME_CLASSES
#: Check digits that an open value of a class has to pass before it is compared.
CHECKED = {"inn": checksums.inn_ok, "ogrn": checksums.ogrn_ok, "snils": checksums.snils_ok}
# Words of the names of addresses that are always closed, as goods and people move between them.
MOVING = frozenset("delivery deliver shipping ship shipment loading unloading route residence residential registration birth birthplace".split())
COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "startswith": lambda c, v: F.startswith(c, F.lit(v)),
    "endswith": lambda c, v: F.endswith(c, F.lit(v)),
    "substringof": lambda c, v: F.contains(c, F.lit(v)),
}


@dataclass(frozen=True)
class Policy:
    """secret makes tokens; hidden entities are refused; manual gives classes of fields, by name or path (`keep` opens one, `scan` leaves it to detection), and
    wins over names; base are the classes of a lower layer, whose fields a higher one overrides; dictionary (kind, token, spelling) is what tokens
    stand for, and garbage (token) those of it that no value stands behind.

    strict closes fields that name what they are in, of whatever entity: for tables that nothing is known of. addr_for, if given, opens addresses but
    for these entities and their children, named `<entity>_<name>`; those of deliveries, residence and birth are closed in any case."""

    secret: bytes
    hidden: frozenset[str] = frozenset()
    manual: dict[str, str] = field(default_factory=dict)
    base: dict[str, str] = field(default_factory=dict)
    dictionary: DataFrame | None = None
    garbage: DataFrame | None = None
    strict: bool = False
    addr_for: frozenset[str] | None = None

    def addr_closed(self, name: str, field: str) -> bool:
        if self.addr_for is None or MOVING & {*nested.words_of(field)}:
            return True
        return any(name == e or name.startswith(f"{e}_") for e in self.addr_for)

    def rules(self, df: DataFrame, name: str = "") -> dict[str, str]:
        """Classes by path or field name for a walk over the columns of an entity: the layers, addresses that are open, and what strict closes."""
        out = {**self.base, **self.manual}

        def look(dtype: object, field: str, path: str) -> None:
            for f in getattr(dtype, "fields", ()):
                look(f.dataType, f.name, f"{path}.{f.name}" if path else f.name)
            for inner in (getattr(dtype, "elementType", None), getattr(dtype, "valueType", None)):
                if inner is not None:
                    look(inner, field, path)
            if dtype.simpleString() == "string" and path not in self.manual and field not in self.manual:
                kind = out.get(path, out.get(field)) or nested.class_of_name(field)
                if kind == "addr" and not self.addr_closed(name, field):
                    out[path] = "keep"
                elif kind is None and self.strict and field.lower() in nested.NAMING:
                    out[path] = "org"

        look(df.schema, "", "")
        return out

    def classes(self, df: DataFrame, name: str = "") -> dict[str, tuple[str | None, str]]:
        """Of each field its class and the layer it comes from: manual, base or name."""
        rules, out = self.rules(df, name), {}
        for column, dtype in df.dtypes:
            layer = "manual" if column in self.manual else "base" if column in self.base else "name"
            out[column] = (masking.class_of_field(column, dtype, rules), layer)
        return out


@dataclass(frozen=True)
class Condition:
    """A field compared with a value: the literal belongs to the field."""

    field: str
    operation: str
    value: object


@dataclass(frozen=True)
class Free:
    """A condition given as a column: its literals belong to no field that could be checked, so it may use open fields only. fields are those it uses."""

    column: Column
    fields: tuple[str, ...]


@dataclass(frozen=True)
class All:
    parts: tuple

    def __init__(self, *parts: Condition | Free | All | Any | Not) -> None:
        object.__setattr__(self, "parts", parts)


@dataclass(frozen=True)
class Any:
    parts: tuple

    def __init__(self, *parts: Condition | Free | All | Any | Not) -> None:
        object.__setattr__(self, "parts", parts)


@dataclass(frozen=True)
class Not:
    part: Condition | Free | All | Any | Not


Tree = Condition | Free | All | Any | Not


def conditions_of(tree: Tree) -> Iterator[Condition | Free]:
    if isinstance(tree, Not):
        yield from conditions_of(tree.part)
    elif isinstance(tree, (All, Any)):
        for part in tree.parts:
            yield from conditions_of(part)
    else:
        yield tree


def check_open(kind: str | None, name: str, value: object) -> None:
    """Refuses an open value whose check digits are wrong for the field's class; the message doesn't name it."""
    digits = re.sub(r"[^0-9]", "", value) if kind in CHECKED and isinstance(value, str) else ""
    if digits and not CHECKED[kind](digits):
        raise EngineError("filter_syntax", f"the value for {name} doesn't pass the check digits of {kind}", "check the value, or give a token")


def check_condition(df: DataFrame, policy: Policy, c: Condition | Free, name: str = "") -> str | None:
    """The token that a condition is with, if it is. Refuses unknown fields and operations, ordered comparison of protected fields, damaged tokens, tokens of
    another class, open values against fields that take tokens only, wrong check digits, and a free column on a protected field."""
    known = policy.classes(df, name)
    fields = c.fields if isinstance(c, Free) else (c.field,)
    if missing := [f for f in fields if f not in known]:
        raise EngineError("filter_syntax", f"no fields: {', '.join(missing)}")
    if isinstance(c, Free):
        if closed := [f for f in fields if known[f][0]]:
            raise EngineError("filter_syntax", f"a literal isn't bound to a field, and {', '.join(closed)} is protected in the same condition", "compare the field itself with the literal")
        return None
    if c.operation not in COMPARE:
        raise EngineError("filter_syntax", f"{c.operation} is not an operation")
    kind = known[c.field][0]
    whole = re.fullmatch(tokens.TOKEN, c.value) if isinstance(c.value, str) else None
    masking.check_filter({c.field: kind}, c.field, c.operation, whole is not None)
    if whole is None:
        if isinstance(c.value, str) and re.search(r"\[\[|\]\]", c.value):
            raise EngineError("token_partial", "the token is damaged")
        if c.operation in ("eq", "ne"):
            check_open(kind, c.field, c.value)
        return None
    if c.operation not in ("eq", "ne", "substringof"):
        raise EngineError("filter_syntax", f"a token can't be used with {c.operation}")
    if kind != whole[1]:
        raise EngineError("token_type_mismatch", f"{c.field} doesn't hold values of the class {whole[1]}")
    return c.value


def condition(df: DataFrame, policy: Policy, tree: Tree, name: str = "", found: dict[str, list[str]] | None = None) -> Column:
    """The tree as a column, see check_condition(). A token stands for its spellings, so a token that is part of something is an equality. found holds
    the spellings of tokens that have been looked up, and gets those of this tree; `and`, `or` and `not` pass on nothing but truth, so each
    part is checked by itself."""
    found = {} if found is None else found
    for c in conditions_of(tree):  # all checks come before anything is read
        token = check_condition(df, policy, c, name)
        if token is not None and policy.dictionary is None:
            raise EngineError("token_unknown", "there is no dictionary")

    def column(part: Tree) -> Column:
        if isinstance(part, Not):
            return ~column(part.part)
        if isinstance(part, (All, Any)):
            out = F.lit(isinstance(part, All))
            for p in part.parts:
                out = out & column(p) if isinstance(part, All) else out | column(p)
            return out
        if isinstance(part, Free):
            return part.column
        if isinstance(part.value, str) and re.fullmatch(tokens.TOKEN, part.value):
            if part.value not in found:
                found[part.value] = masking.spellings(policy.dictionary, part.value)
            hit = F.col(part.field).isin(found[part.value])
            return ~hit if part.operation == "ne" else hit
        return COMPARE[part.operation](F.col(part.field), part.value)

    return column(tree)


def _names_in(df: DataFrame, policy: Policy, rules: dict[str, str], odd: DataFrame | None) -> DataFrame:
    """(spelling, token) of the names in the fields of df that are closed as names, as they are shown."""
    taken = lambda leaf: leaf.kind in NAME_CLASSES if isinstance(leaf.kind, (str, type(None))) else True
    row = lambda leaf: F.struct((F.lit(leaf.kind) if isinstance(leaf.kind, str) else leaf.kind).alias("kind"), leaf.value.alias("spelling"))
    cells = nested.gather(df, rules, lambda leaf: row(leaf) if taken(leaf) and leaf.contact is None else None, "struct<kind:string,spelling:string>")
    named = df.select(F.inline(cells)).where(F.col("kind").isin(*NAME_CLASSES) & F.col("spelling").isNotNull()).distinct()
    named = named.where(~F.col("spelling").rlike(nested.GUID) & ~tokens.is_token(F.col("spelling")))
    of = lambda signs: tokens.token_of(F.col("kind"), F.col("spelling"), policy.secret, signs)
    if odd is None:
        return named.select("spelling", of(10).alias("token"))
    long = named.select("spelling", of(10).alias("__short"), of(masking.LONG_TAIL).alias("long"))
    return long.join(odd, "long", "left").select("spelling", F.coalesce("token", "__short").alias("token"))


def mask_rows(df: DataFrame, policy: Policy, names: DataFrame | None = None, name: str = "") -> DataFrame:
    """df masked in two passes: first every field of a class, inside structs, arrays and maps too, by which the names in it become known; then, in all other
    text, the dictionary's known numbers across separators, the variants of those names and the dictionary's, and what detection finds. A value that the
    dictionary has is shown by its token there. guard_replaced counts the fields that the last step changed.

    names (spelling, token) may add to what is known; name is the entity's. Rows need no key, and the plan has as many relations for many columns as for one."""
    rules = policy.rules(df, name)
    df = spread(df)
    closed, known, odd = masking.with_long_tokens(df, policy.secret, rules, policy.dictionary)
    book = policy.dictionary
    if book is not None and policy.garbage is not None:
        book = book.join(policy.garbage.select("token"), "token", "left_anti")
    every = [_names_in(df, policy, rules, odd)]
    if book is not None:
        every.append(book.where(F.col("kind").isin(*NAME_CLASSES)).select("spelling", "token"))
    if names is not None:
        every.append(names.select("spelling", "token"))
    all_names = every[0]
    for more in every[1:]:
        all_names = all_names.unionByName(more)
    free = any(nested.has_strings(f.dataType) for f in df.schema.fields if rules.get(f.name) != "keep")
    parts = search.books(masking.variants_of(all_names), None if book is None else lookup.numbers_of(book)) if free else []
    parts = [b for b in parts if b.names or b.numbers]
    open_fields = frozenset(f for f, kind in rules.items() if kind == "keep")
    out = masking.rewrite_strings(closed, known, odd, parts, open_fields) if parts or odd is not None else closed
    return masking.guard(out, policy.secret)


def governed_query(
    spark: SparkSession,
    folder: str,
    name: str,
    policy: Policy,
    select: list[str] | None = None,
    where: list[Condition] | None = None,
    order: list[str] | None = None,
    top: int | None = None,
    skip: int = 0,
    budget: int | None = None,
    rows: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """(rows, warnings). All checks run before any row is read: a hidden entity, unknown fields, conditions (all of `where` hold; each may be a tree) and an
    order on protected fields are refused. What the query's tokens stand for is closed in its rows' texts too. order has to be total; without
    one, rows come by their fields that aren't text and then by a keyed digest, which tells nothing of what is closed.
    rows stands in for the entity's own, as after an expansion."""
    source = entity(spark, folder, name, policy.hidden)
    df = source if rows is None else rows
    known = policy.classes(df, name)
    chosen = select or df.columns
    if unknown := [f for f in (*chosen, *(order or [])) if f not in known]:
        raise EngineError("params_invalid", f"no fields: {', '.join(unknown)}")
    query.check_order(order or [], {f for f, (kind, _) in known.items() if kind})
    warnings: list[str] = []
    found: dict[str, list[str]] = {}
    if where:
        df = df.where(condition(df, policy, All(*where), name, found))
    revealed = [(s, token) for token, spelled in found.items() for s in spelled]  # what this query's tokens stand for, a few spellings each
    keys = order
    if not keys:
        df = df.withColumn("__order", tokens.keyed_digest(F.to_json(F.struct(*df.columns)), policy.secret))
        plain = ("bigint", "int", "smallint", "tinyint", "double", "float", "date", "timestamp", "timestamp_ntz", "boolean")
        keys = [*(c for c, t in df.dtypes if c in chosen and (t in plain or t.startswith("decimal"))), "__order"]
    needed = [*chosen, *(k for k in keys if k not in chosen)]
    paged = query.page(df.select(*needed), [F.col(k) for k in keys], top, skip, warnings)
    scrubbed = spark.createDataFrame(revealed, "spelling string, token string") if revealed else None
    inside = replace(policy, manual={**policy.manual, "__order": "keep"})
    out = mask_rows(paged, inside, scrubbed, name)
    if budget is not None:
        out = query.fits(out, keys, budget).drop("size")
    return out.orderBy(*(F.col(k) for k in keys)).select(*chosen, "guard_replaced"), warnings  # joins in between keep no order


def raw_rows(df: DataFrame, policy: Policy, known: dict[str, str] | None = None, name: str = "") -> DataFrame:
    """Rows of whatever shape, as a path that is in no catalog has given them, masked the strict way: what names a thing is closed, everything else is searched, and
    nothing a protocol adds is left. known are classes that are told of some fields."""
    strict = replace(policy, strict=True, base={**policy.base, **(known or {})})
    return mask_rows(without_service_columns(df), strict, name=name)


SERVICE = ("odata.metadata", "odata.type", "odata.etag", "__metadata", "__deferred", "DataVersion")


def without_service_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """df without the columns, and the fields inside its structs, arrays and maps, that a protocol adds, and those that begin with them. keep are asked for."""
    service = lambda c: c not in keep and any(c == s or c.startswith(s + ".") or c.endswith("@" + s) for s in SERVICE)

    def stripped(c: Column, dtype: DataType) -> Column | None:
        """The column without them; None if there is nothing to strip."""
        if isinstance(dtype, StructType):
            parts = {f.name: stripped(c[f.name], f.dataType) for f in dtype.fields if not service(f.name)}
            if len(parts) == len(dtype.fields) and not any(x is not None for x in parts.values()):
                return None
            return F.when(c.isNotNull(), F.struct(*((c[n] if x is None else x).alias(n) for n, x in parts.items())))
        inner = dtype.elementType if isinstance(dtype, ArrayType) else dtype.valueType if isinstance(dtype, MapType) else None
        if inner is None or stripped(F.lit(None).cast(inner), inner) is None:
            return None
        return F.transform(c, lambda x: stripped(x, inner)) if isinstance(dtype, ArrayType) else F.transform_values(c, lambda k, x: stripped(x, inner))

    out = []
    for f in df.schema.fields:
        if not service(f.name):
            c = F.col(f"`{f.name}`")
            x = stripped(c, f.dataType)
            out.append(c if x is None else x.alias(f.name))
    return df.select(*out)


def with_representation(df: DataFrame, references: dict[str, tuple[DataFrame, str, str]], suffix: str = "_text") -> DataFrame:
    """df with, next to each reference field, the text of the row it points at; references are field -> (target, key, text)."""
    for name, (target, key, text) in references.items():
        right = target.select(F.col(key).alias("__key"), F.col(text).alias(name + suffix))
        df = df.join(right, F.col(name) == F.col("__key"), "left").drop("__key")
    return df
