"""Relations of entities, found in their data: unique keys, references, and what hangs on them.

A field refers to a key if its name ends as the key's does and every value of it is a key. Keys are told by one pass over each entity;
of a pair of fields first the ranges are compared, then the values in one residue of a hash, which is a sample of both
sides by the same rule, and only pairs that pass both are joined whole. Nothing is collected but a row for each field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import nested

#: Types that keys have.
KEY_TYPES = ("tinyint", "smallint", "int", "bigint", "string", "date")
#: Values of a key that the sample has, about; approximate counts from this part of the rows on are counted exactly. Their standard error
#: is 5 %, so a key is passed over at ten deviations only.
SAMPLED, NEARLY = 2000, 0.5


def stem_of(field: str) -> str:
    """What of a field's name says what it refers to: without a prefix that stands for its entity. `o_custkey` gives `custkey`."""
    head, _, rest = field.partition("_")
    return (rest if rest and len(head) <= 2 else field).lower()


def unique_keys(entities: dict[str, DataFrame]) -> DataFrame:
    """(entity, field, type, n_rows, least, most, unique) of the fields of all entities that may be keys. unique: no null and no value twice; an empty entity has none."""
    found = None
    for name, df in entities.items():
        fields = [(f, t) for f, t in df.dtypes if t in KEY_TYPES]
        if not fields:
            continue
        rough = df.agg(F.count("*").alias("n"), *(F.approx_count_distinct(f).alias(f) for f, _ in fields)).first()
        likely = [f for f, _ in fields if rough["n"] and rough[f] >= NEARLY * rough["n"]]
        sums = [F.count("*").alias("n"), *(x for f, _ in fields for x in (F.min(f).cast("string").alias(f"a_{f}"), F.max(f).cast("string").alias(f"z_{f}")))]
        exact = [((F.count_distinct(f) == F.count("*")) & (F.count(f) == F.count("*"))).alias(f"u_{f}") for f in likely]
        whole = df.agg(*sums, *exact)
        cell = lambda f, t: F.struct(F.lit(name).alias("entity"), F.lit(f).alias("field"), F.lit(t).alias("type"), F.col("n").alias("n_rows"), F.col(f"a_{f}").alias("least"), F.col(f"z_{f}").alias("most"), (F.col(f"u_{f}") if f in likely else F.lit(False)).alias("unique"))  # noqa: B023, E731
        rows = whole.select(F.inline(F.array(*(cell(f, t) for f, t in fields))))
        found = rows if found is None else found.unionByName(rows)
    return found


@dataclass(frozen=True)
class Relation:
    entity: str
    field: str
    target: str
    key: str


def _family(kind: str) -> str:
    return "number" if kind in ("tinyint", "smallint", "int", "bigint") else kind


def _inside(low: str, high: str, least: str, most: str, kind: str) -> bool:
    as_value = int if _family(kind) == "number" else str
    return as_value(least) <= as_value(low) and as_value(high) <= as_value(most)


def find_relations(entities: dict[str, DataFrame]) -> list[Relation]:
    """The references between entities. Null values refer to nothing; a field without values, and one in whose reach no key is, has no relation."""
    fields = unique_keys(entities).collect()  # a row for each field of the catalog
    keys = [f for f in fields if f["unique"]]
    found = []
    for f in fields:
        for k in keys:
            same = (f["entity"], f["field"]) == (k["entity"], k["field"])
            if same or stem_of(f["field"]) != stem_of(k["field"]) or _family(f["type"]) != _family(k["type"]) or f["least"] is None:
                continue
            if f["entity"] == k["entity"] or not _inside(f["least"], f["most"], k["least"], k["most"], f["type"]):
                continue
            values = entities[f["entity"]].select(F.col(f["field"]).cast("string").alias("v")).where("v is not null")
            targets = entities[k["entity"]].select(F.col(k["field"]).cast("string").alias("v"))
            residues = max(1, k["n_rows"] // SAMPLED)
            for n in (residues, 1) if residues > 1 else (1,):
                part = F.pmod(F.xxhash64("v"), F.lit(n)) == 0
                if not values.where(part).distinct().join(targets.where(part), "v", "left_anti").isEmpty():
                    break
            else:
                found.append(Relation(f["entity"], f["field"], k["entity"], k["field"]))
    return found


def relation_rows(spark: SparkSession, relations: list[Relation]) -> DataFrame:
    return spark.createDataFrame([(r.entity, r.field, r.target, r.key) for r in relations], "entity string, field string, target string, key string")


def children_of(hidden: frozenset[str], names: list[str]) -> frozenset[str]:
    """Hidden entities with their children, which are named `<entity>_<name>`."""
    return hidden | {n for n in names if any(n.startswith(f"{h}_") for h in hidden)}


def text_field(df: DataFrame, explicit: str | None = None) -> str | None:
    """The field that stands for a row: the one that is named, else the only one that names what it is in, else the only string."""
    strings = [f for f, t in df.dtypes if t == "string"]
    if explicit is not None:
        return explicit if explicit in strings else None
    naming = [f for f in strings if nested.class_of_name(f) in nested.NAME_CLASSES or nested.words_of(f)[-1] in nested.NAMING]
    return naming[0] if len(naming) == 1 else strings[0] if len(strings) == 1 else None


def with_references(df: DataFrame, name: str, entities: dict[str, DataFrame], relations: list[Relation], hidden: frozenset[str] = frozenset(), texts: dict[str, str] | None = None, suffix: str = "_text") -> DataFrame:
    """df, rows of an entity, with, next to each reference, the text of the row it points at (`<field>_text`) and the entity that it is in (`<field>_type`); texts may name the
    field of a target that stands for it. A reference that points nowhere has null for both. References to hidden entities and their children go,
    and give neither."""
    closed = children_of(hidden, list(entities))
    for r in relations:
        if r.entity != name or r.field not in df.columns:
            continue
        if r.target in closed:
            df = df.drop(r.field)
            continue
        target = entities[r.target]
        shown = text_field(target, (texts or {}).get(r.target))
        right = target.select(F.col(r.key).alias("__key"), *([F.col(shown).alias(f"{r.field}{suffix}")] if shown else []))
        df = df.join(right, F.col(r.field) == F.col("__key"), "left").withColumn(f"{r.field}_type", F.when(F.col("__key").isNotNull(), F.lit(r.target))).drop("__key")
    return df

