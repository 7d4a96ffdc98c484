"""The catalog: fields of entities, differences of two catalogs, hierarchies and search by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import text
from ledgerlake.operators.nested import bound
from ledgerlake.sources.tables import kept

SHORTEST_PART, LEAST_TRIGRAMS = 3, 0.2


def fields_of(spark: SparkSession, entities: dict[str, DataFrame]) -> DataFrame:
    """(entity, field, type, nullable) from the entities' schemas; no data is read."""
    rows = [(name, f.name, f.dataType.simpleString(), f.nullable) for name, df in entities.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "entity string, field string, type string, nullable boolean")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity, field, change): added, removed and retyped fields."""
    a = old.select("entity", "field", F.col("type").alias("__old"))
    b = new.select("entity", "field", F.col("type").alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "retyped")
    return a.join(b, ["entity", "field"], "full_outer").select("entity", "field", change.alias("change")).where("change is not null")


def closure(edges: DataFrame, parent: str, child: str, roots: DataFrame) -> DataFrame:
    """(root, node, depth): all that roots reach, themselves included, each once with its least depth. Cycles end.

    A round joins only what the round before has newly found, by shuffles: nothing is broadcast, so the driver gets no rows however many are found. Each is
    written to the shared folder where the cluster names one."""
    links = kept(edges.select(F.col(parent).alias("__p"), F.col(child).alias("__c")).distinct())
    found = roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct()
    fresh, depth = found, 0
    while True:
        depth += 1
        step = fresh.join(links.hint("merge"), F.col("node") == F.col("__p")).select("root", F.col("__c").alias("node")).distinct()
        step = kept(step.join(found.select("root", "node").hint("merge"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            return found
        found, fresh = found.unionByName(step), step


def longest_prefix_parent(names: DataFrame, column: str, separator: str = "_") -> DataFrame:
    """(name, parent): the longest other name that, with a separator, begins the name. Prefixes are exploded and
    joined by equality."""
    rows = names.select(F.col(column).alias("name")).distinct()
    parts = F.split("name", separator)
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator)))
    tried = rows.select("name", F.explode(prefixes).alias("parent")).join(rows.select(F.col("name").alias("parent")), "parent", "left_semi")
    return rows.join(tried.groupBy("name").agg(F.max_by("parent", F.length("parent")).alias("parent")), "name", "left").select("name", "parent")


def name_score(name: Column, query: str, by: Callable[[Column], Column] = text.words_of_name, asked_words: list[str] | None = None) -> Column:
    """How well a name answers a query: equal 100, shared words (by: their stems, or another form of them) 50 and their number, part of the name 30 and
    the share of its length, else 20 times the trigram similarity if that is large enough, else 0. asked_words are the query's words in the form of `by`, if
    they have been worked out."""
    asked = F.array_join(text.words_of_name(F.lit(query)), " ")
    shared = F.size(F.array_intersect(by(name), by(F.lit(query)) if asked_words is None else F.array(*map(F.lit, asked_words))))

    def other(have: Column) -> Column:
        near = bound(text.trigram_similarity(have, asked), lambda s: F.when(s >= LEAST_TRIGRAMS, 20.0 * s).otherwise(F.lit(0.0)))
        return F.when((F.length(asked) >= SHORTEST_PART) & F.contains(have, asked), 30.0 + F.length(asked) / F.length(have)).otherwise(near)

    # each step is worked out once, and only for names that the steps before leave
    return bound(F.array_join(text.words_of_name(name), " "), lambda have: F.when(have == asked, F.lit(100.0)).otherwise(bound(shared, lambda n: F.when(n > 0, 50.0 + n).otherwise(other(have)))))


def find(names: DataFrame, column: str, query: str, limit: int = 10, by: Callable[[Column], Column] = text.words_of_name) -> DataFrame:
    """The best names with their scores, equal scores by name; with by=stems.stems words in other forms are shared too."""
    words = names.sparkSession.range(1).select(by(F.lit(query))).first()[0]  # once, not for each name
    scored = names.select(F.col(column).alias("name"), name_score(F.col(column), query, by, words).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "name").limit(limit)
