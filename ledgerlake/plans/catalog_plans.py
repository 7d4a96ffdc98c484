"""Queries of the catalog: fields, classes, differences, hierarchies, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import stems
from ledgerlake.functions.text import trigram_similarity, words_of_name
from ledgerlake.operators import catalog as cat
from ledgerlake.operators import relations as rel
from ledgerlake.operators.masking import class_of_field
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import entity, spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def fields(spark: SparkSession, sf: str) -> DataFrame:
    return cat.fields_of(spark, {t: entity(spark, sf, t) for t in TABLES})


_TYPES = "CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END"
_FIELDS = f"(SELECT table_name AS entity, column_name AS field, {_TYPES} AS type FROM duckdb_columns() WHERE table_name IN {TABLES})"


@query("catalog_fields", f"SELECT entity, field, type FROM {_FIELDS}")
def catalog_fields(spark: SparkSession, sf: str) -> DataFrame:
    return fields(spark, sf).select("entity", "field", "type")


@query("catalog_counts", f"SELECT type, count(*) AS n FROM {_FIELDS} GROUP BY type ORDER BY n DESC, type")
def catalog_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fields(spark, sf).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


@query("catalog_diff", f"SELECT entity, field, CASE WHEN entity = 'region' THEN 'removed' WHEN field = 'o_totalprice' THEN 'retyped' ELSE 'added' END AS change FROM (SELECT entity, field FROM {_FIELDS} WHERE entity = 'region' OR field = 'o_totalprice' UNION ALL SELECT 'orders', 'o_comment')")
def catalog_diff(spark: SparkSession, sf: str) -> DataFrame:
    old = fields(spark, sf)
    more = spark.createDataFrame([("orders", "o_comment", "string", True)], old.schema)
    new = old.where("entity <> 'region'").withColumn("type", F.when(F.col("field") == "o_totalprice", "decimal(18,2)").otherwise(F.col("type"))).unionByName(more)
    return cat.diff(old, new)


_CLASSED = (("customer", "c_name", "org"), ("nation", "n_name", "org"), ("part", "p_name", "org"), ("region", "r_name", "org"), ("supplier", "s_name", "org"))


@query("classify_fields", " UNION ALL ".join(f"SELECT '{e}' AS entity, '{f}' AS field, '{k}' AS class, count({f}) AS n_values, count(DISTINCT {f}) AS n_distinct FROM {e}" for e, f, k in _CLASSED))
def classify_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of a class of all tables, and how many values of it they hold."""
    found = None
    for table in TABLES:
        rows = entity(spark, sf, table)
        classed = [(f, k) for f, kind in rows.dtypes if (k := class_of_field(f, kind))]
        if classed:
            sums = rows.agg(*(x for f, _ in classed for x in (F.count(f).alias(f"n_{f}"), F.count_distinct(f).alias(f"d_{f}"))))
            cells = F.array(*(F.struct(F.lit(table).alias("entity"), F.lit(f).alias("field"), F.lit(k).alias("class"), F.col(f"n_{f}").alias("n_values"), F.col(f"d_{f}").alias("n_distinct")) for f, k in classed))
            found = sums.select(F.inline(cells)) if found is None else found.unionByName(sums.select(F.inline(cells)))
    return found


@query(
    "closure",
    """WITH RECURSIVE e AS (SELECT p_partkey // 3 AS p, p_partkey AS c FROM part UNION ALL SELECT p_partkey, p_partkey // 9 FROM part WHERE p_partkey % 10 = 0),
    r(root, node) AS (SELECT 5::BIGINT, 5::BIGINT UNION SELECT root, c FROM r JOIN e ON node = p) SELECT root, node FROM r""",
)
def closure(spark: SparkSession, sf: str) -> DataFrame:
    """A hierarchy with some links back, so that it has cycles."""
    part = entity(spark, sf, "part")
    edges = part.select(F.expr("p_partkey div 3").alias("p"), F.col("p_partkey").alias("c")).unionByName(part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("p"), F.expr("p_partkey div 9").alias("c")))
    return cat.closure(edges, "p", "c", spark.createDataFrame([(5,)], "id long")).select("root", "node")


@query("longest_prefix_parent", "WITH n AS (SELECT entity AS name FROM " + _FIELDS + " UNION SELECT entity || '_' || field FROM " + _FIELDS + " UNION SELECT entity || '_' || field || '_row' FROM " + _FIELDS + ") SELECT a.name, arg_max(b.name, length(b.name)) AS parent FROM n a LEFT JOIN n b ON starts_with(a.name, b.name || '_') GROUP BY a.name")
def longest_prefix_parent(spark: SparkSession, sf: str) -> DataFrame:
    f = fields(spark, sf)
    names = f.select(F.col("entity").alias("name")).union(f.select(F.concat_ws("_", "entity", "field"))).union(f.select(F.concat_ws("_", "entity", "field", F.lit("row"))))
    return cat.longest_prefix_parent(names, "name")


_TRI = "list_distinct(list_transform(range(length({0}) - 2), lambda i: substr({0}, i::INT + 1, 3)))"
_A, _B = _TRI.format("p_name"), _TRI.format("'small ring'")


@query("trigram_similarity", f"SELECT p_partkey, CASE WHEN length(p_name) < 3 THEN 0.0 ELSE len(list_intersect({_A}, {_B})) / len(list_distinct(list_concat({_A}, {_B}))) END AS similarity FROM part")
def trigrams(spark: SparkSession, sf: str) -> DataFrame:
    return entity(spark, sf, "part").select("p_partkey", trigram_similarity(F.col("p_name"), F.lit("small ring")).alias("similarity"))


@query("fuzzy_search", "SELECT field AS name, 30 + 8.0 / length(field) AS score FROM " + _FIELDS + " WHERE contains(field, 'priority')")
def fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    """Names that hold the word within one of theirs."""
    return cat.find(fields(spark, sf), "field", "priority").select("name", "score")


@query("fuzzy_search_exact", "SELECT 'l_orderkey' AS name, 100.0 AS score UNION ALL SELECT name, 51.0 FROM (SELECT field AS name FROM " + _FIELDS + " WHERE field <> 'l_orderkey' AND (starts_with(field, 'l_') OR ends_with(field, '_orderkey')))")
def fuzzy_search_exact(spark: SparkSession, sf: str) -> DataFrame:
    return cat.find(fields(spark, sf), "field", "l_orderkey", 12).select("name", "score")


@query("name_words", "SELECT p_partkey, 'http ' || p_name || ' ' || p_partkey || ' счет' AS words FROM part")
def name_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of names in camel case with an abbreviation before them and an underscore inside."""
    name = F.concat(F.lit("HTTP"), F.replace(F.initcap("p_name"), F.lit(" ")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("Счёт"))
    return entity(spark, sf, "part").select("p_partkey", F.array_join(words_of_name(name), " ").alias("words"))


def entities(spark: SparkSession, sf: str) -> dict:
    return {t: entity(spark, sf, t) for t in TABLES}


#: Pairs of fields whose names end alike, whether one refers to the other or not.
_ALIKE = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey")]
_ALIKE += [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]
_ALIKE += [("nation", "n_name", "region", "r_name"), ("region", "r_name", "nation", "n_name"), ("customer", "c_name", "supplier", "s_name"), ("supplier", "s_name", "customer", "c_name"), ("part", "p_name", "nation", "n_name"), ("nation", "n_name", "customer", "c_name")]
_ALIKE += [(k, kf, e, f) for e, f, k, kf in _ALIKE if f.endswith("key")]
_REFERS = " UNION ALL ".join(f"SELECT '{e}' AS entity, '{f}' AS field, '{k}' AS target, '{kf}' AS key WHERE (SELECT count(*) FROM {e} WHERE {f} NOT IN (SELECT {kf} FROM {k})) = 0 AND (SELECT count({kf}) = count(*) AND count(DISTINCT {kf}) = count(*) FROM {k})" for e, f, k, kf in _ALIKE)


@query("relation_catalog", _REFERS)
def relation_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """References between the entities, found in their data; names that are alike and values that lie in the range of a key are not enough."""
    return rel.relation_rows(spark, rel.find_relations(entities(spark, sf)))


_KEYS = " UNION ALL ".join(f"SELECT '{e}' AS entity, '{f}' AS field, count(*) AS n_rows, count(*) > 0 AND count({f}) = count(*) AND count(DISTINCT {f}) = count(*) AS \"unique\" FROM {e}" for e, f in (("region", "r_regionkey"), ("region", "r_name"), ("nation", "n_nationkey"), ("nation", "n_name"), ("nation", "n_regionkey"), ("customer", "c_custkey"), ("customer", "c_name"), ("customer", "c_nationkey"), ("customer", "c_mktsegment"), ("orders", "o_orderkey"), ("orders", "o_custkey"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority")))


@query("unique_keys", _KEYS)
def unique_keys(spark: SparkSession, sf: str) -> DataFrame:
    found = rel.unique_keys({t: entity(spark, sf, t) for t in ("region", "nation", "customer", "orders")})
    return found.select("entity", "field", "n_rows", "unique")


@query(
    "reference_texts",
    """SELECT o_orderkey, o_custkey, c_name AS o_custkey_text, CASE WHEN c_custkey IS NOT NULL THEN 'customer' END AS o_custkey_type, l_partkey, p_name AS l_partkey_text, CASE WHEN p_partkey IS NOT NULL THEN 'part' END AS l_partkey_type
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""",
)
def reference_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and types of references by the relations that the data have, without a hidden entity's: suppliers are hidden, so lines have no reference to one."""
    every = {t: entity(spark, sf, t) for t in ("customer", "part", "orders", "lineitem", "supplier")}
    found = rel.find_relations(every)
    lines = rel.with_references(every["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey"), "lineitem", {k: v for k, v in every.items() if k != "orders"}, [r for r in found if r.target != "orders"], frozenset({"supplier"}), {"part": "p_name"})
    orders = rel.with_references(every["orders"].select("o_orderkey", "o_custkey"), "orders", every, found, texts={"customer": "c_name"})
    return lines.distinct().join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")


#: Names of parts made of their keys, in forms of the same words, with how many of the words asked for they share.
_FORMS = (("OrderedLines", 2), ("ShippingOrders", 1), ("Заказы", 1), ("Поставщика", 0), ("Lining", 1))


@query("stem_words", "SELECT p_partkey, (['order line', 'ship order', 'заказ', 'поставщик', 'line'])[p_partkey % 5 + 1] || ' ' || p_partkey AS stems FROM part")
def stem_words(spark: SparkSession, sf: str) -> DataFrame:
    """Stems of the words of names, English and Russian."""
    form = F.get(F.array(*(F.lit(f) for f, _ in _FORMS)), (F.col("p_partkey") % len(_FORMS)).cast("int"))
    return spread(entity(spark, sf, "part")).select("p_partkey", F.array_join(stems.stems(F.concat_ws("_", form, F.col("p_partkey").cast("string"))), " ").alias("stems"))


@query(
    "search_by_stems",
    """SELECT name, CASE WHEN n > 0 THEN 50.0 + n END::DOUBLE AS score FROM (SELECT (['OrderedLines', 'ShippingOrders', 'Заказы', 'Поставщика', 'Lining'])[p_partkey % 5 + 1] || '_' || p_partkey AS name, ([2, 1, 1, 0, 1])[p_partkey % 5 + 1] AS n FROM part)
    WHERE n > 0 ORDER BY score DESC, name LIMIT 100""",
)
def search_by_stems(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred names that share most words with a query, whatever the words' forms."""
    form = F.get(F.array(*(F.lit(f) for f, _ in _FORMS)), (F.col("p_partkey") % len(_FORMS)).cast("int"))
    names = spread(entity(spark, sf, "part")).select(F.concat_ws("_", form, F.col("p_partkey").cast("string")).alias("name"))
    return cat.find(names, "name", "orders lines заказами", 100, by=stems.stems)
