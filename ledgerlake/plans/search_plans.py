"""Queries of text search and nested masking: name variants, overlaps, word boundaries, folding, structs and arrays, trees of conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import text as tx
from ledgerlake.functions import tokens as t
from ledgerlake.operators import governed as g
from ledgerlake.operators import masking as m
from ledgerlake.operators.recipes import Bound, Param, Recipe
from ledgerlake.plans.gate_plans import SECRET, token_sql
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import entity, json_body, spread

#: Names made of suppliers' keys: two words with a legal form, one word with one, one word alone, a number, in turn.
_LETTERS = "translate(s_suppkey::VARCHAR, '0123456789', 'абвгдежзик')"
_CORE = f"CASE s_suppkey % 4 WHEN 0 THEN 'склад ' || {_LETTERS} WHEN 1 THEN 'мост' || {_LETTERS} WHEN 2 THEN 'река' || {_LETTERS} ELSE (1000 + s_suppkey)::VARCHAR END"
_FULL = f"CASE s_suppkey % 4 WHEN 0 THEN 'ооо \"' || c || '\"' WHEN 1 THEN 'ао ' || c WHEN 2 THEN c ELSE 'ип \"' || c || '\"' END"


def named(spark: SparkSession, sf: str) -> DataFrame:
    """(s_suppkey, core, spelling): what _CORE and _FULL say, in upper and lower case."""
    key = F.col("s_suppkey")
    letters = F.translate(key.cast("string"), "0123456789", "абвгдежзик")
    core = F.when(key % 4 == 0, F.concat(F.lit("Склад "), letters)).when(key % 4 == 1, F.concat(F.lit("Мост"), letters)).when(key % 4 == 2, F.concat(F.lit("Река"), letters)).otherwise((key + 1000).cast("string"))
    rows = entity(spark, sf, "supplier").select("s_suppkey", core.alias("core"))
    core = F.col("core")
    full = F.when(key % 4 == 0, F.concat(F.lit("ООО «"), core, F.lit("»"))).when(key % 4 == 1, F.concat(F.lit("АО "), core)).when(key % 4 == 2, core).otherwise(F.concat(F.lit("ИП «"), core, F.lit("»")))
    return rows.withColumn("spelling", full)


_QUOTED = "[('\"', '\"'), ('''', ''''), ('''', ''), ('‘', '’'), ('‘', ''), ('’', '’'), ('’', ''), ('', '\"'), ('\" ', '\"'), ('\"', '')]"
_WORD = f"list_transform({_QUOTED}, lambda q: q[1] || c || q[2])"
_FORMS = "['{f} ' || c, '{f} \"' || c || '\"', '{f}\"' || c || '\"']"


@query(
    "name_variants",
    f"""WITH n AS (SELECT s_suppkey, {_CORE} AS c FROM supplier)
    SELECT s_suppkey, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['ооо "' || c || '"', c]
      WHEN 1 THEN list_distinct(['ао ' || c] || {_WORD} || {_FORMS.format(f='ао')} || ['ао.' || c, 'ао-' || c] || {_FORMS.format(f='ao')} || ['акционерное общество ' || c, 'акционерное общество "' || c || '"'])
      WHEN 2 THEN {_WORD} ELSE list_distinct(['"' || c || '"'] || {_FORMS.format(f='ип')}) END) AS variant FROM n""",
)
def name_variants(spark: SparkSession, sf: str) -> DataFrame:
    """By what a name is searched for: a bare word or number only as it is written when meant as a name."""
    return named(spark, sf).select("s_suppkey", F.explode(tx.name_variants(F.col("spelling"))).alias("variant"))


#: Notes of orders about a supplier, in six manners; {c} is its name's core. What of them is a find depends on the kind of name.
_NOTES = ("оплата {c} сегодня", "оплата «{c}» сегодня", "для ооо  «{c}».", "для АО {c}, склад", "{c}овский и не{c}", "«{c}")


@query(
    "mask_name_variants",
    f"""WITH n AS (SELECT s_suppkey, c, {_FULL} AS f FROM (SELECT s_suppkey, {_CORE} AS c FROM supplier)),
    o AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderkey % (SELECT count(*) FROM supplier) AS s FROM orders),
    x AS (SELECT o_orderkey, k, s % 4 AS kind, CASE WHEN s % 4 = 3 THEN c ELSE upper(left(c, 1)) || substr(c, 2) END AS c, {token_sql('org', 'f')} AS t FROM o JOIN n ON s = s_suppkey)
    SELECT o_orderkey, CASE k
      WHEN 0 THEN 'оплата ' || CASE WHEN kind = 0 THEN t ELSE c END || ' сегодня'
      WHEN 1 THEN 'оплата ' || CASE WHEN kind = 0 THEN '«' || t || '»' ELSE t END || ' сегодня'
      WHEN 2 THEN CASE WHEN kind = 0 THEN 'для ' || t WHEN kind = 3 THEN 'для ооо  ' || t ELSE 'для ооо  ' || t END || '.'
      WHEN 3 THEN 'для ' || CASE WHEN kind = 0 THEN 'АО ' || t WHEN kind = 1 THEN t ELSE 'АО ' || c END || ', склад'
      WHEN 4 THEN c || 'овский и не' || CASE WHEN kind = 3 THEN c ELSE c END
      ELSE CASE WHEN kind = 0 THEN '«' || t WHEN kind = 3 THEN '«' || c ELSE t END END AS note FROM x""",
)
def mask_name_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Names in notes by their variants, whatever the case, quotes and white space; a bare word stays open."""
    names = named(spark, sf)
    n = names.count()
    orders = entity(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % n).alias("s"))
    met = orders.join(names, F.col("s") == F.col("s_suppkey"))
    note = F.lit(None).cast("string")
    for k, pattern in enumerate(_NOTES):
        note = F.when(F.col("o_orderkey") % len(_NOTES) == k, F.replace(F.lit(pattern), F.lit("{c}"), F.col("core"))).otherwise(note)
    notes = met.select("o_orderkey", note.alias("note"))
    return m.replace_names(notes, "o_orderkey", "note", names.select("spelling", t.token("org", F.col("spelling"), SECRET).alias("token")))


@query(
    "names_between_look_alikes",
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'от [[org:N]], ' WHEN 1 THEN 'от [[org:N]]z ' WHEN 2 THEN 'от альфа бетаx ' WHEN 3 THEN 'от [[org:N]] ' WHEN 4 THEN 'x%2F[[org:N]] ' WHEN 5 THEN 'от [[org:N]]2 '
    WHEN 6 THEN 'от альфа бета́ ' ELSE 'от альфа бета­вый ' END || doc_id AS text FROM documents""",
)
def names_between_look_alikes(spark: SparkSession, sf: str) -> DataFrame:
    """Word boundaries by script: a Latin letter parts from Cyrillic ones unless it looks like one of them; digits and hidden blanks part, accents and soft
    hyphens don't; escapes are read."""
    shapes = ("от Альфа  Бета, ", "от Альфа Бетаz ", "от альфа бетаx ", "от Альфа​ Бе‍та ", "x%2FАльфа%20Бета ", "от Альфа Бета2 ", "от альфа бета́ ", "от альфа бета­вый ")
    shape = F.get(F.array(*map(F.lit, shapes)), (F.col("doc_id") % len(shapes)).cast("int"))
    texts = entity(spark, sf, "documents").select("doc_id", F.concat(shape, F.col("doc_id").cast("string")).alias("text"))
    return m.replace_names(texts, "doc_id", "text", spark.createDataFrame([("Альфа Бета", "[[org:N]]")], "spelling string, token string"))


@query(
    "overlapping_finds",
    """WITH h AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 97 AS a, l_partkey % 97 + l_quantity::INT AS z, 't' || l_suppkey AS x FROM lineitem),
    m AS (SELECT *, max(z) OVER (PARTITION BY k ORDER BY a, z DESC, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
    c AS (SELECT *, sum(CASE WHEN a < reach THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY a, z DESC, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM m),
    p AS (SELECT *, lag(x) OVER (PARTITION BY k, c ORDER BY a, z DESC, x) AS before FROM c WHERE reach IS NULL OR z > reach OR a >= reach)
    SELECT k AS l_orderkey, min(a) AS start, max(z) AS stop, string_agg(CASE WHEN x = before THEN '' ELSE x END, '' ORDER BY a, z DESC, x) AS tokens FROM p GROUP BY k, c""",
)
def overlapping_finds(spark: SparkSession, sf: str) -> DataFrame:
    """Finds that overlap as one group: the token of the one that covers it, else those of all that lie in no other."""
    hits = entity(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 97).alias("start"), (F.col("l_partkey") % 97 + F.col("l_quantity").cast("int")).alias("stop"), F.concat(F.lit("t"), "l_suppkey").alias("token"))
    return m.group_spans(hits.distinct(), "l_orderkey")


_RUNS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query(
    "find_phrases_of_documents",
    f"""WITH w AS (SELECT doc_id, {_RUNS} AS w FROM documents), p AS (SELECT DISTINCT array_to_string(w[1:6], ' ') AS phrase FROM w WHERE len(w) >= 6),
    r AS (SELECT doc_id, unnest(list_transform(range(greatest(len(w) - 5, 0)), lambda i: array_to_string(w[i + 1:i + 6], ' '))) AS run FROM w)
    SELECT doc_id, phrase, count(*) AS hits FROM r JOIN p ON run = phrase GROUP BY doc_id, phrase""",
)
def find_phrases_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents have the first six words of a document: as many phrases as there are openings."""
    docs = entity(spark, sf, "documents")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    phrases = docs.select(words.alias("w")).where(F.size("w") >= 6).select(F.array_join(F.slice("w", 1, 6), " ").alias("phrase")).distinct()
    return m.find_phrases(docs, "doc_id", "text", phrases)


# -- nested columns

_CUSTOMER, _SUPPLIER = token_sql("org", "lower(c_name)"), token_sql("org", "'supplier#' || lpad(l_suppkey::VARCHAR, 9, '0')")


@query(
    "mask_nested_rows",
    f"""WITH l AS (SELECT l_orderkey, string_agg('{{"line":' || l_linenumber || ',"supplier":{{"presentation":"' || {_SUPPLIER} || '","memo":"' || {_SUPPLIER} || ' sends"}}}}', ',' ORDER BY l_linenumber, l_suppkey) AS lines
      FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)) GROUP BY l_orderkey)
    SELECT o_orderkey, '{{"description":"' || {_CUSTOMER} || '","memo":"bill of ' || {_CUSTOMER} || '"}}' AS customer, '[' || coalesce(lines, '') || ']' AS lines
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def mask_nested_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer as a struct and their lines as an array of structs with structs: what names a customer or supplier in them is closed by the class
    that its container hands down, and so is its name in the free text beside."""
    supplier = F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    known = entity(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    lines = entity(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct().join(known, "l_suppkey", "left_semi")
    line = F.struct(F.col("l_linenumber").alias("line"), F.struct(supplier.alias("presentation"), F.concat(supplier, F.lit(" sends")).alias("memo")).alias("supplier"))
    lines = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", line.alias("x")))), lambda r: r["x"]).alias("lines"))
    orders = entity(spark, sf, "orders").join(entity(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select("o_orderkey", F.struct(F.col("c_name").alias("description"), F.concat(F.lit("bill of "), "c_name").alias("memo")).alias("customer"))
    rows = rows.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    out = g.mask_rows(rows, g.Policy(SECRET))
    return out.select("o_orderkey", F.to_json("customer").alias("customer"), F.coalesce(F.to_json("lines"), F.lit("[]")).alias("lines"))


_PHONE, _MAIL = token_sql("phone", "'7495' || lpad(user_id::VARCHAR, 7, '0')"), token_sql("email", "'user' || user_id || '@example.com'")


@query(
    "mask_nested_events",
    f"""SELECT event_id, '{{"kind":"' || event_type || '","user":{{"contacts":[{{"type":"phone","presentation":"' || {_PHONE} || '"}},{{"presentation":"' || {_MAIL} || '"}}],"marks":{{"mail":"' || {_MAIL} || '","memo":"of ' || user_id || '"}}}}}}' AS body FROM events""",
)
def mask_nested_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON three levels deep: contacts by their type, or by what they look like where it is missing, and values of a map by their keys."""
    user = F.col("user_id").cast("string")
    phone = F.concat(F.lit("+7 (495) "), F.substring(F.lpad(user, 7, "0"), 1, 3), F.lit("-"), F.substring(F.lpad(user, 7, "0"), 4, 2), F.lit("-"), F.substring(F.lpad(user, 7, "0"), 6, 2))
    mail = F.concat(F.lit("User"), user, F.lit("@Example.com"))
    contacts = F.array(F.struct(F.lit("phone").alias("type"), phone.alias("presentation")), F.struct(F.lit(None).cast("string").alias("type"), mail.alias("presentation")))
    marks = F.create_map(F.lit("mail"), mail, F.lit("memo"), F.concat(F.lit("of "), user))
    written = spread(entity(spark, sf, "events")).select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(contacts.alias("contacts"), marks.alias("marks")).alias("user"))).alias("body"))
    body = F.from_json("body", "struct<kind:string,user:struct<contacts:array<struct<type:string,presentation:string>>,marks:map<string,string>>>")
    rows = written.select("event_id", body.alias("body"))
    return m.mask_fields(rows, SECRET).select("event_id", F.to_json("body").alias("body"))


@query("strip_nested_service_fields", "SELECT o_orderkey, '{\"o_totalprice\":\"' || round(o_totalprice)::BIGINT || '\",\"lines\":[{\"k\":' || o_custkey || '}]}' AS body FROM orders")
def strip_nested_service_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that a protocol adds go at any depth."""
    inner = F.array(F.struct(F.col("o_custkey").alias("k"), F.lit("x").alias("odata.type"), F.lit("AA=").alias("DataVersion")))
    rows = entity(spark, sf, "orders").select("o_orderkey", F.struct(F.lit("t").alias("odata.metadata"), F.round("o_totalprice").cast("bigint").cast("string").alias("o_totalprice"), inner.alias("lines")).alias("body"))
    return g.without_service_columns(rows).select("o_orderkey", F.to_json("body").alias("body"))


# -- governed queries over all text columns


def _book(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary of the customers in which every third has a number for a token and every fifth a long one."""
    names = entity(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("spelling"))
    own, long = t.token("org", F.col("spelling"), SECRET), t.token("org", F.col("spelling"), SECRET, m.LONG_TAIL)
    token = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("[[org:"), (F.col("c_custkey") + 1).cast("string"), F.lit("]]"))).when(F.col("c_custkey") % 5 == 0, long).otherwise(own)
    return names.select(F.lit("org").alias("kind"), token.alias("token"), "spelling")


def shown_sql(name: str, key: str) -> str:
    long = token_sql("org", f"lower({name})", 16)
    return f"CASE WHEN {key} % 3 = 0 THEN '[[org:' || ({key} + 1) || ']]' WHEN {key} % 5 = 0 THEN {long} ELSE {token_sql('org', f'lower({name})')} END"


@query(
    "governed_customers",
    f"SELECT c_custkey, {shown_sql('c_name', 'c_custkey')} AS c_name, c_nationkey, c_acctbal, c_mktsegment, 0 AS guard_replaced FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1000",
)
def governed_customers(spark: SparkSession, sf: str) -> DataFrame:
    """All columns, by a tree of conditions, with the tokens that the dictionary has."""
    where = g.Any(g.Condition("c_acctbal", "gt", 0), g.Not(g.Condition("c_mktsegment", "ne", "BUILDING")))
    return g.governed_query(spark, sf, "customer", g.Policy(SECRET, dictionary=_book(spark, sf)), None, [where], ["c_custkey"], 1000)[0]


@query(
    "governed_orders",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'billed to ' || {shown_sql('c_name', 'c_custkey')} || ' by hand' AS memo, o_orderstatus || ' of ' || {shown_sql('c_name', 'c_custkey')} AS remark, 0 AS guard_replaced
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 1000""",
)
def governed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Four columns of free text, in two of them names that only the dictionary knows."""
    rows = entity(spark, sf, "orders").join(entity(spark, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumn("memo", F.concat(F.lit("billed to "), "c_name", F.lit(" by hand"))).withColumn("remark", F.concat("o_orderstatus", F.lit(" of "), "c_name")).drop("c_custkey", "c_name")
    return g.governed_query(spark, sf, "orders", g.Policy(SECRET, dictionary=_book(spark, sf)), None, [g.Condition("o_totalprice", "gt", 1000)], ["o_orderkey"], 1000, rows=rows)[0]


@query("mask_by_dictionary", f"SELECT c_custkey, {shown_sql('c_name', 'c_custkey')} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def mask_by_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a class by the tokens that the dictionary has, else by their digest."""
    return m.mask_fields(spread(entity(spark, sf, "customer")), SECRET, dictionary=_book(spark, sf))


@query(
    "open_addresses",
    f"SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'street ' || s_suppkey ELSE 'street ' || s_suppkey END AS address, {token_sql('addr', chr(39) + 'street ' + chr(39) + ' || s_suppkey')} AS delivery_address FROM supplier",
)
def open_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """A policy that closes the addresses of persons alone leaves a supplier's open, but for where goods go."""
    street = F.concat(F.lit("street "), F.col("s_suppkey").cast("string"))
    rows = entity(spark, sf, "supplier").select("s_suppkey", street.alias("address"), street.alias("delivery_address"))
    policy = g.Policy(SECRET, addr_for=frozenset({"person"}))
    return m.mask_fields(rows, SECRET, policy.rules(rows, "supplier"))


@query("strict_fields", f"SELECT p_partkey, {token_sql('org', 'p_name')} AS description, p_name AS remark FROM part")
def strict_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Of a table that nothing is known of, fields that name what they are in are closed."""
    rows = spread(entity(spark, sf, "part")).select("p_partkey", F.col("p_name").alias("description"), F.col("p_name").alias("remark"))
    return m.mask_fields(rows, SECRET, g.Policy(SECRET, strict=True).rules(rows, "part"))


def of_customer(spark: SparkSession, sf: str) -> Recipe:
    """Orders of a customer, who is named by a token, over a price."""
    conditions = (("customer", Bound("customer", "c_name")), ("least", Bound("orders", "o_totalprice", "ge")))

    def build(tables: dict, values: dict, condition) -> DataFrame:  # noqa: ANN001
        rows = tables["orders"].join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
        rows = rows if condition is None else rows.where(condition)
        return rows.select("o_orderkey", "c_name", F.concat(F.lit("for "), "c_name").alias("memo"))

    return Recipe("orders_of_customer", (Param("customer", "string", True), Param("least", "decimal")), build, conditions, ("orders", "customer"))


@query(
    "governed_recipe",
    f"""SELECT o_orderkey, {token_sql('org', 'lower(c_name)')} AS c_name, 'for ' || {token_sql('org', 'lower(c_name)')} AS memo, 0 AS guard_replaced FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_custkey = (SELECT min(o_custkey) FROM orders) AND o_totalprice >= 1000""",
)
def governed_recipe(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe asked for by a token: its values are probed by the rules for their fields, its rows masked."""
    tables = {n: entity(spark, sf, n) for n in ("orders", "customer")}
    first = tables["orders"].agg(F.min("o_custkey").alias("c_custkey"))
    token = tables["customer"].join(first, "c_custkey").select(t.token("org", F.col("c_name"), SECRET)).first()[0]
    policy = g.Policy(SECRET, dictionary=m.issue(tables["customer"], "org", "c_name", SECRET))
    return of_customer(spark, sf).governed(tables, policy, customer=token, least=1000)


@query(
    "raw_scan",
    f"""SELECT c_custkey, '{{"title":"' || {token_sql('org', 'lower(c_name)')} || '","tail":{{"memo":"call ' || {token_sql('org', 'lower(c_name)')} || '","n":' || c_nationkey || '}}}}' AS item, 0 AS guard_replaced FROM customer""",
)
def raw_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of JSON of a path that is in no catalog: parsed, stripped and closed the strict way."""
    item = F.struct(F.col("c_name").alias("title"), F.struct(F.concat(F.lit("call "), "c_name").alias("memo"), F.col("c_nationkey").alias("n")).alias("tail"), F.lit("x").alias("odata.type"))
    bodies = spread(entity(spark, sf, "customer")).select("c_custkey", F.to_json(F.struct(F.array(item).alias("value"))).alias("body"))
    rows = json_body(bodies, "body", "title:string,tail:struct<memo:string,n:int>,`odata.type`:string").select("c_custkey", "item")
    return g.raw_rows(rows, g.Policy(SECRET)).select("c_custkey", F.to_json("item").alias("item"), "guard_replaced")
