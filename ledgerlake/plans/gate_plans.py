"""Queries of the governance layer: check digits, normal forms, tokens, detection, masking, dictionaries, guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import checksums as c
from ledgerlake.functions import text as tx
from ledgerlake.functions import tokens as t
from ledgerlake.operators import detection as d
from ledgerlake.operators import governed as g
from ledgerlake.operators import known as k
from ledgerlake.operators import masking as m
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import entity, spread

SECRET = b"0123456789abcdef0123456789abcdef"
INNER, OUTER = t.pads(SECRET)


def token_sql(kind: str, normal: str, signs: int = 10) -> str:
    """The token of a normal form in SQL, with a tail of 10 or 16 signs."""
    digest = f"sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode('{kind}') || unhex('00') || encode({normal}))))"
    part = lambda bits, n: f"array_to_string(list_transform(range({n}), lambda i: substr('{t.ALPHABET}', ((('0x' || {bits})::UBIGINT >> ({5 * (n - 1)} - 5 * i)::UBIGINT) & 31)::INT + 1, 1)), '')"
    tail = part(f"right({digest}, 13)", 10) if signs == 10 else part(f"substr({digest}, 45, 10)", 8) + " || " + part(f"right({digest}, 10)", 8)
    return f"('[[{kind}:' || {tail} || ']]')"


def values(rows: list[str], column: str = "x") -> str:
    return f"(VALUES {', '.join(f'({chr(39)}{r}{chr(39)})' for r in rows)}) AS v({column})"


def given(spark: SparkSession, rows: list[str], column: str = "x") -> DataFrame:
    return spark.createDataFrame([(r,) for r in rows], f"{column} string")


def digits_sql(x: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"substr({x}, {k + 1}, 1)::INT * {w}" for k, w in enumerate(weights)) + ")"


NINE = "lpad(c_custkey::VARCHAR, 9, '0')"


@query("inn_control", f"SELECT c_custkey, {NINE} || ({digits_sql(NINE, c.INN_10)} % 11 % 10) AS inn, true AS valid, {digits_sql(NINE, c.INN_10)} % 11 % 10 = 0 AS zero_valid FROM customer")
def inn_control(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers derived from keys: with the control digit they are valid, with a zero only if that is the digit."""
    nine = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    rows = entity(spark, sf, "customer").withColumn("nine", nine).withColumn("inn", F.concat("nine", c.inn_control(F.col("nine")).cast("string")))
    return rows.select("c_custkey", "inn", c.inn_valid(F.col("inn")).alias("valid"), c.inn_valid(F.concat("nine", F.lit("0"))).alias("zero_valid"))


#: Of each test the shapes of a number, of which each row of customers has one in turn, made of its key: right, wrong and misshapen ones.
#: A shape is (SQL, column, whether it is right); `n` is the key with nine digits.
_N = "lpad(c_custkey::VARCHAR, 9, '0')"


def _shapes(name: str, test, shapes: list) -> None:  # noqa: ANN001
    cases = " ".join(f"WHEN {k} THEN {x}" for k, (x, _, _) in enumerate(shapes))
    right = " ".join(f"WHEN {k} THEN {ok}" for k, (_, _, ok) in enumerate(shapes))

    @query(name, f"SELECT c_custkey, x, CASE c_custkey % {len(shapes)} {right} END AS valid FROM (SELECT c_custkey, CASE c_custkey % {len(shapes)} {cases} END AS x FROM (SELECT c_custkey, {_N} AS n FROM customer))")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        n, x = F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(None).cast("string")
        for k, (_, make, _) in enumerate(shapes):
            x = F.when(F.col("c_custkey") % len(shapes) == k, make(n)).otherwise(x)
        return entity(spark, sf, "customer").select("c_custkey", x.alias("x")).withColumn("valid", test(F.col("x")))


def _digit(x: Column, add: int = 0) -> Column:
    return ((x + add) % 10).cast("string")


_INN = digits_sql("n", c.INN_10) + " % 11 % 10"
_inn = c.inn_control
_OGRN = "('110' || n)::BIGINT % 11 % 10"
_ogrn = lambda n: F.concat(F.lit("110"), n).cast("bigint") % 11 % 10
_SUM = digits_sql("n", c.SNILS)
_SNILS = f"CASE WHEN {_SUM} < 100 THEN {_SUM} ELSE {_SUM} % 101 % 100 END"
_snils = lambda n: F.when(c.weighted(n, c.SNILS) < 100, c.weighted(n, c.SNILS)).otherwise(c.weighted(n, c.SNILS) % 101 % 100)
_two = lambda x: F.lpad(x.cast("string"), 2, "0")
_LUHN = "(10 - list_sum(list_transform(range(15), lambda i: CASE WHEN i % 2 = 0 THEN substr(x15, 15 - i::INT, 1)::INT * 2 - CASE WHEN substr(x15, 15 - i::INT, 1)::INT > 4 THEN 9 ELSE 0 END ELSE substr(x15, 15 - i::INT, 1)::INT END)) % 10) % 10"
_LUHN = _LUHN.replace("x15", "('411111' || n)")


def _luhn(n: Column) -> Column:
    """The last digit of a card number that begins with 411111 and the key."""
    total = F.lit(0)
    for k in range(15):
        d = c.digit(F.concat(F.lit("411111"), n), 14 - k)
        total = total + (F.when(d > 4, d * 2 - 9).otherwise(d * 2) if k % 2 == 0 else d)
    return (10 - total % 10) % 10


_IBAN = "98 - ('321428290000000' || n || '161100')::HUGEINT % 97"
_iban = lambda n: 98 - (F.concat(F.lit("321428290000000"), n, F.lit("161100")).cast("decimal(38,0)") % 97).cast("int")
CHECKS = {
    "inn_valid": (c.inn_valid, [(f"n || ({_INN})", lambda n: F.concat(n, _digit(_inn(n))), True), (f"n || (({_INN} + 1) % 10)", lambda n: F.concat(n, _digit(_inn(n), 1)), False), ("n", lambda n: n, False), (f"n || ({_INN}) || 'x'", lambda n: F.concat(n, _digit(_inn(n)), F.lit("x")), False)]),
    "ogrn_valid": (c.ogrn_valid, [(f"'110' || n || ({_OGRN})", lambda n: F.concat(F.lit("110"), n, _digit(_ogrn(n))), True), (f"'110' || n || (({_OGRN} + 1) % 10)", lambda n: F.concat(F.lit("110"), n, _digit(_ogrn(n), 1)), False), ("n || ''", lambda n: n, False)]),
    "snils_valid": (c.snils_valid, [(f"n || lpad(({_SNILS})::VARCHAR, 2, '0')", lambda n: F.concat(n, _two(_snils(n))), True), (f"n || lpad((({_SNILS} + 1) % 100)::VARCHAR, 2, '0')", lambda n: F.concat(n, _two((_snils(n) + 1) % 100)), False), ("n || '0'", lambda n: F.concat(n, F.lit("0")), False)]),
    "luhn_valid": (c.luhn_valid, [(f"'411111' || n || ({_LUHN})", lambda n: F.concat(F.lit("411111"), n, _digit(_luhn(n))), True), (f"'411111' || n || (({_LUHN} + 1) % 10)", lambda n: F.concat(F.lit("411111"), n, _digit(_luhn(n), 1)), False), ("n || '111'", lambda n: F.concat(n, F.lit("111")), False)]),
    "iban_valid": (c.iban_valid, [(f"'GB' || lpad(({_IBAN})::VARCHAR, 2, '0') || 'WEST0000000' || n", lambda n: F.concat(F.lit("GB"), _two(_iban(n)), F.lit("WEST0000000"), n), None), ("'gb82WEST0000000' || n", lambda n: F.concat(F.lit("gb82WEST0000000"), n), False)]),
    "account_known": (c.account_known, [("'40702810900' || n", lambda n: F.concat(F.lit("40702810900"), n), True), ("'40102810900' || n", lambda n: F.concat(F.lit("40102810900"), n), True), ("'99902810900' || n", lambda n: F.concat(F.lit("99902810900"), n), False), ("'4070281090' || n", lambda n: F.concat(F.lit("4070281090"), n), False)]),
    "card_network": (c.card_network_known, [("'4111111' || n", lambda n: F.concat(F.lit("4111111"), n), True), ("'5511111' || n", lambda n: F.concat(F.lit("5511111"), n), True), ("'2221000' || n", lambda n: F.concat(F.lit("2221000"), n), True), ("'9111111' || n", lambda n: F.concat(F.lit("9111111"), n), False), ("'2721000' || n", lambda n: F.concat(F.lit("2721000"), n), False)]),
}
CHECKS["iban_valid"][1][0] = (*CHECKS["iban_valid"][1][0][:2], True)
for _name, (_test, _cases) in CHECKS.items():
    _shapes(_name, _test, _cases)


@query("luhn_keys", "SELECT o_orderkey, list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 1 THEN substr(x, 16 - i::INT, 1)::INT * 2 - CASE WHEN substr(x, 16 - i::INT, 1)::INT > 4 THEN 9 ELSE 0 END ELSE substr(x, 16 - i::INT, 1)::INT END)) % 10 = 0 AS valid FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 16, '4') AS x FROM orders)")
def luhn_keys(spark: SparkSession, sf: str) -> DataFrame:
    return entity(spark, sf, "orders").select("o_orderkey", c.luhn_valid(F.lpad(F.col("o_orderkey").cast("string"), 16, "4")).alias("valid"))


#: Ways to write a value of each class around a key with ten digits, and what it is compared by. SQL, column, normal form in SQL.
_K = "lpad(o_orderkey::VARCHAR, 10, '0')"
NORMAL = {
    "inn": (" {k4} {k6} ", "{k4}{k6}"),
    "acc": ("40702810-90{k4}{k6}", "4070281090{k4}{k6}"),
    "phone": ("+7 ({k4}) {k6}", "7{k4}{k6}"),
    "email": ("  Ivan{k4}@Mail.RU ", "ivan{k4}@mail.ru"),
    "dob": ("1980-05-17T{k4}", "1980-05-17"),
    "doc": ("{k4} № {k6}", "{k4}{k6}"),
    "org": ("  ООО   «Ёлка {k6}» ", 'ооо "елка {k6}"'),
    "iban": ("de{k4} 3704 {k6}", "DE{k4}3704{k6}"),
    "addr": (" Дом  {k4}   кв {k6} ", "Дом {k4} кв {k6}"),
}


def _filled(pattern: str) -> str:
    return "'" + pattern.replace("{k4}", f"' || substr({_K}, 1, 4) || '").replace("{k6}", f"' || substr({_K}, 5, 6) || '") + "'"


@query("normalize_value", "SELECT o_orderkey, " + f"(['" + "', '".join(NORMAL) + f"'])[o_orderkey % {len(NORMAL)} + 1] AS kind, CASE o_orderkey % {len(NORMAL)} " + " ".join(f"WHEN {i} THEN {_filled(normal)}" for i, (_, normal) in enumerate(NORMAL.values())) + " END AS normalized FROM orders")
def normalize_value(spark: SparkSession, sf: str) -> DataFrame:
    key, n = F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.col("o_orderkey") % len(NORMAL)
    kind = out = F.lit(None).cast("string")
    for i, (name, (written, _)) in enumerate(NORMAL.items()):
        text = F.replace(F.replace(F.lit(written), F.lit("{k4}"), F.substring(key, 1, 4)), F.lit("{k6}"), F.substring(key, 5, 6))
        kind, out = F.when(n == i, name).otherwise(kind), F.when(n == i, t.normalize(name, text)).otherwise(out)
    return entity(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), out.alias("normalized"))


@query("make_token", f"SELECT c_custkey, {token_sql('org', 'lower(c_name)')} AS token FROM customer")
def make_token(spark: SparkSession, sf: str) -> DataFrame:
    return spread(entity(spark, sf, "customer")).select("c_custkey", t.token("org", F.col("c_name"), SECRET).alias("token"))


@query("token_known_value", "SELECT s_suppkey, '[[inn:GTDASDMS8Y]]' AS token FROM supplier")
def token_known_value(spark: SparkSession, sf: str) -> DataFrame:
    """One value written in a different way in each row has one token, which stays the same from release to release."""
    written = F.concat(F.lit("7707"), F.repeat(F.lit(" "), (F.col("s_suppkey") % 5).cast("int")), F.lit("083893"))
    return entity(spark, sf, "supplier").select("s_suppkey", t.token("inn", written, SECRET).alias("token"))


@query(
    "numbered_token",
    "SELECT lower(p_name) AS normalized, row_number() OVER (ORDER BY md5(lower(p_name)), lower(p_name)) AS number, '[[org:' || number || ']]' AS token FROM (SELECT DISTINCT p_name FROM part)",
)
def numbered_token(spark: SparkSession, sf: str) -> DataFrame:
    return m.numbered(entity(spark, sf, "part"), "p_name", "org")


@query(
    "numbered_token_second_issue",
    """WITH o AS (SELECT DISTINCT lower(p_name) AS v FROM part WHERE p_partkey % 3 = 0), n AS (SELECT DISTINCT lower(p_name) AS v FROM part WHERE lower(p_name) NOT IN (SELECT v FROM o)),
    a AS (SELECT v AS normalized, row_number() OVER (ORDER BY md5(v), v) AS number FROM o UNION ALL SELECT v, (SELECT count(*) FROM o) + row_number() OVER (ORDER BY md5(v), v) FROM n)
    SELECT normalized, number, '[[org:' || number || ']]' AS token FROM a""",
)
def numbered_token_second_issue(spark: SparkSession, sf: str) -> DataFrame:
    """All parts after a third of them had numbers: those keep them."""
    parts = entity(spark, sf, "part")
    return m.numbered(parts, "p_name", "org", m.numbered(parts.where("p_partkey % 3 = 0"), "p_name", "org"))


#: Texts around a key, in turn: the class of a whole token, whether one is damaged, and how many whole ones there are.
PARSED = (("[[inn:GT{k}]]", "inn", False, 1), ("see [[org:{k}]] and [[inn:AB]]", "", False, 2), ("[[inn:{k}", "", True, 0), ("{k}]] [[org:7]]", "", True, 1), ("plain {k}", "", False, 0))
_PIECES = " ".join(f"WHEN {i} THEN '" + x.replace("{k}", "' || p_partkey || '") + "'" for i, (x, *_) in enumerate(PARSED))


@query("token_parse", f"SELECT p_partkey, CASE p_partkey % 5 {_PIECES} END AS x, (['inn', '', '', '', ''])[p_partkey % 5 + 1] AS kind, p_partkey % 5 IN (2, 3) AS damaged, ([1, 2, 0, 1, 0])[p_partkey % 5 + 1] AS n_tokens FROM part")
def token_parse(spark: SparkSession, sf: str) -> DataFrame:
    x = F.replace(F.get(F.array(*(F.lit(p[0]) for p in PARSED)), (F.col("p_partkey") % len(PARSED)).cast("int")), F.lit("{k}"), F.col("p_partkey").cast("string"))
    rows = entity(spark, sf, "part").select("p_partkey", x.alias("x"))
    return rows.select("p_partkey", "x", t.token_class(F.col("x")).alias("kind"), t.has_partial_token(F.col("x")).alias("damaged"), F.size(t.tokens_in(F.col("x"))).alias("n_tokens"))


#: Patterns for the SQL twins, which know no look-around: the shapes that the tables have.
SQL_PATTERNS = {
    "email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]*[A-Za-z0-9_]",
    "phone": r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{2,4}(?:-[0-9]{2})?",
}


def _detect(kind: str) -> None:
    @query(f"detect_{kind}", f"SELECT doc_id, unnest(regexp_extract_all(text, '{SQL_PATTERNS[kind]}')) AS value FROM documents")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return entity(spark, sf, "documents").select("doc_id", F.explode(d.found_in(F.col("text"), kind)).alias("value"))


for _kind in ("email", "phone"):
    _detect(_kind)

#: Texts around a customer's key, in turn: (SQL of the text before, of the value, of the text after, the same as columns, whether it is a find).
#: Right and wrong control digits, words near and far, separators, and other digits beside.
_FAR = "a note that goes on for long enough to stand between them "
FINDS = {
    "inn": [("'ИНН '", f"n || ({_INN})", "' от 2024-01-02'", lambda n: F.concat(n, _digit(_inn(n))), True), ("'ИНН '", f"n || (({_INN} + 1) % 10)", "''", lambda n: F.concat(n, _digit(_inn(n), 1)), False), ("'заказ '", f"n || ({_INN})", "''", lambda n: F.concat(n, _digit(_inn(n))), False), (f"'ИНН, {_FAR}'", f"n || ({_INN})", "''", lambda n: F.concat(n, _digit(_inn(n))), False)],
    "ogrn": [("'ОГРН '", f"'110' || n || ({_OGRN})", "';'", lambda n: F.concat(F.lit("110"), n, _digit(_ogrn(n))), True), ("'ОГРН '", f"'110' || n || (({_OGRN} + 1) % 10)", "''", lambda n: F.concat(F.lit("110"), n, _digit(_ogrn(n), 1)), False), ("'no'", f"'110' || n || ({_OGRN}) || '-1'", "''", lambda n: F.concat(F.lit("110"), n, _digit(_ogrn(n)), F.lit("-1")), False)],
    "snils": [("'СНИЛС '", f"substr(n, 1, 3) || '-' || substr(n, 4, 3) || '-' || substr(n, 7, 3) || ' ' || lpad(({_SNILS})::VARCHAR, 2, '0')", "'.'", lambda n: F.concat(F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 3), F.lit("-"), F.substring(n, 7, 3), F.lit(" "), _two(_snils(n))), True), ("'no '", f"n || lpad(({_SNILS})::VARCHAR, 2, '0')", "''", lambda n: F.concat(n, _two(_snils(n))), True), ("'no '", f"n || lpad((({_SNILS} + 1) % 100)::VARCHAR, 2, '0')", "''", lambda n: F.concat(n, _two((_snils(n) + 1) % 100)), False)],
    "iban": [("'IBAN '", f"'GB' || lpad(({_IBAN})::VARCHAR, 2, '0') || 'WEST0000000' || n", "''", lambda n: F.concat(F.lit("GB"), _two(_iban(n)), F.lit("WEST0000000"), n), True), ("'IBAN '", f"'GB' || lpad(({_IBAN} + 1)::VARCHAR, 2, '0') || 'WEST0000000' || n", "''", lambda n: F.concat(F.lit("GB"), _two(_iban(n) + 1), F.lit("WEST0000000"), n), False)],
    "acc": [("'р/с '", "'40702810900' || n", "' в банке'", lambda n: F.concat(F.lit("40702810900"), n), True), ("'р/с '", "'99902810900' || n", "''", lambda n: F.concat(F.lit("99902810900"), n), False), ("'id-'", "'40702810900' || n", "''", lambda n: F.concat(F.lit("40702810900"), n), False)],
    "corr": [("'к/с '", "'30101810400' || n", "''", lambda n: F.concat(F.lit("30101810400"), n), True), ("'к/с '", "'30201810400' || n", "''", lambda n: F.concat(F.lit("30201810400"), n), False)],
    "doc": [("'паспорт '", "'45 08 ' || substr(n, 4, 6)", "' выдан'", lambda n: F.concat(F.lit("45 08 "), F.substring(n, 4, 6)), True), ("'серия '", "'4508' || substr(n, 4, 6)", "''", lambda n: F.concat(F.lit("4508"), F.substring(n, 4, 6)), True), ("'номер '", "'4508' || substr(n, 4, 6)", "''", lambda n: F.concat(F.lit("4508"), F.substring(n, 4, 6)), False)],
    "kpp": [("'КПП '", "n || ''", "' и ИНН'", lambda n: n, True), ("'код '", "n || ''", "''", lambda n: n, False)],
}


def _detect_one(kind: str) -> None:
    shapes = FINDS[kind]
    value = " ".join(f"WHEN {i} THEN {v}" for i, (_, v, _, _, _) in enumerate(shapes))
    sure = ", ".join(str(i) for i, (*_, ok) in enumerate(shapes) if ok)
    before = " ".join(f"WHEN {i} THEN {b}" for i, (b, *_) in enumerate(shapes))

    @query(
        f"detect_{kind}",
        f"SELECT c_custkey, CASE c_custkey % {len(shapes)} {value} END AS value, length(CASE c_custkey % {len(shapes)} {before} END)::INT AS start FROM (SELECT c_custkey, {_N} AS n FROM customer) WHERE c_custkey % {len(shapes)} IN ({sure})",
    )
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Identifiers of one class in texts that hold each customer's key as such a number, right and wrong ones in turn."""
        n, text = F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(None).cast("string")
        for i, (b, _, a, make, _) in enumerate(shapes):
            text = F.when(F.col("c_custkey") % len(shapes) == i, F.concat(F.lit(b[1:-1]), make(n), F.lit(a[1:-1]))).otherwise(text)
        return d.spans(entity(spark, sf, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text", (kind,)).select("c_custkey", "value", "start")


for _kind in FINDS:
    _detect_one(_kind)


@query("detect_card")
def detect_card(spark: SparkSession, sf: str) -> DataFrame:
    """Card numbers in all documents; the tests hold it against a scan."""
    return entity(spark, sf, "documents").select("doc_id", F.explode(d.found_in(F.col("text"), "card")).alias("value"))


@query(
    "detect_spans",
    f"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '{SQL_PATTERNS['email']}')) AS value, generate_subscripts(regexp_extract_all(text, '{SQL_PATTERNS['email']}'), 1) AS n, text FROM documents)
    SELECT doc_id, 'email' AS kind, value, (list_sum(list_transform(regexp_split_to_array(text, '{SQL_PATTERNS['email']}')[:n], lambda s: length(s))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{SQL_PATTERNS['email']}')[:n - 1], lambda s: length(s))), 0))::INT AS start FROM h""",
)
def detect_spans(spark: SparkSession, sf: str) -> DataFrame:
    return d.spans(entity(spark, sf, "documents"), "doc_id", "text", ["email"])


@query("detect_all_spans")
def detect_all_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of all classes without overlaps; the tests hold it against a brute-force scan."""
    return d.spans(entity(spark, sf, "documents"), "doc_id", "text", d.SCAN_ORDER)


def masked_sql(text: str, kind: str) -> str:
    p, normal = SQL_PATTERNS[kind], "lower(trim(h))" if kind == "email" else "regexp_replace(h, '[^0-9]', '', 'g')"
    between, hits = f"regexp_split_to_array({text}, '{p}')", f"regexp_extract_all({text}, '{p}')"
    return f"array_to_string(list_transform(range(len({between})), lambda k: {between}[k + 1] || coalesce(list_transform({hits}, lambda h: {token_sql(kind, normal)})[k + 1], '')), '')"


@query("mask_by_scan", f"SELECT doc_id, {masked_sql('text', 'email')} AS text FROM documents")
def mask_by_scan(spark: SparkSession, sf: str) -> DataFrame:
    return entity(spark, sf, "documents").select("doc_id", d.mask_text(F.col("text"), ["email"], SECRET).alias("text"))


@query("mask_by_class", f"SELECT s_suppkey, {token_sql('org', 'lower(s_name)')} AS s_name, s_nationkey, s_acctbal FROM supplier")
def mask_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return m.mask_fields(spread(entity(spark, sf, "supplier")), SECRET)


@query("masked_share", "SELECT * FROM (SELECT 'c_name' AS field, count(*) AS n_masked, count(*) AS n_rows FROM customer UNION ALL SELECT 'c_mktsegment', 0, count(*) FROM customer)")
def masked_share(spark: SparkSession, sf: str) -> DataFrame:
    return m.masked_share(m.mask_fields(spread(entity(spark, sf, "customer")), SECRET))


_PART_NAME = "p_name || ' ' || p_partkey // 3"


@query(
    "dictionary_issue",
    f"SELECT 'org' AS kind, lower(n) AS normalized, {token_sql('org', 'lower(n)')} AS token, n AS spelling FROM (SELECT DISTINCT {_PART_NAME} AS n FROM part WHERE p_partkey % 2 = 1) WHERE n NOT IN (SELECT {_PART_NAME} FROM part WHERE p_partkey % 2 = 0)",
)
def dictionary_issue(spark: SparkSession, sf: str) -> DataFrame:
    """What odd parts add to a dictionary of the even ones; their names are made different by a third of the key."""
    parts = entity(spark, sf, "part").withColumn("n", F.concat("p_name", F.lit(" "), F.expr("p_partkey div 3").cast("string")))
    known = m.issue(parts.where("p_partkey % 2 = 0"), "org", "n", SECRET)
    return m.issue(parts.where("p_partkey % 2 = 1"), "org", "n", SECRET, known)


@query(
    "variant_resolution",
    """WITH v AS (SELECT split_part(p_name, ' ', 1) AS variant, p_name AS token, p_partkey % 50 = 0 AS exact FROM part),
    g AS (SELECT variant, count(DISTINCT token) AS n, min(token) AS one, count(DISTINCT token) FILTER (exact) AS m, min(token) FILTER (exact) AS sure FROM v GROUP BY variant)
    SELECT variant, CASE WHEN n = 1 THEN one WHEN m = 1 THEN sure END AS token, n::INT AS n_claims FROM g""",
)
def variant_resolution(spark: SparkSession, sf: str) -> DataFrame:
    parts = entity(spark, sf, "part")
    return m.resolve_variants(parts.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("variant"), F.col("p_name").alias("token"), (F.col("p_partkey") % 50 == 0).alias("exact")))


@query("filter_by_token", "SELECT c_custkey, c_acctbal FROM customer WHERE c_name = 'Customer#000000007'")
def filter_by_token(spark: SparkSession, sf: str) -> DataFrame:
    customer = entity(spark, sf, "customer")
    dictionary = m.issue(customer, "org", "c_name", SECRET)
    token = given(spark, ["Customer#000000007"]).select(t.token("org", F.col("x"), SECRET)).first()[0]
    return m.filter_by_token(customer, "c_name", token, dictionary).select("c_custkey", "c_acctbal")


PHRASES = ["of the", "the", "de la", "Ciónado", "no such phrase", "the market of the state and the people"]
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query(
    "find_phrases",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), r AS (SELECT doc_id, unnest(flatten(list_transform([1, 2, 3, 8], lambda n: list_transform(range(greatest(len(w) - n + 1, 0)), lambda i: array_to_string(w[i + 1:i + n], ' '))))) AS run FROM w)
    SELECT doc_id, phrase, count(*) AS hits FROM r JOIN {values(PHRASES, 'phrase')} ON run = lower(phrase) GROUP BY doc_id, phrase""",
)
def find_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return m.find_phrases(entity(spark, sf, "documents"), "doc_id", "text", given(spark, PHRASES, "phrase"))


@query("mask_known_names", f"SELECT o_orderkey, regexp_replace(o_comment, '\\b(furiously|carefully)\\b', '[[org:X]]', 'g') AS o_comment FROM (SELECT o_orderkey, o_orderkey || ' furiously, carefully-' || o_orderstatus || ' furiouslyx' AS o_comment FROM orders)")
def mask_known_names(spark: SparkSession, sf: str) -> DataFrame:
    """Known names in a text by their tokens; a name inside a longer word stays."""
    notes = entity(spark, sf, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(" furiously, carefully-"), "o_orderstatus", F.lit(" furiouslyx")).alias("o_comment"))
    names = spark.createDataFrame([("furiously", "[[org:X]]"), ("Carefully", "[[org:X]]"), ("two tokens", "[[org:A]]"), ("two tokens", "[[org:B]]")], "spelling string, token string")
    return m.mask_known_names(notes, "o_orderkey", "o_comment", names)


@query(
    "overlap_groups",
    """WITH h AS (SELECT l_orderkey AS k, l_partkey % 97 AS a, l_partkey % 97 + l_quantity::INT AS z, 't' || l_suppkey AS x FROM lineitem),
    m AS (SELECT *, CASE WHEN a < max(z) OVER (PARTITION BY k ORDER BY a, z, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM h),
    c AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a, z, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM m)
    SELECT k AS l_orderkey, min(a) AS start, max(z) AS stop, string_agg(x, ' ' ORDER BY a, z, x) AS parts FROM c GROUP BY k, c""",
)
def overlap_groups(spark: SparkSession, sf: str) -> DataFrame:
    hits = entity(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 97).alias("start"), (F.col("l_partkey") % 97 + F.col("l_quantity").cast("int")).alias("stop"), F.concat(F.lit("t"), "l_suppkey").alias("token"))
    return m.merge_spans(hits, "l_orderkey")


@query("guard", f"SELECT conv_id, turn, role, {masked_sql('text', 'email')} AS text, coalesce(({masked_sql('text', 'email')} <> text)::INT, 0) AS guard_replaced FROM conversations")
def guard(spark: SparkSession, sf: str) -> DataFrame:
    rows = entity(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return m.guard(rows, SECRET)


@query(
    "name_spellings",
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'ооо "поставщик ' || s_suppkey || '"|поставщик ' || s_suppkey WHEN 1 THEN 'ао вега-' || s_suppkey || '|вега-' || s_suppkey ELSE '' END AS spellings FROM supplier""",
)
def name_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Names of suppliers with legal forms, and of numbers alone, in turn."""
    key = F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('ООО  «Поставщик '), key, F.lit("»"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("АО Вега-"), key)).otherwise(F.concat(F.lit("12 "), key))
    return entity(spark, sf, "supplier").select("s_suppkey", F.array_join(tx.name_spellings(name), "|").alias("spellings"))


_WRITTEN = "user_id || '@example.com'"


@query(
    "contact_rows",
    f"""SELECT event_id, CASE event_type WHEN 'click' THEN {token_sql('phone', "'7495' || lpad(user_id::VARCHAR, 7, '0')")} WHEN 'view' THEN {token_sql('email', _WRITTEN)} WHEN 'purchase' THEN {token_sql('addr', "'Street ' || user_id")}
    ELSE {token_sql('email', _WRITTEN)} END AS value FROM events""",
)
def contact_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts as JSON with their type inside: a value is closed by it, whatever field it is in; one of another type by what it looks like."""
    user = F.col("user_id").cast("string")
    digits = F.lpad(user, 7, "0")
    phone = F.concat(F.lit("+7 (495) "), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 4))
    mail = F.concat(user, F.lit("@Example.com"))
    kind = F.when(F.col("event_type") == "click", "Телефон").when(F.col("event_type") == "view", "АдресЭлектроннойПочты").when(F.col("event_type") == "purchase", "Адрес").otherwise("Другое")
    value = F.when(F.col("event_type") == "click", phone).when(F.col("event_type") == "purchase", F.concat(F.lit("Street  "), user)).otherwise(mail)
    rows = spread(entity(spark, sf, "events")).select("event_id", F.to_json(F.struct(kind.alias("type"), value.alias("value"), F.lit("7").alias("areaCode"))).alias("value"))
    return m.mask_fields(rows, SECRET)


@query(
    "governed_query",
    f"""SELECT c_custkey, {token_sql('org', 'lower(c_name)')} AS c_name, 'paid by ' || {token_sql('org', 'lower(c_name)')} || ' on account' AS note, 0 AS guard_replaced
    FROM customer WHERE c_acctbal > 100 ORDER BY c_custkey LIMIT 40 OFFSET 10""",
)
def governed_query(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a protected field are closed in the free text of the same rows too."""
    rows = entity(spark, sf, "customer").withColumn("note", F.concat(F.lit("paid by "), "c_name", F.lit(" on account")))
    found, _ = g.governed_query(spark, sf, "customer", g.Policy(SECRET), ["c_custkey", "c_name", "note"], [g.Condition("c_acctbal", "gt", 100)], ["c_custkey"], 40, 10, rows=rows)
    return found


@query("governed_by_token", f"SELECT c_custkey, {token_sql('org', 'lower(c_name)')} AS c_name, 0 AS guard_replaced FROM customer WHERE c_name = 'Customer#000000007'")
def governed_by_token(spark: SparkSession, sf: str) -> DataFrame:
    """A token that is part of something is an equality."""
    customer = entity(spark, sf, "customer")
    token = given(spark, ["Customer#000000007"]).select(t.token("org", F.col("x"), SECRET)).first()[0]
    policy = g.Policy(SECRET, dictionary=m.issue(customer, "org", "c_name", SECRET))
    return g.governed_query(spark, sf, "customer", policy, ["c_custkey", "c_name"], [g.Condition("c_name", "substringof", token)], ["c_custkey"])[0]


@query("mask_two_passes", f"SELECT s_suppkey, {token_sql('org', 'lower(s_name)')} AS s_name, 'from ' || {token_sql('org', 'lower(s_name)')} AS note, 0 AS guard_replaced FROM supplier")
def mask_two_passes(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(entity(spark, sf, "supplier")).select("s_suppkey", "s_name", F.concat(F.lit("from "), "s_name").alias("note"))
    return g.mask_rows(rows, g.Policy(SECRET))


@query("auto_representation", "SELECT o_orderkey, o_custkey, c_name AS o_custkey_text FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def auto_representation(spark: SparkSession, sf: str) -> DataFrame:
    return g.with_representation(entity(spark, sf, "orders").select("o_orderkey", "o_custkey"), {"o_custkey": (entity(spark, sf, "customer"), "c_custkey", "c_name")})


@query("service_columns", "SELECT r_regionkey, r_name FROM region")
def service_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = entity(spark, sf, "region").select("r_regionkey", "r_name").withColumn("odata.type", F.lit("x")).withColumn("DataVersion", F.lit("AAA="))
    return g.without_service_columns(rows)


TWELVE, TEN9 = "lpad(o_orderkey::VARCHAR, 12, '1')", "lpad(c_custkey::VARCHAR, 9, '1')"


@query("ogrn_keys", f"SELECT o_orderkey, {TWELVE}::BIGINT % 11 % 10 = o_orderkey % 10 AS valid FROM orders")
def ogrn_keys(spark: SparkSession, sf: str) -> DataFrame:
    number = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "1"), (F.col("o_orderkey") % 10).cast("string"))
    return entity(spark, sf, "orders").select("o_orderkey", c.ogrn_valid(number).alias("valid"))


@query("snils_keys", f"SELECT c_custkey, CASE WHEN s < 100 THEN s WHEN s IN (100, 101) THEN 0 ELSE s % 101 % 100 END = c_custkey % 100 AS valid FROM (SELECT c_custkey, {digits_sql(TEN9, (9, 8, 7, 6, 5, 4, 3, 2, 1))} AS s FROM customer)")
def snils_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    number = F.concat(F.lpad(key.cast("string"), 9, "1"), F.lpad((key % 100).cast("string"), 2, "0"))
    return entity(spark, sf, "customer").select("c_custkey", c.snils_valid(number).alias("valid"))


@query("account_keys", f"SELECT o_orderkey, substr(lpad((o_orderkey * 41 % 1000)::VARCHAR, 3, '0'), 1, 3) IN {c.ACCOUNT_PREFIXES} AS known FROM orders")
def account_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts whose last digits are nines, so that no five-digit prefix is met."""
    number = F.concat(F.lpad((F.col("o_orderkey") * 41 % 1000).cast("string"), 3, "0"), F.lit("9" * 17))
    return entity(spark, sf, "orders").select("o_orderkey", c.account_known(number).alias("known"))


@query(
    "card_network_keys",
    """SELECT o_orderkey, b // 1000 = 4 OR b // 100 BETWEEN 51 AND 55 OR b BETWEEN 2221 AND 2720 OR b BETWEEN 2200 AND 2204 OR b // 100 = 50 OR b // 100 BETWEEN 56 AND 58 OR b // 100 IN (62, 34, 37) AS known
    FROM (SELECT o_orderkey, o_orderkey * 7919 % 10000 AS b FROM orders)""",
)
def card_network_keys(spark: SparkSession, sf: str) -> DataFrame:
    number = F.concat(F.lpad((F.col("o_orderkey") * 7919 % 10000).cast("string"), 4, "0"), F.lit("0" * 12))
    return entity(spark, sf, "orders").select("o_orderkey", c.card_network_known(number).alias("known"))


@query("iban_keys", "SELECT c_custkey, ('32142829' || lpad(c_custkey::VARCHAR, 14, '0') || '1611' || lpad((c_custkey % 98)::VARCHAR, 2, '0'))::HUGEINT % 97 = 1 AS valid FROM customer")
def iban_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    number = F.concat(F.lit("GB"), F.lpad((key % 98).cast("string"), 2, "0"), F.lit("WEST"), F.lpad(key.cast("string"), 14, "0"))
    return entity(spark, sf, "customer").select("c_custkey", c.iban_valid(number).alias("valid"))


CUST9 = "lpad(o_custkey::VARCHAR, 9, '0')"
CUST_INN = f"({CUST9} || ({digits_sql(CUST9, c.INN_10)} % 11 % 10))"


@query(
    "guard_known_numbers",
    f"""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN 'to ' || {token_sql('inn', 'number')} || ' of [[inn:12]]'
    ELSE 'to ' || substr(number, 1, 4) || '-' || substr(number, 5, 3) || ' ' || substr(number, 8) || ' of [[inn:12]]' END AS note FROM (SELECT o_orderkey, o_custkey, {CUST_INN} AS number FROM orders)""",
)
def guard_known_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a third of the customers, written with separators, in notes of all orders."""
    inn = lambda key: F.concat(F.lpad(F.col(key).cast("string"), 9, "0"), c.inn_control(F.lpad(F.col(key).cast("string"), 9, "0")).cast("string"))
    customers = entity(spark, sf, "customer").where("c_custkey % 3 = 0").select(inn("c_custkey").alias("inn"))
    notes = entity(spark, sf, "orders").withColumn("i", inn("o_custkey"))
    notes = notes.select("o_orderkey", F.concat(F.lit("to "), F.substring("i", 1, 4), F.lit("-"), F.substring("i", 5, 3), F.lit(" "), F.substring("i", 8, 3), F.lit(" of [[inn:12]]")).alias("note"))
    return k.mask_known_numbers(notes, "o_orderkey", "note", k.numbers_of(m.issue(customers, "inn", "inn", SECRET)))


_LEAST = " ".join(f"WHEN '{name}' THEN {n}" for name, n in k.LEAST_LENGTH.items())
_KINDS = "['inn', 'phone', 'card', 'org', 'doc'][(o_orderkey % 5 + 1)::INT]"


@query("searchable_values", f"SELECT o_orderkey, length(repeat('7', (o_orderkey % 22)::INT)) >= CASE {_KINDS} {_LEAST} ELSE {k.LEAST_LENGTH_OTHERS} END AS searched FROM orders")
def searchable_values(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(*(F.lit(x) for x in ("inn", "phone", "card", "org", "doc"))), (F.col("o_orderkey") % 5).cast("int"))
    return entity(spark, sf, "orders").select("o_orderkey", k.searchable(kind, F.repeat(F.lit("7"), (F.col("o_orderkey") % 22).cast("int"))).alias("searched"))


@query(
    "garbage_tokens",
    """WITH s AS (SELECT 't' || p_partkey % 300 AS token, p_partkey % 300 < 100 OR p_partkey % 2 = 0 AS mark, p_partkey % 300 BETWEEN 150 AND 180 AS gender, p_partkey % 300 BETWEEN 250 AND 270 OR p_partkey % 7 = 0 AS echo FROM part)
    SELECT token FROM s GROUP BY token HAVING count(*) FILTER (NOT echo) = 0 OR bool_and(mark) FILTER (NOT echo) OR bool_and(gender) FILTER (NOT echo)""",
)
def garbage_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens with no value behind them: marks of tokens, a field that holds no names, and echoes alone."""
    n, key = F.col("p_partkey") % 300, F.col("p_partkey")
    rows = entity(spark, sf, "part").select(
        F.lit("person").alias("kind"),
        F.concat(F.lit("t"), n.cast("string")).alias("token"),
        F.when((n < 100) | (key % 2 == 0), F.concat(F.lit("to [[inn:"), key.cast("string"), F.lit("]]"))).otherwise(F.col("p_name")).alias("spelling"),
        F.when(n.between(150, 180), "gender").otherwise("name").alias("field"),
        (~(n.between(250, 270) | (key % 7 == 0))).alias("from_data"),
    )
    return k.garbage_tokens(rows, ("gender",))


@query(
    "reveal_ladder",
    """WITH s AS (SELECT 't' || user_id % 200 AS token, event_type AS base, 'f' || user_id % 3 AS field, 'v' || event_id AS spelling, lower('N' || user_id % 200) AS normalized, ts AS seen_at FROM events WHERE event_type <> 'view'),
    w AS (SELECT DISTINCT 't' || user_id % 200 AS token, event_type AS base, 'f' || user_id % 4 AS field FROM events)
    SELECT w.token, w.base, w.field, coalesce(max(own.spelling) FILTER (r = 1), max(n.normalized)) AS value FROM w
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY token, base, field ORDER BY seen_at DESC, spelling DESC) AS r FROM s) own USING (token, base, field)
    LEFT JOIN (SELECT token, min(normalized) AS normalized FROM s GROUP BY token) n ON n.token = w.token GROUP BY ALL""",
)
def reveal_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """What tokens stand for in a base and field: the spelling seen last there, else the normal form."""
    events, user = entity(spark, sf, "events"), F.col("user_id")
    token = F.concat(F.lit("t"), (user % 200).cast("string")).alias("token")
    field = lambda n: F.concat(F.lit("f"), (user % n).cast("string")).alias("field")
    spelled = events.where("event_type <> 'view'").select(token, F.col("event_type").alias("base"), field(3), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("spelling"), F.concat(F.lit("n"), (user % 200).cast("string")).alias("normalized"), F.col("ts").alias("seen_at"))
    return k.reveal(events.select(token, F.col("event_type").alias("base"), field(4)).distinct(), spelled)


@query(
    "policy_check",
    """WITH f AS (SELECT DISTINCT 'f' || p_partkey % 90 AS field FROM part),
    l AS (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'manual' ELSE 'library' END AS layer, 'f' || o_orderkey % 100 AS field, (['org', 'phone', 'org', 'inn', 'nothing'])[o_orderkey % 700 // 100 % 5 + 1] AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS rank FROM orders),
    p AS (SELECT layer, field, count(DISTINCT kind) AS n FROM l GROUP BY ALL), t AS (SELECT field, max(rank) AS rank FROM l GROUP BY field), k AS (SELECT field, max(kind) AS kind FROM l JOIN t USING (field, rank) GROUP BY field)
    SELECT layer, field, l.kind AS kind, unnest(list_filter([CASE WHEN field NOT IN (SELECT field FROM f) THEN 'unknown_field' END, CASE WHEN l.kind = 'nothing' THEN 'unknown_class' END, CASE WHEN n > 1 THEN 'conflict' END,
      CASE WHEN t.rank > l.rank AND k.kind <> l.kind THEN 'overridden' END], lambda x: x IS NOT NULL)) AS problem FROM l JOIN p USING (layer, field) JOIN t USING (field) JOIN (SELECT field, kind AS kind FROM k) k USING (field)""",
)
def policy_check(spark: SparkSession, sf: str) -> DataFrame:
    """Layers of a policy made of orders' keys, against fields made of parts' keys: more fields and classes than any table has."""
    key, manual = F.col("o_orderkey"), F.col("o_orderkey") % 5 == 0
    kinds = F.array(*map(F.lit, ("org", "phone", "org", "inn", "nothing")))
    layers = entity(spark, sf, "orders").select(F.when(manual, "manual").otherwise("library").alias("layer"), F.concat(F.lit("f"), (key % 100).cast("string")).alias("field"), F.get(kinds, F.expr("cast(o_orderkey % 700 div 100 % 5 as int)")).alias("kind"), manual.cast("int").alias("rank")).distinct()
    fields = entity(spark, sf, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 90).cast("string")).alias("field")).distinct()
    return k.policy_check(layers, fields, ("keep", "person", *(kind for kind, _ in m.NAME_RULES)))


@query(
    "token_collisions",
    f"""WITH t AS (SELECT lower(p_name) AS normalized, p_name AS spelling, right(replace({token_sql('org', 'lower(p_name)')}, ']]', ''), 1) AS last FROM (SELECT DISTINCT p_name FROM part)),
    r AS (SELECT *, row_number() OVER (PARTITION BY last ORDER BY normalized) AS n FROM t)
    SELECT normalized, length(CASE WHEN n = 1 THEN '[[org:' || last || ']]' ELSE '[[org:' || repeat('x', 16) || ']]' END)::INT AS long, CASE WHEN n = 1 THEN last END AS short FROM r""",
)
def token_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """With tails of one sign most values need a long one; the first of each sign keeps it."""
    issued = m.issue(entity(spark, sf, "part"), "org", "p_name", SECRET, signs=1)
    length = F.length("token")
    return issued.select("normalized", length.alias("long"), F.when(length < 10, F.substring("token", 7, 1)).alias("short"))
