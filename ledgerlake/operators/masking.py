"""Governance of results: classes of fields, detection in free text, masking, dictionaries, rewriting and the last guard."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.errors import EngineError
from ledgerlake.functions import tokens
from ledgerlake.functions.text import name_form, name_variants
from ledgerlake.operators import nested
from ledgerlake.operators import textsearch as search
from ledgerlake.operators.detection import SCAN_ORDER, mask_text
from ledgerlake.sources.tables import kept, spread

NAME_RULES, GUID = nested.NAME_RULES, nested.GUID
MOST_SPELLINGS = 8
LONG_TAIL = 16  # signs of a token whose short tail another value has


def class_of_field(name: str, dtype: str, manual: dict[str, str] | None = None) -> str | None:
    """The class of a field: what the policy says, else by its name. Only strings have one; `keep` opens a field and `scan` leaves it to detection."""
    if manual and name in manual:
        return None if manual[name] in ("keep", "scan") else manual[name]
    return nested.class_of_name(name) if dtype == "string" else None


def odd_tokens(dictionary: DataFrame, secret: bytes) -> DataFrame:
    """(long, token) of the dictionary's values (kind, token, spelling) whose token isn't the short digest, as numbered ones and those that met
    another's: long is the digest with LONG_TAIL signs, by which a masked value is told from all others."""
    of = lambda signs: tokens.token_of(F.col("kind"), F.col("spelling"), secret, signs)
    rows = dictionary.where("spelling is not null").select(of(LONG_TAIL).alias("long"), of(10).alias("__short"), "token")
    return rows.where(F.col("token") != F.col("__short")).groupBy("long").agg(F.min("token").alias("token"))


def shown(token: str, known: dict[str, str]) -> str:
    """What is shown for a long token: the dictionary's, else its short form. The tail's last signs are the short one's."""
    if (found := known.get(token)) is not None:
        return found
    kind, _, tail = token[2:-2].rpartition(":")
    return f"[[{kind}:{tail[-10:]}]]"


def mask_fields(df: DataFrame, secret: bytes, manual: dict[str, str] | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """df with every field of a class tokenised, inside structs, arrays and maps too; GUIDs and tokens stay as they are, nulls stay null. A value that the
    dictionary (kind, token, spelling) has is shown by its token there."""
    marked, known, odd = with_long_tokens(df, secret, manual or {}, dictionary)
    return marked if odd is None else rewrite_strings(marked, known, odd, [])


def with_long_tokens(df: DataFrame, secret: bytes, manual: dict[str, str], dictionary: DataFrame | None) -> tuple[DataFrame, dict[str, str], DataFrame | None]:
    """df with its fields masked, and what is still to be put in the place of marked long tokens: a dictionary's odd tokens, as a dict, or, beyond
    ODD_IN_ROW, as an empty dict and the rows themselves. None where there is nothing to be put."""
    odd = None if dictionary is None else odd_tokens(dictionary, secret)
    n = 0 if odd is None else odd.count()
    if not n:
        return nested.rewrite(df, manual, lambda leaf: nested.token_of_leaf(leaf, secret)), {}, None
    marked = nested.rewrite(df, manual, lambda leaf: nested.token_of_leaf(leaf, secret, LONG_TAIL, MARK))
    return marked, dict(odd.collect()) if n <= ODD_IN_ROW else {}, odd


#: Odd tokens that a task holds, and what stands before a token that is to be looked up.
ODD_IN_ROW, MARK = 200_000, "\x01"


def _over_strings(column: pa.Array, make: Callable[[str], str]) -> pa.Array:
    """The column with each string inside it made anew; equal strings of a column are made once."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        coded = column.dictionary_encode()
        return pa.array([make(x) for x in coded.dictionary.to_pylist()], kind).take(coded.indices)
    if pa.types.is_struct(kind) and kind.num_fields:
        return pa.StructArray.from_arrays([_over_strings(c, make) for c in column.flatten()], fields=list(kind), mask=column.is_null())
    if pa.types.is_map(kind):
        pairs = column.cast(pa.list_(pa.struct([kind.key_field, kind.item_field])))
        ends, inner = _ends(pairs), pairs.flatten()
        keys, items = inner.flatten() if len(inner) else (pa.array([], kind.key_type), pa.array([], kind.item_type))
        return pa.MapArray.from_arrays(ends, keys, _over_strings(items, make), type=kind, mask=column.is_null())
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        of = pa.ListArray if pa.types.is_list(kind) else pa.LargeListArray
        return of.from_arrays(_ends(column), _over_strings(column.flatten(), make), type=kind, mask=column.is_null())
    return column


def _ends(column: pa.Array) -> pa.Array:
    """The offsets of a list column's flattened values, in which nulls and what lies outside of a slice have none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int64() if pa.types.is_large_list(column.type) else pa.int32())


def rewrite_strings(df: DataFrame, known: dict[str, str], odd: DataFrame | None, parts: list[search.Book | search.Forms | search.Numbers], open_fields: frozenset[str] = frozenset()) -> DataFrame:
    """df with marked long tokens as they are shown, and the finds of parts replaced in all other strings but those of open_fields.

    With one part, and odd tokens that a task holds, each row is made anew by itself. Else rows are kept with a number, what changes is worked out for the
    distinct strings, by passes over them and joins, and comes back to the rows as one map each: the plan is the same for any number of columns."""
    if len(parts) > 1 or not all(isinstance(b, search.Book) for b in parts) or (odd is not None and not known):
        return _rewrite_by_map(df, odd, parts, open_fields)
    names = df.columns

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        book = search.Search.of(parts[0]) if parts else None
        closed = lambda x: shown(x[1:], known) if x.startswith(MARK + "[[") else x
        text = lambda x: shown(x[1:], known) if x.startswith(MARK + "[[") else book.masked(x) if book and x else x
        return pa.RecordBatch.from_arrays([_over_strings(batch.column(k), closed if name in open_fields else text) for k, name in enumerate(names)], names)

    return search.over_texts(df, make, df.schema)


def _rewrite_by_map(df: DataFrame, odd: DataFrame | None, parts: list[search.Book | search.Forms | search.Numbers], open_fields: frozenset[str]) -> DataFrame:
    digest = lambda x: F.unhex(F.substring(F.sha2(x, 256), 1, 32))
    marked = lambda x: F.startswith(x, F.lit(MARK + "[["))
    keyed = kept(df.withColumn("__row", F.monotonically_increasing_id()))  # rows are masked once, and numbers stay with them
    closed = nested.gather(df, {}, lambda leaf: leaf.value, "string")
    texts = nested.gather(df, {}, lambda leaf: leaf.value, "string", lambda name, dtype: name not in open_fields)
    changes = []
    if odd is not None:
        spot = F.substr("x", F.lit(2))
        cells = keyed.select("__row", F.explode(F.array_distinct(F.filter(F.concat(closed, texts), marked))).alias("x"))
        long = cells.join(odd, spot == F.col("long"), "left")
        short = F.concat(F.regexp_extract(spot, r"^(\[\[.*:)[0-9A-Z]+\]\]$", 1), F.substr(spot, F.length(spot) - 11))
        changes.append(long.select("__row", digest(F.col("x")).alias("key"), F.coalesce("token", short).alias("y")))
    if parts:  # nothing is found in what is a token as a whole
        texts = F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & ~marked(x) & ~tokens.is_token(x)))
        plain = keyed.select(F.explode(texts).alias("x")).distinct().select("x", digest(F.col("x")).alias("key"))
        numbers, names = [b for b in parts if b.numbers], [b for b in parts if b.names]
        made = plain.withColumn("y", F.col("x"))
        if numbers:
            made = search.replace_finds(made, "key", "y", search.finds(made, "key", "y", [replace(b, names=(), digest=b.digest + "n") if isinstance(b, search.Book) else b for b in numbers]), search.leftmost)
        if names:
            made = search.replace_finds(made, "key", "y", search.finds(made, "key", "y", [replace(b, numbers={}, digest=b.digest + "s") if isinstance(b, search.Book) else b for b in names]), search.groups)
        cells = keyed.select("__row", F.explode(F.transform(texts, digest)).alias("key"))
        changes.append(cells.join(made.where("x <> y").select("key", "y"), "key").select("__row", "key", "y"))
    if not changes:
        return df
    every = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
    maps = every.groupBy(F.col("__row").alias("__of")).agg(F.map_from_entries(F.collect_set(F.struct("key", "y"))).alias("__changes"))
    joined = keyed.join(maps, F.col("__row") == F.col("__of"), "left")
    new = lambda leaf: F.coalesce(F.try_element_at("__changes", digest(leaf.value)), leaf.value)
    here = lambda leaf: F.when(marked(leaf.value), new(leaf)).otherwise(leaf.value)
    columns = [
        nested.walk(F.col(f"`{f.name}`"), f.dataType, f.name, {}, nested.Rebuild(here if f.name in open_fields else new)).alias(f.name) if nested.has_strings(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields
    ]
    return joined.select(*columns)


def masked_share(df: DataFrame) -> DataFrame:
    """(field, n_masked, n_rows) of every string field, from one pass."""
    names = [n for n, t in df.dtypes if t == "string"]
    sums = df.agg(F.count("*").alias("__n"), *(F.count_if(tokens.is_token(F.col(f"`{n}`"))).alias(f"m_{k}") for k, n in enumerate(names)))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"m_{k}").alias("n_masked"), F.col("__n").alias("n_rows")) for k, n in enumerate(names)))))


def issue(values: DataFrame, kind: str, column: str, secret: bytes, known: DataFrame | None = None, signs: int = 10) -> DataFrame:
    """Dictionary rows (kind, normalized, token, spelling) of values that the dictionary lacks; the spelling is the smallest.
    A tail of `signs` that another value has, known before or the smaller of the new ones, makes a tail of LONG_TAIL."""
    rows = values.select(F.col(column).alias("spelling")).where("spelling is not null").withColumn("normalized", tokens.normalize(kind, F.col("spelling")))
    fresh = rows.groupBy("normalized").agg(F.min("spelling").alias("spelling"))
    fresh = fresh.withColumn("token", tokens.token(kind, F.col("spelling"), secret, signs))
    place = F.row_number().over(Window.partitionBy("token").orderBy("normalized"))  # a digest's tail: few rows each
    fresh = fresh.withColumn("__second", place > 1)
    if known is not None:
        before = known.where(F.col("kind") == kind)
        fresh = fresh.join(before.select("normalized"), "normalized", "left_anti")
        fresh = fresh.join(before.select("token", F.lit(True).alias("__taken")).distinct(), "token", "left").withColumn("__second", F.col("__second") | F.coalesce("__taken", F.lit(False)))
    long = tokens.token(kind, F.col("spelling"), secret, LONG_TAIL)
    return fresh.select(F.lit(kind).alias("kind"), "normalized", F.when(F.col("__second"), long).otherwise(F.col("token")).alias("token"), "spelling")


def numbered(values: DataFrame, column: str, kind: str, known: DataFrame | None = None, signs: int = 2) -> DataFrame:
    """(normalized, number, token): known rows (normalized, number) as they are, and values that they lack with the numbers
    after the largest known one, in the order of their digest. So a number never comes to mean another value.

    Numbers are dealt within the 16 ** signs buckets of a digest's first signs and shifted by the buckets' counts,
    so no task sees all values."""
    distinct = values.select(tokens.normalize(kind, F.col(column)).alias("normalized")).where("normalized is not null").distinct()
    if known is not None:
        distinct = distinct.join(known.select("normalized"), "normalized", "left_anti")
    most = 0 if known is None else known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    hashed = distinct.withColumn("__h", F.md5("normalized")).withColumn("__b", F.substring("__h", 1, signs))
    counts = hashed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy("__h", "normalized"))
    fresh = hashed.withColumn("__own", own).join(F.broadcast(before), F.col("__b") == F.col("__c")).select("normalized", (F.col("__before") + F.col("__own") + most).cast("long").alias("number"))
    both = fresh if known is None else known.select("normalized", F.col("number").cast("long").alias("number")).unionByName(fresh)
    return both.withColumn("token", F.concat(F.lit(f"[[{kind}:"), F.col("number").cast("string"), F.lit("]]")))


def resolve_variants(variants: DataFrame) -> DataFrame:
    """(variant, token, n_claims) from (variant, token, exact): the only claimant, else the only exact one, else none."""
    claims = variants.groupBy("variant").agg(F.array_sort(F.collect_set("token")).alias("all"), F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("token")))).alias("sure"))
    winner = F.when(F.size("all") == 1, F.get("all", F.lit(0))).when(F.size("sure") == 1, F.get("sure", F.lit(0)))
    return claims.select("variant", winner.alias("token"), F.size("all").alias("n_claims"))


def spellings(dictionary: DataFrame, token: str) -> list[str]:
    """What a token stands for, at most MOST_SPELLINGS; read at planning time for rewriting a filter."""
    found = [r[0] for r in dictionary.where(F.col("token") == token).select("spelling").distinct().orderBy("spelling").limit(MOST_SPELLINGS + 1).collect()]
    if not found:
        raise EngineError("token_unknown", "the token is not in the dictionary")
    if len(found) > MOST_SPELLINGS:
        raise EngineError("token_ambiguous", f"the token has over {MOST_SPELLINGS} spellings")
    return found


def filter_by_token(df: DataFrame, field: str, token: str, dictionary: DataFrame, manual: dict[str, str] | None = None, negate: bool = False) -> DataFrame:
    """Rows whose protected field has one of the token's spellings. A token of another class than the field's is refused."""
    kind = class_of_field(field, dict(df.dtypes)[field], manual)
    if (m := re.fullmatch(tokens.TOKEN, token)) is None:
        raise EngineError("token_partial", "the token is damaged")
    if kind != m[1]:
        raise EngineError("token_type_mismatch", f"{field} doesn't hold values of the class {m[1]}")
    hit = F.col(field).isin(spellings(dictionary, token))
    return df.where(~hit if negate else hit)


def check_filter(field_classes: dict[str, str], field: str, operation: str, literal_is_token: bool) -> None:
    """Which comparisons a protected field may be in: equality and the three substring calls; dates of birth and contacts only by token."""
    kind = field_classes.get(field)
    if kind is None:
        return
    if operation not in ("eq", "ne", "substringof", "startswith", "endswith"):
        raise EngineError("filter_syntax", f"{field} is protected: {operation} is not allowed on it")
    if kind in ("dob", "phone", "email", "addr") and not literal_is_token:
        raise EngineError("filter_syntax", f"{field} is compared with tokens only")


#: Phrases that one pass over the texts searches for.
PHRASES_IN_ROW = search.PART


def _phrase_forms(phrases: DataFrame) -> DataFrame:
    """(phrase, __p): the words of each phrase by which it is compared; a phrase without words is left out."""
    words = F.filter(F.split(F.lower(F.translate("phrase", tokens.QUOTES, tokens.FOLDED)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return phrases.select("phrase", F.array_join(words, " ").alias("__p")).where("__p <> ''")


def _phrase_books(forms: DataFrame, most: int) -> list[search.Book]:
    return search.books(names=forms.select(F.col("__p").alias("spelling"), F.col("__p").alias("token")).distinct(), words=True, most=most)


def _with_phrases(found: DataFrame, forms: DataFrame, parts: list[search.Book]) -> DataFrame:
    forms = F.broadcast(forms) if all(isinstance(b, search.Book) for b in parts) else forms
    return found.join(forms, F.col("__form") == F.col("__p"))


def phrase_places(texts: DataFrame, key: str, text: str, phrases: DataFrame, most: int = PHRASES_IN_ROW) -> DataFrame:
    """(key, phrase, start, stop): each place of each phrase in each text, as whole words, in any case, with quotes and ё folded and whatever
    stands between words; characters count from 0 and a place goes from a phrase's first word to its last. phrases holds each phrase once.

    Up to `most` phrases are searched for in the rows, more of them by a join, in time that grows with texts and finds."""
    forms = _phrase_forms(phrases)
    parts = _phrase_books(forms, most)
    found = search.finds(texts, key, text, parts).withColumnRenamed("token", "__form")
    return _with_phrases(found, forms, parts).select(key, "phrase", "start", "stop")


def find_phrases(texts: DataFrame, key: str, text: str, phrases: DataFrame, most: int = PHRASES_IN_ROW) -> DataFrame:
    """(key, phrase, hits): how often each phrase occurs in each text, by the rules of phrase_places() but without places."""
    forms = _phrase_forms(phrases)
    parts = _phrase_books(forms, most)
    found = search.phrase_counts(texts, key, text, parts).withColumnRenamed("phrase", "__form")
    return _with_phrases(found, forms, parts).select(key, "phrase", "hits")


def mask_known_names(texts: DataFrame, key: str, text: str, dictionary: DataFrame, most: int = PHRASES_IN_ROW) -> DataFrame:
    """texts with every spelling of dictionary (spelling, token) in `text` replaced by its token, by the rules of phrase_places(). Where spellings
    overlap, the one that starts first, and of those the longest, is replaced, then the next that starts after it.
    A spelling of two tokens is left as it is. key tells rows apart. Null texts stay null. Names with their variants, word
    boundaries and overlaps are replaced by replace_names()."""
    return search.replace_known(texts, key, text, search.books(names=dictionary, words=True, most=most), search.leftmost)


def variants_of(names: DataFrame) -> DataFrame:
    """(spelling, token): by what the names (spelling, token) are searched for, see name_variants(). A variant of several names goes to the one whose whole
    name it is, if that is only one, else to none."""
    rows = spread(names.where("spelling is not null")).select("token", name_form(F.col("spelling")).alias("__whole"), F.explode(name_variants(F.col("spelling"))).alias("variant"))
    claims = rows.select("variant", "token", (F.col("variant") == F.col("__whole")).alias("exact"))
    return resolve_variants(claims).where("token is not null").select(F.col("variant").alias("spelling"), "token")


def replace_names(texts: DataFrame, key: str, text: str, names: DataFrame, most: int = PHRASES_IN_ROW) -> DataFrame:
    """texts with the names (spelling, token) replaced wherever one of their variants stands as a word of its own, in any case, across white space,
    invisible characters and escapes. Overlapping finds are replaced together, see textsearch.groups(). Tokens in a text are left alone;
    null texts stay null."""
    return search.replace_known(texts, key, text, search.books(names=variants_of(names), most=most), search.groups)


def merge_spans(hits: DataFrame, key: str) -> DataFrame:
    """(key, start, stop, parts): overlapping hits (key, start, stop, token) joined to clusters, their tokens in order."""
    upto = Window.partitionBy(key).orderBy("start", "stop", "token").rowsBetween(Window.unboundedPreceding, -1)
    marked = hits.withColumn("__new", F.when(F.col("start") < F.max("stop").over(upto), 0).otherwise(1))
    running = Window.partitionBy(key).orderBy("start", "stop", "token").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("__c", F.sum("__new").over(running))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "stop", "token"))), lambda x: x["token"]), " ")
    return placed.groupBy(key, "__c").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), parts.alias("parts")).drop("__c")


def group_spans(hits: DataFrame, key: str) -> DataFrame:
    """(key, start, stop, tokens): textsearch.groups() over rows (key, start, stop, token), for finds that other engines have made."""
    order = (F.col("start"), F.col("stop").desc(), F.col("token"))
    earlier = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reached = hits.withColumn("__reach", F.max("stop").over(earlier))
    fresh = F.col("__reach").isNull() | (F.col("start") >= F.col("__reach"))
    placed = reached.withColumn("__group", F.sum(F.when(fresh, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    apart = placed.where(fresh | (F.col("stop") > F.col("__reach")))
    again = F.lag("token").over(Window.partitionBy(key, "__group").orderBy(*order))
    marked = apart.withColumn("__shown", F.when(F.col("token").eqNullSafe(again), "").otherwise(F.col("token")))
    rows = F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("far"), "token", "__shown")))
    return marked.groupBy(key, "__group").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_join(F.transform(rows, lambda x: x["__shown"]), "").alias("tokens")).drop("__group")


@lru_cache(maxsize=8)
def _scanned(app: str, kinds: tuple[str, ...], secret: bytes) -> Column:
    """The array __texts with its texts masked. Building it takes some 17,000 calls and 2 to 3 s, whatever the data, so each application does it once. All
    patterns need a digit or an @, so texts that have none beside their tokens are left as they are."""
    some = lambda x: F.regexp_replace(x, tokens.TOKEN, "").rlike(r"(?U)[\d@]")
    return F.transform("__texts", lambda x: F.when(some(x), mask_text(x, list(kinds), secret)).otherwise(x))


def guard(df: DataFrame, secret: bytes, kinds: tuple[str, ...] = SCAN_ORDER) -> DataFrame:
    """The last step before rows leave: every string, inside structs, arrays and maps too, is searched once more. guard_replaced counts
    the fields, or strings inside them, that changed. All strings of a row go through one expression."""
    top = [n for n, t in df.dtypes if t == "string"]
    inner = [f.name for f in df.schema.fields if f.name not in top and nested.has_strings(f.dataType)]
    if not top and not inner:
        return df.withColumn("guard_replaced", F.lit(0))
    deep = F.filter(nested.gather(df, {}, lambda leaf: leaf.value, "string", lambda name, dtype: name in inner), lambda x: x.isNotNull())
    texts = F.array(*(F.col(f"`{n}`") for n in top)) if top else F.expr("cast(array() as array<string>)")
    out = df.withColumn("__texts", F.concat(texts, F.array_distinct(deep)) if inner else texts)
    out = out.withColumn("__guarded", _scanned(df.sparkSession.conf.get("spark.app.id"), tuple(kinds), secret))
    after = {n: F.get("__guarded", F.lit(k)) for k, n in enumerate(top)}
    changed = F.lit(0)
    for n, c in after.items():
        changed = changed + F.coalesce((c != F.col(f"`{n}`")).cast("int"), F.lit(0))
    if inner:
        rest = lambda c: F.slice(c, len(top) + 1, F.greatest(F.size(c) - len(top), F.lit(0)))
        out = out.withColumn("__new", F.map_from_arrays(rest(F.col("__texts")), rest(F.col("__guarded"))))
        changed = changed + F.size(F.filter(deep, lambda x: F.element_at("__new", x) != x))
        make = nested.Rebuild(lambda leaf: F.when(leaf.value.isNotNull(), F.element_at("__new", F.coalesce(leaf.value, F.lit("")))))
        after |= {f.name: nested.walk(F.col(f"`{f.name}`"), f.dataType, f.name, {}, make) for f in df.schema.fields if f.name in inner}
    kept = [after[n].alias(n) if n in after else F.col(f"`{n}`") for n in df.columns]
    return out.select(*kept, changed.alias("guard_replaced"))
