"""What the dictionary knows: which of its values are searched for, what a token reveals, and known numbers in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import tokens
from ledgerlake.operators import textsearch as search
from ledgerlake.operators.detection import places, replace_spans

# The characters from which on a value of a class is searched for.
LEAST_LENGTH = {"inn": 10, "kpp": 9, "ogrn": 13, "acc": 20, "corr": 20, "bic": 9, "snils": 11, "sfr": 10, "card": 13, "iban": 15, "phone": 7, "doc": 6}
LEAST_LENGTH_OTHERS = 4


def searchable(kind: Column, normalized: Column) -> Column:
    """Whether a value is long enough to be looked for in texts that aren't its own."""
    least = F.lit(LEAST_LENGTH_OTHERS)
    for name, n in LEAST_LENGTH.items():
        least = F.when(kind == name, n).otherwise(least)
    return F.length(normalized) >= least


def garbage_tokens(spellings: DataFrame, not_names: tuple[str, ...] = ()) -> DataFrame:
    """(token) of tokens that no value stands behind. spellings has (kind, token, spelling, field, from_data), a row for each
    spelling. A token goes if none of its spellings comes from data, or if every one that does either holds a whole token or,
    for names, stands in a field of not_names. One real spelling keeps it."""
    mark = spellings["spelling"].rlike(tokens.TOKEN)
    other = F.col("kind").isin("org", "person") & F.col("field").isin(*not_names) if not_names else F.lit(False)
    seen = spellings.groupBy("token").agg(
        F.count_if("from_data").alias("__n"),
        F.count_if(F.col("from_data") & mark).alias("__marks"),
        F.count_if(F.col("from_data") & other).alias("__others"),
    )
    return seen.where("__n = 0 or __marks = __n or __others = __n").select("token")


def reveal(wanted: DataFrame, spellings: DataFrame) -> DataFrame:
    """wanted (token, base, field) with what each token stands for there: the spelling last seen in that base and field (of equal
    times the greatest), else the normal form, else null. spellings has (token, base, field, spelling, normalized, seen_at)."""
    own = spellings.groupBy("token", "base", "field").agg(F.max_by("spelling", F.struct("seen_at", "spelling")).alias("__own"))
    any_ = spellings.groupBy("token").agg(F.min("normalized").alias("__any"))
    found = wanted.join(own, ["token", "base", "field"], "left").join(any_, "token", "left")
    return found.select("token", "base", "field", F.coalesce("__own", "__any").alias("value"))


def blank_tokens(text: Column) -> Column:
    """text with each token and GUID as NULs of the same length, so that places stay and nothing is found in them."""
    return replace_spans(text, places(text, f"{tokens.TOKEN}|{search.GUID_IN_TEXT}"), lambda x: F.repeat(F.lit("\0"), x["stop"] - x["start"]))


def number_places(texts: DataFrame, key: str, text: str, numbers: DataFrame, most: int = search.PART) -> DataFrame:
    """(key, start, stop, token): where known numbers stand in texts, across separators and inside longer runs of digits, but
    not in tokens and GUIDs. numbers has (kind, token, digits). Of numbers with the same digits the smallest token counts. A
    document's number shorter than textsearch.WHOLE_DOC has to be a whole run or to stand in a passport's shape. Places may overlap.

    Up to `most` numbers are searched for in the rows, more of them by a join, in time that grows with texts and finds."""
    return search.finds(texts, key, text, search.books(numbers=numbers, most=most))


def mask_known_numbers(texts: DataFrame, key: str, text: str, numbers: DataFrame, most: int = search.PART) -> DataFrame:
    """texts with the known numbers of number_places() replaced by their tokens: from the left, of those that start at a place the
    longest, then the next after its end. key tells rows apart. Null texts stay null."""
    return search.replace_known(texts, key, text, search.books(numbers=numbers, most=most), search.leftmost)


def numbers_of(dictionary: DataFrame, garbage: DataFrame | None = None) -> DataFrame:
    """(kind, token, digits) of the dictionary (kind, token, spelling): the values of digit classes that are searched for."""
    rows = dictionary.where(F.col("kind").isin(*sorted(tokens.DIGIT_CLASSES))).select("kind", "token", F.regexp_replace("spelling", "[^0-9]", "").alias("digits"))
    rows = rows.where(searchable(F.col("kind"), F.col("digits"))).distinct()
    return rows if garbage is None else rows.join(garbage, "token", "left_anti")


def policy_check(layers: DataFrame, fields: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(layer, field, kind, problem) of the rows (layer, field, kind, rank) of a policy's layers: `unknown_field` of none of fields
    (field), `unknown_class`, `conflict` of two classes in one layer, `overridden` by another class in a layer of a higher rank."""
    named = fields.select("field").distinct().withColumn("__known", F.lit(True))
    per = layers.groupBy("field", "layer", "rank").agg(F.count_distinct("kind").alias("__classes"))
    top = layers.groupBy("field").agg(F.max(F.struct("rank", "kind")).alias("__top"))
    rows = layers.join(named, "field", "left").join(per, ["field", "layer", "rank"]).join(top, "field")
    problems = F.array(
        F.when(F.col("__known").isNull(), F.lit("unknown_field")),
        F.when(~F.col("kind").isin(*kinds), F.lit("unknown_class")),
        F.when(F.col("__classes") > 1, F.lit("conflict")),
        F.when((F.col("__top.rank") > F.col("rank")) & (F.col("__top.kind") != F.col("kind")), F.lit("overridden")),
    )
    return rows.select("layer", "field", "kind", F.explode(F.array_compact(problems)).alias("problem")).distinct()
