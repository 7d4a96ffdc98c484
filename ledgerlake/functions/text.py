"""Text expressions: names, trigrams, stems, truncation, URL parts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that a name may start with.
LEGAL_FORMS = ("ооо", "оао", "зао", "пао", "ао", "ип", "нко", "ано", "фгуп", "гуп", "муп", "тсж", "снт")
# Legal forms written out and in letters of the Latin keyboard, and how a name of one word is written when it is meant as a name.
WRITTEN_OUT = {
    "ооо": "общество с ограниченной ответственностью",
    "ип": "индивидуальный предприниматель",
    "ао": "акционерное общество",
    "пао": "публичное акционерное общество",
    "зао": "закрытое акционерное общество",
    "оао": "открытое акционерное общество",
}
LATIN_FORMS = {"ооо": "ooo", "оао": "oao", "ао": "ao"}
AS_NAME = ('"{}', "'{}'", "'{}", "‘{}’", "‘{}", "’{}’", "’{}", '{}"', '" {}"')
WITH_FORM = ("{f} {}", '{f} "{}"', '{f}"{}"')
WORD_WITH_FORM = ("{f}.{}", "{f}-{}")
WITH_LONG_FORM = ("{f} {}", '{f} "{}"')
LEAST_VARIANT = 4


def words_of_name(x: Column) -> Column:
    """The words of a CamelCase or underscored name, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(x, r"(\p{Ll}|[0-9])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.split(F.trim(F.lower(F.translate(F.regexp_replace(spaced, r"[_\s]+", " "), "ёЁ", "еЕ"))), " ")


def trigrams(x: Column) -> Column:
    n = F.length(x)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(x, i, F.lit(3))))).otherwise(F.expr("cast(array() as array<string>)"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all different trigrams; 0 where either text has none."""
    ta, tb = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(ta, tb))
    return F.when((F.length(a) < 3) | (F.length(b) < 3), F.lit(0.0)).otherwise(shared / F.size(F.array_union(ta, tb)))


def name_spellings(x: Column) -> Column:
    """Spellings of an organisation's name by which a text may have it: as it is, without the legal form,
    and the part in quotes. Only those of four characters and more that aren't numbers."""
    flat = F.trim(F.regexp_replace(F.lower(F.translate(x, "«»“”„ёЁ", '"""""еЕ')), r"\s+", " "))
    bare = F.regexp_replace(flat, rf'^({"|".join(LEGAL_FORMS)})[ "]+', "")
    quoted = F.regexp_extract(flat, '"([^"]+)"', 1)
    return F.array_sort(F.array_distinct(F.filter(F.array(flat, F.regexp_replace(bare, '"', ""), quoted), lambda s: (F.length(s) >= 4) & ~s.rlike("^[0-9 ]+$"))))


def name_form(x: Column) -> Column:
    """A name as names are compared: quotes and ё folded, white space collapsed, lower case."""
    return F.trim(F.regexp_replace(F.lower(F.translate(x, "«»“”„ёЁ", '"""""еЕ')), r"(?U)\s+", " "))


def _written(pattern: str, core: Column, form: Column | None = None) -> Column:
    """The pattern with the core for {} and the form for {f}."""
    parts = [p for p in re.split(r"(\{f?\})", pattern) if p]
    return F.concat(*(core if p == "{}" else form if p == "{f}" else F.lit(p) for p in parts))


def name_variants(x: Column) -> Column:
    """Array of the spellings by which a name is searched for in texts: itself and without its legal form. A core that is one word of one script, or has
    no letters, can't be told from other words and numbers: it is searched for only as it is written when meant as a name, in quotes or with its own
    legal form. Variants shorter than LEAST_VARIANT, or with a NUL, are left out; null gives null."""
    head = rf'^({"|".join(LEGAL_FORMS)})[ "]+'
    core = lambda flat: F.regexp_replace(F.regexp_replace(flat, head, ""), r'^[ "]+|[ "]+$', "")
    parts = _once(name_form(x), lambda flat: F.struct(flat.alias("flat"), F.regexp_extract(flat, head, 1).alias("form"), core(flat).alias("core")))
    return F.when(x.isNotNull(), _once(parts, lambda p: _variants(p["flat"], p["form"], p["core"])))


def _once(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _variants(flat: Column, form: Column, core: Column) -> Column:
    mixed = r"(?=.*\p{IsLatin})(?=.*\p{IsCyrillic})|(?=.*\p{IsLatin})(?=.*\p{IsGreek})|(?=.*\p{IsCyrillic})(?=.*\p{IsGreek})"
    word = lambda c: c.rlike(r"^\p{L}+$") & ~c.rlike(f"^(?:{mixed})")
    lettered = lambda c: c.rlike(r"\p{L}")
    bare = (core != "") & (~lettered(core) | word(core))
    long = F.length(core) >= LEAST_VARIANT
    own = form != ""
    a_word = word(core) & long
    one = lambda where, pattern, f=None: F.when(where, _written(pattern, core, f))
    as_name = [F.when(lettered(flat) & ~word(flat), flat), one(long, '"{}"'), *(one(a_word, p) for p in AS_NAME), *(one(own, p, form) for p in WITH_FORM)]
    as_name += [one(own & a_word, p, form) for p in WORD_WITH_FORM]
    for forms, patterns in ((LATIN_FORMS, WITH_FORM), (WRITTEN_OUT, WITH_LONG_FORM)):
        other = F.lit(None).cast("string")
        for f, written in forms.items():
            other = F.when(form == f, written).otherwise(other)
        as_name += [one(a_word, p, other) for p in patterns]
    found = F.when(bare, F.array(*as_name)).otherwise(F.array(flat, core))
    return F.array_distinct(F.filter(F.array_compact(found), lambda v: (F.length(v) >= LEAST_VARIANT) & ~F.contains(v, F.lit("\0"))))


def truncated(x: Column, most: int, mark: str = "…") -> Column:
    """x cut to `most` characters with a mark of how many are gone; a token is never cut through."""
    cut = F.substring(x, 1, most)
    whole = F.regexp_replace(cut, r"\[\[[a-z0-9_:]*[0-9A-Z]*\]?$", "")
    return F.when(F.length(x) > most, F.concat(whole, F.lit(f"{mark}["), (F.length(x) - F.length(whole)).cast("string"), F.lit("]"))).otherwise(x)
