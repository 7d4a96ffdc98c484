"""Stems of Russian and English words by the published Snowball rules, as column expressions.

Each step is an ordered rule on a suffix: the longest ending of a list that stands in its region goes or is replaced. A rule sees
a word (`w`) and where its regions begin (`rv`, `r1`, `r2`, characters from 0), so a step is one expression and a word takes no loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.text import words_of_name

# The endings of the published Russian rules, and vowels.
RU_VOWELS = "аеиоуыэюя"
RU_GERUND = (("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв"))
RU_REFLEXIVE = ("ся", "сь")
RU_ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
RU_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
RU_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
RU_DERIVATIONAL, RU_SUPERLATIVE = ("ость", "ост"), ("ейше", "ейш")
# The endings of the published English rules (the second version of Porter's), and words that are exceptions.
EN_VOWELS = "aeiouy"
EN_DOUBLES = "bb dd ff gg mm nn pp rr tt".split()
EN_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
EN_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
EN_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
EN_IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
EN_AFTER_1A = "inning outing canning herring earring proceed exceed succeed".split()


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _ends(endings: list[str] | tuple[str, ...]) -> str:
    """A pattern of the longest of the endings at the end of a word."""
    return "(?:" + "|".join(sorted(endings, key=lambda e: (-len(e), e))) + ")$"


def _cut(x: Column, pattern: str) -> Column:
    return F.regexp_replace(x, pattern, "")


def _first_of(x: Column, patterns: list[str]) -> Column:
    """x without the first of the patterns that it has."""
    out = x
    for p in reversed(patterns):
        out = F.when(x.rlike(p), _cut(x, p)).otherwise(out)
    return out


def russian_stem(word: Column) -> Column:
    """The stem of a word in lower case with ё as е."""
    either = lambda groups: f"(?:(?<=[ая]){_ends(groups[0])}|{_ends(groups[1])})"
    split = f"^([^{RU_VOWELS}]*[{RU_VOWELS}]?)(.*)$"
    region = f"^.*?[{RU_VOWELS}].*?[^{RU_VOWELS}](.*)$"  # what follows the first consonant behind a vowel
    adjective, derived, superlative = _ends(RU_ADJECTIVE), _ends(RU_DERIVATIONAL), _ends(RU_SUPERLATIVE)

    def endings(rv: Column) -> Column:
        """The first rules, on the part behind the first vowel."""
        others = _let(_cut(rv, _ends(RU_REFLEXIVE)), lambda x: F.when(x.rlike(adjective), _first_of(_cut(x, adjective), [either(RU_PARTICIPLE)])).otherwise(_first_of(x, [either(RU_VERB), _ends(RU_NOUN)])))
        return _cut(F.when(rv.rlike(either(RU_GERUND)), _cut(rv, either(RU_GERUND))).otherwise(others), "и$")

    def rest(x: Column) -> Column:
        """The last rules, on (head, rv, n): n is the length that the word has before its second region."""
        inside = F.length(x["head"]) + F.length(_cut(x["rv"], derived)) >= x["n"]
        return _let(F.when(x["rv"].rlike(derived) & inside, _cut(x["rv"], derived)).otherwise(x["rv"]), last)

    def last(rv: Column) -> Column:
        plain = _let(_cut(rv, superlative), lambda y: F.when(y.rlike("нн$"), _cut(y, "н$")).otherwise(y))
        return F.when(rv.rlike("ь$"), _cut(rv, "ь$")).otherwise(plain)

    before = F.length(word) - F.length(F.regexp_extract(F.regexp_extract(word, region, 1), region, 1))
    second = F.regexp_extract(word, region, 1).rlike(region)
    parts = F.struct(F.regexp_extract(word, split, 1).alias("head"), _let(F.regexp_extract(word, split, 2), endings).alias("rv"), F.when(second, before).otherwise(F.length(word)).alias("n"))
    return _let(parts, lambda x: F.concat(x["head"], rest(x)))


def english_stem(word: Column) -> Column:
    """The stem of a word in lower case; a word of one or two letters is its own."""
    v = EN_VOWELS
    region = f"^.*?[{v}].*?[^{v}](.*)$"
    exempt = "^(?:gener|commun|arsen)"
    syllable = f"(?:[^{v}][{v}][^{v}wxY]|^[{v}][^{v}])$"
    swap = lambda c, e, by: F.concat(F.substr(c, F.lit(1), F.length(c) - len(e)), F.lit(by))
    holds = lambda c, e, at: F.length(c) - len(e) >= at

    def rules(c: Column, table: dict[str, Callable[[Column], Column]]) -> Column:
        """The rule of the longest ending that c has."""
        out = c
        for e, made in sorted(table.items(), key=lambda kv: (len(kv[0]), kv[0])):
            out = F.when(c.rlike(f"{e}$"), made(c)).otherwise(out)
        return out

    def steps(x: Column) -> Column:
        """All steps on (w, r1, r2): regions begin where the letters before them end, so they stay as endings change."""
        r1, r2 = x["r1"], x["r2"]
        keep = lambda c: c
        in_r1 = lambda e, by: lambda c: F.when(holds(c, e, r1), swap(c, e, by)).otherwise(c)
        in_r2 = lambda e: lambda c: F.when(holds(c, e, r2), swap(c, e, "")).otherwise(c)
        long_i = lambda e: lambda c: F.when(F.length(c) > 4, swap(c, e, "i")).otherwise(swap(c, e, "ie"))
        plural = {"sses": lambda c: swap(c, "sses", "ss"), "ied": long_i("ied"), "ies": long_i("ies"), "us": keep, "ss": keep, "s": lambda c: F.when(c.rlike(f"[{v}].+s$"), swap(c, "s", "")).otherwise(c)}

        def mended(rest: Column) -> Column:
            short = rest.rlike(syllable) & (r1 >= F.length(rest))
            return F.when(rest.rlike("(?:at|bl|iz)$") | short, F.concat(rest, F.lit("e"))).when(rest.rlike(_ends(EN_DOUBLES)), _cut(rest, ".$")).otherwise(rest)

        undone = lambda e: lambda c: _let(swap(c, e, ""), lambda rest: F.when(rest.rlike(f"[{v}]"), mended(rest)).otherwise(c))
        past = {"eed": in_r1("eed", "ee"), "eedly": in_r1("eedly", "ee"), **{e: undone(e) for e in ("ed", "edly", "ing", "ingly")}}
        two = {e: in_r1(e, by) for e, by in EN_STEP2.items()}
        two["ogi"] = lambda c: F.when(holds(c, "ogi", r1) & c.rlike("logi$"), swap(c, "ogi", "og")).otherwise(c)
        two["li"] = lambda c: F.when(holds(c, "li", r1) & c.rlike("[cdeghkmnrt]li$"), swap(c, "li", "")).otherwise(c)
        three = {e: in_r1(e, by) for e, by in EN_STEP3.items()} | {"ative": in_r2("ative")}
        four = {e: in_r2(e) for e in EN_STEP4}
        four["ion"] = lambda c: F.when(holds(c, "ion", r2) & c.rlike("[st]ion$"), swap(c, "ion", "")).otherwise(c)

        def five(c: Column) -> Column:
            bare = _cut(c, "e$")
            mute = F.when(holds(c, "e", r2) | (holds(c, "e", r1) & ~bare.rlike(syllable)), bare).otherwise(c)
            return F.when(c.rlike("e$"), mute).when(c.rlike("ll$") & holds(c, "l", r2), _cut(c, "l$")).otherwise(c)

        by = lambda table: lambda y: rules(y, table)

        def after_plural(c: Column) -> Column:
            out = _let(c, lambda y: rules(y, past))
            out = _let(out, lambda y: F.when(y.rlike(f".[^{v}][yY]$"), F.concat(_cut(y, ".$"), F.lit("i"))).otherwise(y))
            for table in (two, three, four):
                out = _let(out, by(table))
            return F.when(c.isin(*EN_AFTER_1A), c).otherwise(_let(out, five))

        return _let(_let(_cut(x["w"], r"('s'|'s|')$"), lambda c: rules(c, plural)), after_plural)

    def regions(m: Column) -> Column:
        r1_text = F.when(m.rlike(exempt), F.regexp_extract(m, exempt + "(.*)$", 1)).otherwise(F.regexp_extract(m, region, 1))
        has = m.rlike(exempt) | m.rlike(region)
        r2 = F.when(has & r1_text.rlike(region), F.length(m) - F.length(F.regexp_extract(r1_text, region, 1))).otherwise(F.length(m))
        return F.struct(m.alias("w"), F.when(has, F.length(m) - F.length(r1_text)).otherwise(F.length(m)).alias("r1"), r2.alias("r2"))

    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"(?<=[{v}])y", "Y")
    out = F.lower(_let(_let(marked, regions), steps))
    for irregular, stem in EN_IRREGULAR.items():
        out = F.when(word == irregular, stem).otherwise(out)
    return F.when(F.length(word) <= 2, word).otherwise(out)


def stem(word: Column) -> Column:
    """Of a word with a Cyrillic letter the Russian stem, of any other the English one. All English rules are on endings of Latin letters and
    apostrophes, so a word with another one, as a number, is its own stem."""
    return F.when(word.rlike("[а-яё]"), russian_stem(F.translate(word, "ё", "е"))).when(word.rlike("[A-Za-z']$"), english_stem(word)).otherwise(word)


def stems(name: Column) -> Column:
    """The stems of the words of a name or text, in order."""
    return F.transform(F.filter(words_of_name(name), lambda w: w != ""), stem)
