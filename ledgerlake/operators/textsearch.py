"""Known names and numbers in free text: folding with the places it came from, word boundaries, overlaps, one pass whatever the dictionary's size.

A text is folded to the form in which names are compared, with an array of where each folded character stood, so that a find is cut
out of the text as it was written. All names are looked for at once by an automaton, in time that grows with the text and the
finds, not with the names. Finds that overlap are one group and are replaced together, so none of them leaves a piece behind.

The search runs over Arrow batches inside the rows. Names beyond PART are not held by any task: what stands in the texts between word boundaries, and a
map of digests of fixed size lets through, is joined with them. So are numbers beyond PART, with the windows of their lengths in the texts' runs of digits.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlake.functions import tokens
from ledgerlake.sources.tables import kept

# Letters of Latin and Cyrillic that look alike, invisible characters that stand inside words, the shapes of a
# passport's number and the words that confirm the second one, and the digits from which on a document's number counts anywhere.
LOOK_ALIKE = frozenset("aceopxyасеорху")
INSIDE_WORDS = frozenset("\u00ad\u2060\u200d\ufeff")
WHOLE_DOC = 10
DIGIT_RUN = re.compile(r"[0-9][0-9\s\-./()\\]*(?:(?<=\\)n[0-9\s\-./()\\]*)*[0-9]")
PASSPORT_SPACED = re.compile(r"(?<![0-9\-./])[0-9]{2}[\s.\-]?[0-9]{2}(?:\s|\\n)+[0-9]{6}(?![0-9\-./]?[0-9])")
PASSPORT_JOINED = re.compile(r"(?<![0-9\-./])[0-9]{4}-?[0-9]{6}(?![0-9\-./]?[0-9])")
PASSPORT_WORD, PASSPORT_NEAR = re.compile(r"пасп|удостовер", re.IGNORECASE), 40
GUID_IN_TEXT = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"

#: Names or numbers of one part, and their characters; a part is held by each task.
PART, PART_CHARACTERS = 50_000, 2_000_000
#: Bits of the map of digests, whatever the number of names or numbers: 16 MB in 512 rows and more.
MAP_BITS = 27
#: Rows that are searched together, so that what is made of a batch stays small beside it.
BATCH_ROWS = 512
#: Texts of at most SHORT characters are masked once as long as they are among the last MADE.
SHORT, MADE = 200, 1 << 14

_TOKEN = re.compile(tokens.TOKEN)
_BLANK = re.compile(f"{tokens.TOKEN}|{GUID_IN_TEXT}")
_FOLD = str.maketrans(tokens.QUOTES, tokens.FOLDED)
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+")
_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"[0-9]+")


def blanked(text: str) -> str:
    """text with each token and GUID as NULs of the same length: places stay and nothing is found in them."""
    if text.count("-") < 4:  # no GUID
        return _TOKEN.sub(lambda m: "\0" * len(m[0]), text) if "[[" in text else text
    return _BLANK.sub(lambda m: "\0" * len(m[0]), text)


@lru_cache(maxsize=1 << 16)
def _gap(c: str) -> int:
    """1 for white space, 2 for an invisible format character, else 0."""
    return 1 if c.isspace() else 2 if unicodedata.category(c) == "Cf" else 0


@lru_cache(maxsize=1)
def _gaps() -> re.Pattern:
    """Runs of white space and invisible format characters."""
    hidden = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cf")
    return re.compile(rf"[\s{re.escape(hidden)}]+")


@dataclass(slots=True)
class Folded:
    """Folded text; character k stood at [starts[k], stops[k]) of the text, at [k, k + 1) where starts is None."""

    text: str
    source: str
    starts: np.ndarray | None = None
    stops: np.ndarray | None = None

    def place(self, a: int, b: int) -> tuple[int, int]:
        """Where the folded characters [a, b) stood."""
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.stops[b - 1]))

    def between(self, k: int) -> str:
        """What folding has dropped before character k."""
        return "" if self.starts is None else self.source[self.stops[k - 1] : self.starts[k]]


def _decoded(text: str) -> Iterator[tuple[str, int, int]]:
    """(character, start, stop), with percent escapes of whole UTF-8 and \\u escapes read as what they stand for."""
    at = 0
    for m in _ESCAPES.finditer(text):
        yield from ((c, k, k + 1) for k, c in enumerate(text[at : m.start()], at))
        at = m.start()
        width = 3 if m[0][0] == "%" else 6
        try:
            if width == 3:
                plain, size = bytes.fromhex(m[0].replace("%", "")).decode(), lambda c: len(c.encode())
            else:
                plain, size = bytes.fromhex(m[0].replace("\\u", "")).decode("utf-16-be"), lambda c: len(c.encode("utf-16-be")) // 2
        except UnicodeDecodeError:
            plain, width, size = m[0], 1, len
        for c in plain:
            stop = at + width * size(c)
            yield c, at, stop
            at = stop
    yield from ((c, k, k + 1) for k, c in enumerate(text[at:], at))


def fold(text: str) -> Folded:
    """Quotes and ё folded, lower case, runs of white space as one space, invisible characters dropped, escapes decoded. A character whose lower
    case is longer than itself stays as it is."""
    plain = text.translate(_FOLD).lower()
    escaped = "%" in text or "\\u" in text
    if len(plain) == len(text) and not escaped:
        # what stands between runs of white space and invisible characters keeps its order: whole stretches at a time
        pieces, places, at = [], [], 0
        for m in _gaps().finditer(plain):
            if m[0] == " ":
                continue
            pieces.append(plain[at : m.start()])
            places.append((at, m.start()))
            at = m.end()
            if any(_gap(c) == 1 for c in m[0]):
                pieces.append(" ")
                places.append((m.start(), m.end()))
        if not places:
            return Folded(plain, text)
        pieces.append(plain[at:])
        places.append((at, len(plain)))
        spread = lambda p, x, first: np.arange(x[0] + 1 - first, x[1] + 1 - first) if len(p) == x[1] - x[0] else np.array([x[0] if first else x[1]])
        return Folded("".join(pieces), text, *(np.concatenate([spread(p, x, first) for p, x in zip(pieces, places)]) for first in (True, False)))
    out, starts, stops = [], [], []
    run: tuple[int, int, bool] | None = None
    for c, a, b in _decoded(text) if escaped else zip(text, range(len(text)), range(1, len(text) + 1)):
        kind = _gap(c)
        if kind:
            run = (run[0] if run else a, b, kind == 1 or bool(run and run[2]))
            continue
        if run and run[2]:
            out.append(" ")
            starts.append(run[0])
            stops.append(run[1])
        run = None
        low = c.translate(_FOLD).lower()
        out.append(low if len(low) == 1 else c)
        starts.append(a)
        stops.append(b)
    if run and run[2]:
        out.append(" ")
        starts.append(run[0])
        stops.append(run[1])
    return Folded("".join(out), text, np.array(starts, np.int64), np.array(stops, np.int64))


@lru_cache(maxsize=1 << 16)
def _sort(c: str) -> str:
    """What a character is to a word: its script, `digit`, `mark` or nothing. Modifier letters are used as apostrophes and are nothing."""
    category = unicodedata.category(c)
    if c.isalpha() and category != "Lm":
        return unicodedata.name(c, "").partition(" ")[0] or "letter"
    return "digit" if c.isdigit() else "mark" if category in ("Mn", "Me") else ""


def one_word(edge: str, beside: str) -> bool:
    """Whether a find's last character and the one beside it are of one word or number: letters of one script or one that looks
    like the other's, a letter and its accent, digits."""
    a, b = _sort(edge), _sort(beside)
    if a == "digit" or b == "digit":
        return a == b
    if not a or not b or a == "mark":
        return False
    return a == b or b == "mark" or beside in LOOK_ALIKE


def cuts_left(folded: Folded, a: int) -> bool:
    """Whether what begins at a begins inside a word. An invisible character that was dropped there parts words, unless it is one of those
    that stand inside words."""
    text = folded.text
    return a > 0 and one_word(text[a], text[a - 1]) and INSIDE_WORDS.issuperset(folded.between(a))


def cuts_right(folded: Folded, b: int) -> bool:
    """Whether what ends before b ends inside a word."""
    text = folded.text
    return b < len(text) and one_word(text[b - 1], text[b]) and INSIDE_WORDS.issuperset(folded.between(b))


def cuts_word(folded: Folded, a: int, b: int) -> bool:
    """Whether [a, b) ends or begins inside a word."""
    return cuts_left(folded, a) or cuts_right(folded, b)


def groups(finds: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, stop, tokens) of the finds (start, stop, token): those that overlap are one group. Its tokens are the one of a find that
    covers it, else those of all finds that lie in no other, in order, equal neighbours once. Finds that only touch are apart."""
    out: list[tuple[int, int, str]] = []
    reach, last = -1, ""
    for start, stop, token in sorted(finds, key=lambda x: (x[0], -x[1])):
        if start >= reach:
            out.append((start, stop, token))
            reach, last = stop, token
        elif stop > reach:  # in no other, as all before it begin no later and end before it
            a, _, before = out[-1]
            out[-1] = (a, stop, before if token == last else before + token)
            reach, last = stop, token
    return out


def leftmost(finds: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """From the left the longest find that starts at a place, of equal ones the smallest token, then the next after its end."""
    out: list[tuple[int, int, str]] = []
    for x in sorted(finds, key=lambda x: (x[0], -x[1], x[2])):
        if not out or out[-1][1] <= x[0]:
            out.append(x)
    return out


def replaced(text: str, finds: list[tuple[int, int, str]]) -> str:
    """text with what stands at each of finds, in order and without overlaps, replaced."""
    parts, at = [], 0
    for start, stop, token in finds:
        parts += (text[at:start], token)
        at = stop
    return "".join((*parts, text[at:])) if parts else text


@dataclass(frozen=True)
class Book:
    """One part of a dictionary: names (spelling, token) with their mode, or numbers digits -> (token, kind)."""

    names: tuple[tuple[str, str], ...] = ()
    numbers: dict[str, tuple[str, str]] = field(default_factory=dict)
    words: bool = False  # names are runs of words, whatever stands between them
    digest: str = ""


_searches: dict[str, Search] = {}


class Search:
    """The automaton of a book. Each Python worker builds it once and keeps the last few."""

    def __init__(self, book: Book) -> None:
        self.words, self.numbers = book.words, book.numbers
        self.made: dict[str, str] = {}
        self.lengths = sorted({len(d) for d in book.numbers if d})
        known: dict[str, str] = {}
        for spelling, token in book.names:
            form = f" {' '.join(_WORD.findall(spelling.translate(_FOLD).lower()))} " if self.words else fold(spelling).text.strip()
            if form.strip() and "\0" not in form:
                known[form] = min(token, known.get(form, token))
        self.forms, self.tokens = list(known), list(known.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, form in enumerate(self.forms):
            self.automaton.add_word(form, k)
        if self.forms:
            self.automaton.make_automaton()

    @staticmethod
    def of(book: Book) -> Search:
        if book.digest not in _searches:
            while len(_searches) >= 3:
                _searches.pop(next(iter(_searches)))
            _searches[book.digest] = Search(book)
        return _searches[book.digest]

    def name_finds(self, text: str) -> list[tuple[int, int, str]]:
        """(start, stop, token) of all names, overlapping ones too, in no order."""
        if not self.forms or not text:
            return []
        if self.words:
            spots = [(m.start(), m.end()) for m in _WORD.finditer(text)]
            words = [text[a:b].translate(_FOLD).lower() for a, b in spots]
            at = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()  # of the blank before each word
            place = {p: k for k, p in enumerate(at)}
            hits = ((end + 1 - len(self.forms[k]), end, k) for end, k in self.automaton.iter(f" {' '.join(words)} "))
            return [(spots[place[a]][0], spots[place[z] - 1][1], self.tokens[k]) for a, z, k in hits]
        folded = fold(blanked(text))
        found = []
        for end, k in self.automaton.iter(folded.text):
            a, b = end + 1 - len(self.forms[k]), end + 1
            if not cuts_word(folded, a, b):
                found.append((*folded.place(a, b), self.tokens[k]))
        return found

    def word_counts(self, text: str) -> dict[int, int]:
        """How often each form stands in a text, by its place in forms; for books of words."""
        words = _WORD.findall(text.translate(_FOLD).lower())
        counts: dict[int, int] = {}
        for _, k in self.automaton.iter(f" {' '.join(words)} ") if words and self.forms else ():
            counts[k] = counts.get(k, 0) + 1
        return counts

    def number_finds(self, text: str) -> list[tuple[int, int, str]]:
        """(start, stop, token) of all numbers, see number_windows()."""
        if not self.lengths or not text:
            return []
        found = ((a, z, self.numbers[x], sure) for a, z, x, sure in number_windows(text, self.lengths, self.numbers.__contains__))
        return [(a, z, token) for a, z, (token, kind), sure in found if sure or kind != "doc"]

    def masked(self, text: str) -> str:
        """text with its known numbers replaced, from the left, and then the groups of its known names. What is a token as a whole stays."""
        if _TOKEN.fullmatch(text):
            return text
        if len(text) > SHORT:
            return self._masked(text)
        if (made := self.made.get(text)) is None:
            if len(self.made) >= MADE:
                self.made.clear()
            made = self.made[text] = self._masked(text)
        return made

    def _masked(self, text: str) -> str:
        text = replaced(text, leftmost(self.number_finds(text)))
        return replaced(text, groups(self.name_finds(text)))


def number_windows(text: str, lengths: list[int], has: Callable[[str], bool]) -> list[tuple[int, int, str, bool]]:
    """(start, stop, digits, sure) of the windows of the lengths over a run's digits, whatever stands between them, that `has` lets through. One that
    isn't sure is no document's number: such a one shorter than WHOLE_DOC has to be a whole run or to stand in a passport's shape."""
    found, ends = [], None
    text = blanked(text)
    for run in DIGIT_RUN.finditer(text):
        digits, spots = "".join(_DIGITS.findall(run[0])), None
        for n in lengths:
            for o in range(len(digits) - n + 1):
                if not has(x := digits[o : o + n]):
                    continue
                spots = spots or [k for k in range(run.start(), run.end()) if "0" <= text[k] <= "9"]
                stop = spots[o + n - 1] + 1
                sure = n >= WHOLE_DOC or n == len(digits)
                if not sure and n == 6:
                    ends = _passport_ends(text) if ends is None else ends
                    sure = stop in ends
                found.append((spots[o], stop, x, sure))
    return found


def _passport_ends(text: str) -> set[int]:
    joined = (m for m in PASSPORT_JOINED.finditer(text) if PASSPORT_WORD.search(text, max(0, m.start() - PASSPORT_NEAR), m.start()))
    return {m.end() for m in PASSPORT_SPACED.finditer(text)} | {m.end() for m in joined}


def map_of(strings: DataFrame) -> bytes:
    """A map of MAP_BITS bits with those of the digests of strings (x) set."""
    place = F.shiftright(F.crc32(F.col("x").cast("binary")), 32 - MAP_BITS) + 1  # Spark's bitmaps count from 1
    places = strings.select(place.alias("p"))
    bits = bytearray(1 << (MAP_BITS - 3))
    for bucket, part in places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p"))).collect():
        bits[(bucket - 1) * len(part) : bucket * len(part)] = part
    return bytes(bits)


def may_be_in(bits: bytes) -> Callable[[str], int]:
    """A function that gives 0 for strings that the map of map_of() can't have."""

    def maybe(x: str) -> int:
        at = zlib.crc32(x.encode()) >> (32 - MAP_BITS)
        return bits[at >> 3] >> (at & 7) & 1

    return maybe


@dataclass(frozen=True)
class Forms:
    """Names that no task holds: rows (form, token), the lengths of forms by the length of their prefix, and a map of the digests of forms and prefixes. A
    prefix has as many characters (words: words) as the largest power of two that its form has."""

    rows: DataFrame
    lengths: dict[int, list[int]]
    bits: bytes
    words: bool = False
    names: bool = True
    numbers: bool = False

    @staticmethod
    def of(names: DataFrame, words: bool) -> Forms:
        """From names (spelling, token), each spelling once. Of names with one form the smallest token counts."""

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for spelling, token in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _WORD.findall(spelling.translate(_FOLD).lower()) if words else fold(spelling).text.strip()
                if found and "\0" not in found:
                    size = 1 << (len(found).bit_length() - 1)
                    join = " ".join if words else str
                    out.append((join(found), token, len(found), join(found[:size])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, (pa.string(), pa.string(), pa.int32(), pa.string()))], ["form", "token", "n", "prefix"])

        rows = over_texts(names.select("spelling", "token"), make, "form string, token string, n int, prefix string")
        rows = kept(rows.groupBy("form").agg(F.min("token").alias("token"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))
        lengths: dict[int, list[int]] = {}
        for (n,) in sorted(rows.select("n").distinct().collect()):  # no more than the longest name has characters
            lengths.setdefault(1 << (n.bit_length() - 1), []).append(n)
        bits = map_of(rows.select(F.explode(F.array("form", "prefix")).alias("x")))
        return Forms(rows.select("form", "token"), lengths, bits, words)

    def finder(self) -> Callable[[str], Iterator[tuple[int, int, str]]]:
        """A function that gives (start, stop, form) of what stands in a text between boundaries and may be a form."""
        lengths, maybe = self.lengths, may_be_in(self.bits)

        def runs(text: str) -> Iterator[tuple[int, int, str]]:
            spots = [(m.start(), m.end()) for m in _WORD.finditer(text)]
            words = [text[a:b].translate(_FOLD).lower() for a, b in spots]
            for a in range(len(words)):
                for size in lengths:
                    if a + size > len(words):
                        break
                    if maybe(" ".join(words[a : a + size])):
                        for n in lengths[size]:
                            if a + n <= len(words) and maybe(x := " ".join(words[a : a + n])):
                                yield spots[a][0], spots[a + n - 1][1], x

        def names(text: str) -> Iterator[tuple[int, int, str]]:
            folded = fold(blanked(text))
            plain = folded.text
            for a in range(len(plain)):
                if plain[a] in " \0" or cuts_left(folded, a):
                    continue
                for size in lengths:
                    if a + size > len(plain):
                        break
                    if maybe(plain[a : a + size]):
                        for n in lengths[size]:
                            if a + n <= len(plain) and maybe(x := plain[a : a + n]) and not cuts_right(folded, a + n):
                                yield *folded.place(a, a + n), x

        return runs if self.words else names


@dataclass(frozen=True)
class Numbers:
    """Numbers that no task holds: rows (digits, token, kind), each digits once, their lengths, and a map of their digests."""

    rows: DataFrame
    lengths: list[int]
    bits: bytes
    names: bool = False
    numbers: bool = True

    @staticmethod
    def of(numbers: DataFrame) -> Numbers:
        """From numbers (digits, token, kind), which are worked out already."""
        lengths = sorted(n for (n,) in numbers.select(F.length("digits")).distinct().collect())  # no more than the longest number has digits
        return Numbers(numbers, lengths, map_of(numbers.select(F.col("digits").alias("x"))))

    def finder(self) -> Callable[[str], list[tuple[int, int, str, bool]]]:
        """A function that gives number_windows() of a text that may be numbers."""
        lengths, maybe = self.lengths, may_be_in(self.bits)
        return lambda text: number_windows(text, lengths, maybe)


def parts_of(rows: DataFrame, length: str, most: int = PART) -> int:
    """In how many parts rows, whose characters are in the column `length`, are held: each has `most` rows and PART_CHARACTERS on average at most."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length(length)), F.lit(0))).first()
    return max(1, -(-n // max(1, most)), -(-size // PART_CHARACTERS))


def books(names: DataFrame | None = None, numbers: DataFrame | None = None, words: bool = False, most: int = PART) -> list[Book | Forms | Numbers]:
    """Parts of a dictionary: names (spelling, token), of which one with two tokens is left out, and numbers (kind, token, digits), of which equal digits
    have the smallest token. With one part of each, both are in one book. More names or numbers than a part has are left where they are, as Forms or Numbers."""
    found: list[Book | Forms | Numbers] = []
    if names is not None:
        single = names.groupBy("spelling").agg(F.min("token").alias("token"), F.count_distinct("token").alias("__n")).where("__n = 1 and spelling is not null")
        single = kept(single.select("spelling", "token"))
        n = parts_of(single, "spelling", most)
        found.append(Forms.of(single, words) if n > 1 else Book(names=tuple((r[0], r[1]) for r in single.collect()), words=words))
    if numbers is not None:
        single = numbers.where("digits <> ''").groupBy("digits").agg(F.min(F.struct("token", "kind")).alias("__t")).select("digits", "__t.token", "__t.kind")
        single = kept(single)
        n = parts_of(single, "digits", most)
        found.append(Numbers.of(single) if n > 1 else Book(numbers={r[0]: (r[1], r[2]) for r in single.collect()}))
    if len(found) == 2 and all(isinstance(x, Book) for x in found):
        found = [Book(found[0].names, found[1].numbers, words)]
    return [Book(b.names, b.numbers, b.words, hashlib.sha256(repr((sorted(b.names), sorted(b.numbers.items()), b.words)).encode()).hexdigest()) if isinstance(b, Book) else b for b in found]


def over_texts(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow of a function from a batch of at most BATCH_ROWS rows to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                if (out := make(batch.slice(at, BATCH_ROWS))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def _dealt(texts: DataFrame, key: str) -> DataFrame:
    """texts dealt out by their key, so that searching them and bringing finds back to them read what one exchange has moved."""
    spark = texts.sparkSession
    return texts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), F.col(key))


def _met(texts: DataFrame, key: str, text: str, known: Forms | Numbers, more: str) -> DataFrame:
    """(key, start, stop, what else the finder gives, token): where forms or numbers, the first of the rest, stand in texts."""
    kind = texts.schema[key].dataType.simpleString()
    find = known.finder()
    plain = StructType.fromDDL(f"start int, stop int, {more}")
    types = to_arrow_schema(plain).types

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, out = [], []
        for k, x in enumerate(batch.column(1).to_pylist()):
            if x and (hits := list(find(x))):
                at += [k] * len(hits)
                out += hits
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * len(types), types)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], [key, *plain.names])

    return over_texts(_dealt(texts.select(key, text), key), make, f"`{key}` {kind}, start int, stop int, {more}").join(known.rows, plain.names[2])


def finds(texts: DataFrame, key: str, text: str, parts: list[Book | Forms | Numbers]) -> DataFrame:
    """(key, start, stop, token): where the names and numbers of all parts stand in texts, overlapping ones too. Null texts have none."""
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start int, stop int, token string"

    def of(book: Book | Forms | Numbers) -> DataFrame:
        if isinstance(book, Forms):
            return _met(texts, key, text, book, "form string").select(key, "start", "stop", "token")
        if isinstance(book, Numbers):
            return _met(texts, key, text, book, "digits string, sure boolean").where("sure or kind <> 'doc'").select(key, "start", "stop", "token")

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            search, at, out = Search.of(book), [], []
            for k, x in enumerate(batch.column(1).to_pylist()):
                hits = search.number_finds(x) + search.name_finds(x) if x else []
                at += [k] * len(hits)
                out += hits
            columns = [pa.array([h[c] for h in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], [key, "start", "stop", "token"])

        return over_texts(texts.select(key, text), make, schema)

    found = None
    for book in parts:
        found = of(book) if found is None else found.unionByName(of(book))
    return found if found is not None else texts.sparkSession.createDataFrame([], schema)


def replace_finds(texts: DataFrame, key: str, text: str, found: DataFrame, pick: Callable[[list], list] = groups) -> DataFrame:
    """texts with the finds (key, start, stop, token) that pick takes replaced by their tokens. key tells rows apart; null texts stay null."""
    per = found.groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct("start", "stop", "token")).alias("__finds"))
    joined = _dealt(texts, key).join(per, F.col(key) == F.col("__key"), "left").select(*(F.col(f"`{c}`") for c in texts.columns), "__finds")
    names = texts.columns
    at = names.index(text)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits, columns = batch.column(len(names)), list(batch.columns[: len(names)])
        if hits.null_count < len(hits):  # rows without finds stay as they are
            with_finds = hits.is_valid()
            rows = hits.filter(with_finds)
            marks = list(zip(*(c.to_pylist() for c in rows.flatten().flatten())))
            ends = np.cumsum(pc.list_value_length(rows).to_numpy()).tolist()
            made = [replaced(x, pick(marks[a:z])) for x, a, z in zip(columns[at].filter(with_finds).to_pylist(), [0, *ends], ends)]
            columns[at] = pc.replace_with_mask(columns[at], with_finds, pa.array(made, columns[at].type))
        return pa.RecordBatch.from_arrays(columns, names)

    return over_texts(joined, make, texts.schema)


def replace_known(texts: DataFrame, key: str, text: str, parts: list[Book | Forms | Numbers], pick: Callable[[list], list]) -> DataFrame:
    """texts with the finds of all parts that pick takes replaced. One part is searched for and replaced inside the row; of several the
    finds meet by key, which tells rows apart."""
    if len(parts) != 1 or not isinstance(parts[0], Book):
        return replace_finds(texts, key, text, finds(texts, key, text, parts), pick)
    book, names = parts[0], texts.columns
    at = names.index(text)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        search = Search.of(book)
        out = [replaced(x, pick(search.number_finds(x) + search.name_finds(x))) if x else x for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names)

    return over_texts(texts, make, texts.schema)


def phrase_counts(texts: DataFrame, key: str, text: str, parts: list[Book | Forms]) -> DataFrame:
    """(key, phrase, hits): how often the phrases of books of words stand in each text; a phrase is named by its token."""
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, phrase string, hits long"

    def of(book: Book | Forms) -> DataFrame:
        if isinstance(book, Forms):
            return _met(texts, key, text, book, "form string").select(key, F.col("token").alias("phrase"), F.lit(1).cast("long").alias("hits"))

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            search, at, phrases, hits = Search.of(book), [], [], []
            for k, x in enumerate(batch.column(1).to_pylist()):
                for form, n in search.word_counts(x).items() if x else ():
                    at.append(k)
                    phrases.append(search.tokens[form])
                    hits.append(n)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(phrases, pa.string()), pa.array(hits, pa.int64())], [key, "phrase", "hits"])

        return over_texts(texts.select(key, text), make, schema)

    found = of(parts[0])
    for book in parts[1:]:
        found = found.unionByName(of(book))
    return found.groupBy(key, "phrase").agg(F.sum("hits").alias("hits"))
