"""Quality rules: an ordered decision list learned by sequential covering.

Each text is described by counts. Rules for low quality are grown one at a time, a threshold
condition after the other, on two thirds of the labelled statistics, pruned from the end on the
rest, and kept while they are right often enough. The list becomes one ordered Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_sample, over_batches, table, text_of

TRAIN_ROWS = 4000  # labelled rows that rules are learned from, at most
BLANKS = bytes([9, 10, 11, 12, 13, 32])
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]
#: What conditions may be on: shares that don't depend on the length of a text.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three that is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) > 1 << 20:  # three numbers no longer fit one
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * len(ids) + a[2:]
    order = np.argsort(triple, kind="stable")
    same = np.diff(triple[order]) == 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics_of(text: str) -> tuple[int, ...]:
    """The COUNTS of one whole text. Words are runs without ASCII white space; lines end at \\n and count if they have a word."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    count = lambda chars: len(data) - len(data.translate(None, chars))
    return (
        len(words), len(text) - count(BLANKS), count(b"#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"0123456789"), count(b"!?;:.,"),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS), one row per row of docs; a null text has no words. Columns other than doc_id and text are ignored."""

    def make(batch: pa.RecordBatch) -> dict:
        rows = np.array([statistics_of(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
        return {"doc_id": batch.column(0)} | {c: pa.array(rows[:, k]) for k, c in enumerate(COUNTS)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs.select("doc_id", text_of(docs).alias("text")), make, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] < self.threshold

    def column(self) -> Column:
        a, b = FEATURES[self.feature]
        share = F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
        return share >= self.threshold if self.at_least else share < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def shares(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f: np.where(counts[b] > 0, counts[a] / np.maximum(counts[b], 1), 0.0) for f, (a, b) in FEATURES.items()}


def _covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    at = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        at &= c.holds(x)
    return at


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> Rule:
    """Adds the condition with the largest information gain until only low quality is covered."""
    rule: Rule = ()
    at = np.ones(len(bad), bool)
    while len(rule) < longest and at.any() and not bad[at].all():
        p0, n0 = bad[at].sum(), at.sum()
        base, best = np.log2(max(p0, 1e-9) / n0), (1e-6, None)
        for f, v in x.items():
            cuts = np.unique(np.quantile(v[at], np.linspace(0.01, 0.99, 99)))
            order = np.sort(v[at & bad]), np.sort(v[at])
            below = np.searchsorted(order[0], cuts), np.searchsorted(order[1], cuts)
            for more in (True, False):
                p, n = (p0 - below[0], n0 - below[1]) if more else below
                gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(n, 1)) - base)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Condition(f, more, float(cuts[k])))
        if best[1] is None:
            break
        rule += (best[1],)
        at &= best[1].holds(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    at = _covered(rule, x)
    return (bad[at].sum() - (~bad[at]).sum()) / max(1, at.sum())


def learn_rules(counts: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, longest: int = 4, most: int = 12) -> list[Rule]:
    """Rules in order; each covers low quality with at least the given precision among all rows that no earlier rule covers."""
    x = shares(counts)
    left = np.ones(len(bad), bool)
    prune = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < most and bad[left].sum() >= 3:
        grow, check = ({f: v[left & m] for f, v in x.items()} for m in (~prune, prune))
        rule = _grow(grow, bad[left & ~prune], longest)
        while len(rule) > 1 and _worth(rule[:-1], check, bad[left & prune]) >= _worth(rule, check, bad[left & prune]):
            rule = rule[:-1]
        at = _covered(rule, x) & left
        if not rule or at.sum() < 3 or bad[at].mean() < precision:
            break
        rules.append(rule)
        left &= ~at
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1, or 0: an ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from at most `rows` labelled documents, chosen by a hash of doc_id; a document labelled
    twice counts by its larger label. Without labels there are no rules, and all is kept."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    some = bounded_sample(marks, F.col("doc_id"), rows)
    stats = statistics(docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi"))
    got = stats.join(some, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).toPandas()
    return learn_rules({c: got[c].to_numpy(np.int64) for c in COUNTS}, got["y"].to_numpy() == 0) if len(got) else []


def quality_verdicts(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, *COUNTS, base_failed, rule, kept), one row per row of docs; rule is the first that held, 0 for none."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = statistics(docs).withColumn("base_failed", base).withColumn("rule", verdict(rules))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_verdicts(docs, learn(docs, table(spark, sf_dir, "labels"))).drop("n_lines", "n_upper", "n_digits", "n_marks")
