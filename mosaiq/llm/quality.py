"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

A rule looks at one text and says whether to reject it. On a sample of the table the workers
measure each rule's time per text, beyond what is worked out already, and what it rejects. The
cascade takes the rule of most rejections per second first, then the one of most among the texts
that are left, and so on, and stops at the first that rejects. A text is rejected if any rule
rejects it, so the order changes the time alone, never a verdict.

Where labelled documents are given, one more rule is learned from them: the word beginnings that
toxic texts hold far more often than others, whatever the language.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import id_text

#: At most so many texts are timed; the bound concerns the order of the rules only.
SAMPLE_ROWS = 400
SAMPLE_ONE_IN = 16

#: At most so many labelled rows, those of least hash, are learned from; they are broadcast.
TRAIN_LABELS = 100_000
#: Fewer toxic texts teach nothing.
MIN_TOXIC = 20
#: Letters of a word's beginning, toxic texts that must hold it, and how many times as frequent it must be in them.
STEM, STEM_TEXTS, STEM_RATIO = 5, 4, 10
#: Beginnings that are kept at most, the most widely held ones.
LEXICON = 1000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
#: English insults.
ABUSIVE = frozenset(["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"])
_LETTERS = re.compile(r"[^\W\d_]{%d,}" % STEM)
_ABUSIVE = re.compile(r"\b(?:" + "|".join(sorted(ABUSIVE)) + r")\b", re.IGNORECASE)


class Text:
    """One text and what the rules have worked out about it so far."""

    __slots__ = ("text", "words", "_repeat", "_lines", "_symbols")

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = _WORD.findall(self.text)
        self._repeat = self._lines = self._symbols = None

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @property
    def n_symbols(self) -> int:
        if self._symbols is None:
            self._symbols = len(_SYMBOL.findall(self.text))
        return self._symbols

    @property
    def n_dup_lines(self) -> int:
        return self.lines[0] - self.lines[1]

    @property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and how many different ones."""
        if self._lines is None:
            lines = [x for x in self.text.split("\n") if _WORD.search(x)]
            self._lines = len(lines), len(set(lines))
        return self._lines

    @property
    def n_repeat_words(self) -> int:
        if self._repeat is None:
            w = self.words
            windows = list(zip(w, w[1:], w[2:]))
            self._repeat = 0
            if len(set(windows)) != len(windows):
                count, covered = Counter(windows), 0
                for i, x in enumerate(windows):
                    if count[x] > 1:
                        self._repeat += i + 3 - max(i, covered)
                        covered = i + 3
        return self._repeat


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def base_failed(t: Text) -> bool:
    return t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words


def _long_run(t: Text) -> bool:
    """One word repeated over and over."""
    return any(sum(1 for _ in run) > 20 for _, run in groupby(t.words))


#: Production rules beside the base; each leaves prose of any language alone.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 2 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.lines[0]),
    Rule("word_length", lambda t: t.n_words > 0 and not 2 * t.n_words <= t.word_chars <= 12 * t.n_words),
    Rule("shouting", lambda t: 10 * t.text.count("!") > 5 * t.n_words),
    Rule("letters", lambda t: 10 * sum(any(map(str.isalpha, w)) for w in t.words) < 7 * t.n_words),
    Rule("one_word", _long_run),
    Rule("abusive", lambda t: (hits := len(_ABUSIVE.findall(t.text))) >= 3 and 250 * hits >= t.n_words),
)
BASE_RULES = (
    Rule("short", lambda t: t.n_words < 50),
    Rule("repetition", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)


def learned_stems(docs: DataFrame, labels: DataFrame) -> list[str]:
    """Word beginnings that mark toxic texts, from labels (doc_id, toxic 0 or 1); at most LEXICON.

    Equal texts count once. Rows without id, text or label are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(TRAIN_LABELS)
    texts = id_text(docs).where("text is not null").join(F.broadcast(known), "doc_id").select(F.sha2("text", 256).alias("of"), "toxic", "text")
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{%d,})" % STEM)))
    held = texts.dropDuplicates(["of", "toxic"]).select("of", "toxic", word.alias("word")).groupBy("of", "toxic", F.substring("word", 1, STEM).alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    held = common.cut(held, "stems")
    t = F.col("toxic") == 1
    total = held.agg(F.sum(F.when(t, F.col("n"))).alias("toxic"), F.sum(F.when(~t, F.col("n"))).alias("clean"), F.count_distinct(F.when(t, F.col("of"))).alias("texts")).first()
    if total.texts < MIN_TOXIC or not total.clean:
        return []
    stems = held.groupBy("stem").agg(F.count_if(t).alias("texts"), F.sum(F.when(t, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(t, 0).otherwise(F.col("n"))).alias("b"))
    stems = stems.where((F.col("texts") >= STEM_TEXTS) & (F.col("a") * total.clean >= STEM_RATIO * (F.col("b") + 1) * total.toxic))
    return [r.stem for r in stems.orderBy(F.desc("texts"), "stem").limit(LEXICON).collect()]


def toxic_rule(stems: list[str]) -> Rule:
    """Rejects texts of two or more words that begin so, if they are one in a hundred at least."""
    known = frozenset(stems)

    def rejects(t: Text) -> bool:
        hits = sum(w[:STEM] in known for w in _LETTERS.findall(t.text.lower()))
        return hits >= 2 and 100 * hits >= t.n_words

    return Rule("toxic", rejects)


def _sampled(docs: DataFrame, rows: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_ONE_IN)) == 0
    return id_text(docs).where(bucket).limit(rows).select("text")


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str | None]:
    """A bounded sample of texts, from the rows whose id hashes to one bucket."""
    return [r.text for r in _sampled(docs, rows).collect()]


def _known(t: Text) -> None:
    """Works out what judge returns anyway."""
    _ = t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words


def measure(rules: tuple[Rule, ...], text: str | None, known: Callable[[Text], None] = lambda t: None) -> list[tuple[float, bool]]:
    """Seconds and verdict of each rule on one text of which only `known` is worked out."""
    out = []
    for rule in rules:
        t = Text(text)
        known(t)
        began = time.perf_counter()
        hit = bool(rule.rejects(t))
        out.append((time.perf_counter() - began, hit))
    return out


def arranged(rules: tuple[Rule, ...], measured: list[list[tuple[float, bool]]]) -> tuple[Rule, ...]:
    """The rules by rejections per second, each among the texts that those before it leave."""
    left, out, todo = list(measured), [], list(range(len(rules)))
    while todo and left:
        gain = {i: (sum(m[i][1] for m in left) + 0.01) / (sum(m[i][0] for m in left) + 1e-9) for i in todo}
        best = max(todo, key=lambda i: (gain[i], -i))
        out.append(best)
        todo.remove(best)
        left = [m for m in left if not m[best][1]]
    return tuple(rules[i] for i in out + todo)


def ordered(rules: tuple[Rule, ...], texts: list[str | None]) -> tuple[Rule, ...]:
    """The rules in the order that the texts suggest."""
    return arranged(rules, [measure(rules, x) for x in texts])


def _measure(rules: tuple[Rule, ...], known):
    def run(batches):
        for batch in batches:
            rows = [measure(rules, x, known) for x in batch.column("text").to_pylist()]
            kinds = pa.list_(pa.float64()), pa.list_(pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([[m[i] for m in r] for r in rows], k) for i, k in enumerate(kinds)], names=["seconds", "hits"])

    return run


def ordered_for(docs: DataFrame, rules: tuple[Rule, ...], known: Callable[[Text], None] = lambda t: None) -> tuple[Rule, ...]:
    """The rules in the order that a sample of docs suggests; the texts stay with the workers."""
    rows = _sampled(docs, SAMPLE_ROWS).mapInArrow(_measure(rules, known), "seconds array<double>, hits array<boolean>").collect()
    return arranged(rules, [list(zip(r.seconds, r.hits, strict=True)) for r in rows])


def _with_learned(docs: DataFrame, rules: tuple[Rule, ...], labels: DataFrame | None) -> tuple[Rule, ...]:
    stems = learned_stems(docs, labels) if labels is not None else []
    return (*rules, toxic_rule(stems)) if stems else rules


def rejected(t: Text, rules: tuple[Rule, ...]) -> bool:
    return any(rule.rejects(t) for rule in rules)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _judge(rules: tuple[Rule, ...]):
    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column("text").to_pylist():
                t = Text(x)
                failed = base_failed(t)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and not rejected(t, rules)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")]
            )

    return run


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """One row per row of docs with its base counts, base_failed and kept.

    With labels (doc_id, toxic) a rule learned from them joins the others. A null or empty text
    has no words, so it fails the base; a very long one is read whole. Repeated rows and null ids
    are judged like any other row; an empty table gives an empty result; further columns of docs
    are ignored, whatever their names.
    """
    common.prepare(docs.sparkSession)
    return id_text(docs).mapInArrow(_judge(ordered_for(docs, _with_learned(docs, rules, labels), _known)), SCHEMA)


def _keep(rules: tuple[Rule, ...]):
    def run(batches):
        for batch in batches:
            keep = [not rejected(Text(x), rules) for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, labels: DataFrame | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they are.

    With labels (doc_id, toxic) a rule learned from them joins the others. Null, empty and short
    texts go; very long ones are read whole. Repeated rows and null ids are judged like any other
    row; an empty table gives an empty result. Clashing names of columns do no harm.
    """
    common.prepare(docs.sparkSession)
    return docs.mapInArrow(_keep(ordered_for(docs, _with_learned(docs, rules, labels))), docs.schema)
