"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so a question asked with other
values has the same template. Windows of template words are hash-joined between benchmark and
documents. A document window and a benchmark window lie on a diagonal (the difference of their
positions); a diagonal counts if its slots are consistent, that is, if each benchmark value is
replaced by one value throughout (but for BROKEN_SLOTS). Every window also has a hash of its own case-folded words, which
depends on nothing else in the text: copies match by it whatever their case, and it is all that
windows of too few words outside placeholders match by. Names count as literal words in a third
hash, so changed numbers are found in copies whose case is lost. Values are compared as values:
"seven" is 7, "twenty-five" is 25. A diagonal may break with one in ten of its slots, whose
windows then do not count. The benchmark words that the consistent diagonals of a document cover
decide.

No window is left out. Those that many items have, such as a common instruction or the template of
a generated question, are matched once for all items that have the same of them: such a class gives
one row a document with its number of items, and the pairs of an item that any other window
meets are counted over all windows. Whether more than one kind of item has a window says only if it tells
one item from another, which is a column of the result.

Document windows pass a bitmap of fixed size first, built from the benchmark's window hashes by
a distributed or; it loses no match, and the exact join follows. So only windows that probably
match leave the Python workers, and nothing that grows with either table is broadcast by hand.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, process_cache, rolling

WINDOW = 8
#: Windows with fewer words outside placeholders are no evidence of other values in the same question.
MIN_LITERALS = 4
#: Windows of more items than this are matched by class; those of more kinds tell none of them. Items of one kind differ by their values only.
SHARED = 8
#: A document is contaminated by an item if it covers so many of its words, or such a share.
MIN_WORDS = 13
MIN_SHARE = 0.5
BITMAP_BITS = 1 << 24

#: Number words of English, German, French and Spanish (without articles), and units.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40,
    "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9,
    "null": 0, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "elf": 11, "zwölf": 12,
    "zwanzig": 20, "dreißig": 30, "vierzig": 40, "fünfzig": 50, "sechzig": 60, "siebzig": 70, "achtzig": 80, "neunzig": 90, "hundert": 100, "tausend": 1000,
    "zéro": 0, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11, "douze": 12,
    "vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60, "cent": 100, "mille": 1000,
    "cero": 0, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12,
    "veinte": 20, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90, "cien": 100, "mil": 1000,
}
UNITS = frozenset(
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound"
    " pounds ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year"
    " years cents dollar dollars euro euros percent degree degrees mph kmh meter meters metre metres kilometer kilometers"
    " meilen gramm kilogramm tonne tonnen sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre prozent"
    " mètre mètres kilomètre kilomètres gramme grammes tonnes secondes heure heures jour jours semaine semaines mois ans"
    " metro metros kilómetro kilómetros gramo gramos segundo segundos minuto minutos hora horas día días semana semanas mes meses años".split()
)
_SPECIAL = UNITS.union(NUMBER_WORDS)
_EDGE = re.compile(r"^\W+|\W+$")
_ASCII_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_")
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|€|£)?")
_GLUED = re.compile(r"([-+]?[$€£]?\d[\d.,]*)([A-Za-z]{1,10})")
_END = re.compile(r"[.!?:][\"')\]]*$")
LITERAL, NUMBER, UNIT, NAME = range(4)
#: Words whose classes are kept by a worker, and their characters together.
VOCABULARY, VOCABULARY_CHARS = 1 << 18, 1 << 24
#: A diagonal stands while no more than this share of its slots takes two values.
BROKEN_SLOTS = 0.1


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


_PLACEHOLDER = {NUMBER: _hash("<num>"), UNIT: _hash("<unit>"), NAME: _hash("<name>")}


def _number(word: str) -> int:
    """The hash of a number's value, however it is written."""
    low = word.casefold().lstrip("$€£").rstrip("%€£")
    if low in NUMBER_WORDS:
        return _hash(str(NUMBER_WORDS[low]))
    plain = low.replace(",", "") if re.fullmatch(r"[-+]?\d{1,3}(,\d{3})+(\.\d+)?", low) else low
    return _hash(re.sub(r"^\+?0*(?=\d)", "", plain.rstrip(".,:/")))


def _tens(low: str) -> int | None:
    """The value of a hyphened number word such as twenty-five."""
    ten, dash, one = low.partition("-")
    value, rest = NUMBER_WORDS.get(ten, 0), NUMBER_WORDS.get(one, 0)
    return value + rest if dash and 20 <= value <= 90 and 1 <= rest <= 9 else None


def _classify(raw: str) -> tuple:
    """(tokens, ends a sentence); a token is (kind, hash, hash if not a name)."""
    word = raw.strip(_ASCII_EDGE)
    if len(word) == len(raw):
        ends = False
    else:
        ends = bool(_END.search(raw))
    if not word.isalnum():
        word = _EDGE.sub("", word)
    low, letters = word.casefold(), word.isalpha()
    if low == word and letters and low not in _SPECIAL:
        return ((LITERAL, _hash(low), 0),), ends
    if not word:
        return (), ends
    if low in NUMBER_WORDS or not letters and _NUMBER.fullmatch(word):
        return ((NUMBER, _number(word), 0),), ends
    if "-" in low and (value := _tens(low)) is not None:
        return ((NUMBER, _hash(str(value)), 0),), ends
    glued = None if letters else _GLUED.fullmatch(word)
    if glued and glued[2].lower() in UNITS:
        return ((NUMBER, _number(glued[1]), 0), (UNIT, _hash(glued[2].lower()), 0)), ends
    if low in UNITS:
        return ((UNIT, _hash(low), 0),), ends
    if word[0].isupper() and any(map(str.islower, word)):
        return ((NAME, _hash(low), _hash(low)),), ends
    return ((LITERAL, _hash(low), 0),), ends


class _Vocabulary:
    """Codes of the words seen so far, and what they are as arrays indexed by code."""

    def __init__(self, size: int = 1 << 12):
        self.code: dict[str, int] = {}
        self.count, self.ends = np.ones(size, np.int64), np.zeros(size, bool)
        self.kinds, self.values = np.zeros((2, size), np.int8), np.zeros((2, size), np.uint64)
        self.chars = 0

    def codes(self, words: list[str]) -> np.ndarray:
        fresh = set(words).difference(self.code)
        if fresh:
            self._learn(fresh)
        return np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))

    def _learn(self, fresh: set[str]) -> None:
        """Words of small letters alone are literal as they stand; the others are looked at one by one."""
        start = len(self.code)
        while start + len(fresh) > len(self.count):
            self.count, self.ends = np.concatenate((self.count, np.ones_like(self.count))), np.concatenate((self.ends, np.zeros_like(self.ends)))
            self.kinds, self.values = np.tile(self.kinds, 2), np.tile(self.values, 2)
        plain = [w for w in fresh if w.isalpha() and w not in _SPECIAL and w.casefold() == w]
        middle, stop = start + len(plain), start + len(fresh)
        self.count[start:middle], self.ends[start:middle], self.kinds[:, start:middle] = 1, False, LITERAL
        self.values[0, start:middle] = [_hash(w) for w in plain]
        other = list(fresh.difference(plain))
        if other:
            found = [_classify(w) for w in other]
            self.count[middle:stop] = [len(tokens) for tokens, _ in found]
            self.ends[middle:stop] = [ends for _, ends in found]
            for i in (0, 1):
                self.kinds[i, middle:stop] = [tokens[i][0] if len(tokens) > i else LITERAL for tokens, _ in found]
                self.values[i, middle:stop] = [tokens[i][1] if len(tokens) > i else 0 for tokens, _ in found]
        self.code.update(zip(plain + other, range(start, stop), strict=True))
        self.chars += sum(map(len, fresh))


_TENS = {_hash(str(t)): t for t in range(20, 100, 10)}
_ONES = {_hash(str(i)): i for i in range(1, 10)}
_TEN_HASHES, _ONE_HASHES = np.array(list(_TENS), np.uint64), np.array(list(_ONES), np.uint64)


def _joined_numbers(k: np.ndarray, v: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tens and ones side by side ("twenty five") as one number, so what follows keeps its diagonal."""
    at = np.flatnonzero((k[:-1] == NUMBER) & (k[1:] == NUMBER))
    at = at[np.isin(v[at], _TEN_HASHES) & np.isin(v[at + 1], _ONE_HASHES)] if len(at) else at
    if not len(at):
        return k, v, f
    v = v.copy()
    for i in at.tolist():
        v[i] = _hash(str(_TENS[int(v[i])] + _ONES[int(v[i + 1])]))
    gone = np.ones(len(k), bool)
    gone[at + 1] = False
    return k[gone], v[gone], f[gone]


def canonical(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, kinds and value hashes of a text's words.

    A capitalised word is a name unless it starts a sentence or line; at such a place it is one
    only if the text has it as a name elsewhere.
    """
    cache = process_cache("vocabulary")
    known = cache.get("words")
    if known is None or len(known.code) > VOCABULARY or known.chars > VOCABULARY_CHARS:
        known = cache["words"] = _Vocabulary()
    words, lines = [], []
    for line in (text or "").split("\n"):
        lines.append(len(words))
        words += line.split()
    codes = known.codes(words)
    at = np.flatnonzero(known.count[codes])
    # a word opens a sentence if a line began or a sentence ended since the word before it
    began, ended = np.cumsum(np.bincount(lines, minlength=len(words) + 1)), np.zeros(len(words) + 1, np.int64)
    np.cumsum(known.ends[codes], out=ended[1:])
    f = np.ones(len(at), bool)
    f[1:] = (began[at[1:]] > began[at[:-1]]) | (ended[at[1:]] > ended[at[:-1]])
    codes = codes[at]
    k, v = known.kinds[0][codes], known.values[0][codes]
    double = np.flatnonzero(known.count[codes] == 2)
    if len(double):
        k = np.insert(k, double + 1, known.kinds[1][codes[double]])
        v = np.insert(v, double + 1, known.values[1][codes[double]])
        f = np.insert(f, double + 1, False)
    k, v, f = _joined_numbers(k, v, f)
    name = k == NAME
    opening = name & f
    if opening.any():
        k[opening & ~np.isin(v, v[name & ~f])] = LITERAL
    template = v.copy()
    for kind, h in _PLACEHOLDER.items():
        template[k == kind] = h
    return template, k, v


def _windows(template: np.ndarray, literals: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes, and which windows have enough literal words."""
    h = rolling(template, width, salt=width)
    literal = np.concatenate(([0], np.cumsum(literals)))
    return h, literal[width:] - literal[: len(h)] >= min(MIN_LITERALS, width)


def _plain(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows' own words without case, whatever their kinds and the rest of the text."""
    return rolling(values, width, salt=width | 1 << 32)


def rolling_any(marks: np.ndarray, width: int) -> np.ndarray:
    """Which runs of `width` have a mark."""
    total = np.concatenate(([0], np.cumsum(marks)))
    return total[width:] > total[: max(len(total) - width, 0)]


def _slots(kinds: np.ndarray, values: np.ndarray, at: int, width: int) -> list[int]:
    part = slice(at, at + width)
    return values[part][kinds[part] != LITERAL].view(np.int64).tolist()


def _back(values: np.ndarray) -> np.ndarray:
    """How far back each value first stood; two places have one value if the places of its first standing are one."""
    _, first, which = np.unique(values, return_index=True, return_inverse=True)
    return np.arange(len(values)) - first[which]


BENCH = "item_id long, item_hash long, like long, size int, width int, t int, exact boolean, hash long, slots array<long>, back array<long>"
ITEM = ["item_id", "item_hash"]


def _bench_rows(window: int):
    def run(batches):
        for batch in batches:
            rows = []
            for *item, text in zip(batch.column("item_id").to_pylist(), batch.column("item_hash").to_pylist(), batch.column("text").to_pylist(), strict=True):
                template, kinds, values = canonical(text)
                width = min(window, len(template))
                if width:
                    # items that differ by their values only are of one kind
                    item = (*item, int(rolling(template, len(template), salt=len(template) | 1 << 33)[0].view(np.int64)))
                    back = _back(values)
                    h, good = _windows(template, kinds == LITERAL, width)
                    rows += [(*item, len(template), width, t, False, int(h[t].view(np.int64)), _slots(kinds, values, t, width), _slots(kinds, back, t, width)) for t in np.flatnonzero(good).tolist()]
                    # in a copy without capitals names look like literal words
                    name = kinds == NAME
                    plain = np.where(name, LITERAL, kinds)
                    h, good = _windows(np.where(name, values, template), plain == LITERAL, width)
                    good &= rolling_any(name, width)
                    rows += [(*item, len(template), width, t, False, int(h[t].view(np.int64)), _slots(plain, values, t, width), _slots(plain, back, t, width)) for t in np.flatnonzero(good).tolist()]
                    h = _plain(values, width)
                    rows += [(*item, len(template), width, t, True, int(h[t].view(np.int64)), [], []) for t in range(len(h))]
            columns = list(zip(*rows)) or [()] * 10
            types = [pa.int64()] * 3 + [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in BENCH.split(", ")])

    return run


DOC = "doc_id long, text_hash long, width int, d int, hash long, slots array<long>"


def _marked(bits: np.ndarray, h: np.ndarray, among: np.ndarray | bool = True) -> list[int]:
    b = h & np.uint64(BITMAP_BITS - 1)
    return np.flatnonzero((bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool) & among).tolist()


def _doc_rows(widths: tuple[int, ...], shared):
    def run(batches):
        bits = shared.value
        for batch in batches:
            of, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                template, kinds, values = canonical(text)
                for width in widths:
                    h, good = _windows(template, kinds == LITERAL, width)
                    for d in _marked(bits, h, good):
                        of.append(i)
                        rows.append((width, d, int(h[d].view(np.int64)), _slots(kinds, values, d, width)))
                    h = _plain(values, width)
                    for d in _marked(bits, h):
                        of.append(i)
                        rows.append((width, d, int(h[d].view(np.int64)), []))
            columns = list(zip(*rows)) or [()] * 4
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("text_hash").take(take), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=[c.split()[0] for c in DOC.split(", ")],
            )

    return run


def _bitmap(bench: DataFrame) -> np.ndarray:
    """The benchmark's window hashes as a bitmap; at most BITMAP_BITS / 64 words reach the driver."""
    bit = F.col("hash").bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = bench.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _matched(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a with the columns of b that agree in `by`, nulls included."""
    b = b.withColumnsRenamed({c: f"__{c}" for c in by})
    return a.join(b, reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"__{c}"]) for c in by]), how).drop(*[f"__{c}" for c in by])


def parts(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The windows with what is known of their items, and the items with their classes.

    A window that more than SHARED items have is `many`, one that items of more than SHARED kinds have
    `common`. Items with the same `many` windows at the same distances, whose slots repeat their
    values at the same places, are a class: a document matches these windows of all of them alike.
    The smallest stands for it (`first`). `own` is the number of words under windows not common.
    Counts are partial sums, so a window that every item has meets in one task as a row per kind only.
    """
    at = ["hash", "width"]
    each = windows.select(*at, "like", *ITEM).distinct()
    kinds = each.groupBy(*at, "like").agg(F.count(F.lit(1)).alias("items"))
    held = kinds.groupBy(*at).agg(F.sum("items").alias("items"), F.count(F.lit(1)).alias("kinds")).where(F.col("items") > SHARED)
    held = held.select(*at, F.lit(True).alias("many"), (F.col("kinds") > SHARED).alias("common"))
    marked = windows.drop("like").join(held, at, "left").fillna(False, ["many", "common"])
    marked = cut(marked, "marked")
    own = F.collect_list(F.when(~F.col("common"), F.sequence("t", F.col("t") + F.col("width") - 1)))
    part = F.collect_set(F.when(F.col("many"), F.struct("exact", "t", "width", "hash", "back")))
    items = marked.groupBy(*ITEM).agg(F.max("size").alias("size"), F.size(F.array_distinct(F.flatten(own))).alias("own"), F.sort_array(part).alias("part"))
    start = F.array_min(F.transform("part", lambda x: x["t"]))
    near = F.transform("part", lambda x: F.struct(x["exact"], x["t"] - start, x["width"], x["hash"], x["back"]))
    items = items.select(*ITEM, "size", "own", F.when(F.size("part") > 0, F.xxhash64(near)).alias("class"))
    items = cut(items, "items")
    first = items.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct("size", *ITEM)).alias("least"))
    items = items.join(first, "class", "left").withColumn("first", F.col("item_hash").eqNullSafe(F.col("least.item_hash")) & F.col("item_id").eqNullSafe(F.col("least.item_id")))
    items = cut(items, "classes")
    return cut(_matched(marked.drop("size", "back"), items.drop("least"), ITEM), "benchmark"), items


def _covered(joined: DataFrame, by: list[str]) -> DataFrame:
    """Words that the consistent diagonals of each pair cover, and those of them under windows not common."""
    match = F.struct("t", "width", "common", F.arrays_zip(F.col("bslots").alias("a"), F.col("slots").alias("b")).alias("slots"))
    diagonal = joined.groupBy(*by, "exact", (F.col("d") - F.col("t")).alias("diagonal")).agg(F.collect_set(match).alias("found"))
    pairs = F.array_distinct(F.flatten(F.transform("found", lambda x: x["slots"])))
    diagonal = diagonal.withColumn("pairs", pairs).withColumn("values", F.array_distinct(F.transform("pairs", lambda s: s["a"])))
    diagonal = diagonal.withColumn("broken", F.filter("values", lambda a: F.size(F.filter("pairs", lambda s: s["a"] == a)) > 1))
    diagonal = diagonal.where(F.size("broken") <= BROKEN_SLOTS * F.size("values"))
    diagonal = diagonal.withColumn("found", F.filter("found", lambda x: ~F.exists(x["slots"], lambda s: F.array_contains(F.col("broken"), s["a"]))))
    words = lambda found: F.array_distinct(F.flatten(F.transform(found, lambda x: F.sequence(x["t"], x["t"] + x["width"] - 1))))
    diagonal = diagonal.withColumn("all", words("found")).withColumn("telling", words(F.filter("found", lambda x: ~x["common"])))
    count = lambda name: F.size(F.array_distinct(F.flatten(F.collect_list(name)))).cast("long")
    return diagonal.groupBy(*by).agg(count("all").alias("n_words"), count("telling").alias("n_own"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, text_hash, item_id, item_hash, n_words (item words covered), share, n_items, telling of each contaminated pair.

    Null texts have no windows; windows without enough literal words match by their own words
    only, others also with other values, and an item shorter than the window is matched whole. Rows of docs with a null doc_id or alike in
    doc_id are told apart by text_hash; equal rows give one match. Very long texts are read whole.
    Items alike in item_id are told apart by item_hash; alike in both they are one. Empty tables
    give an empty result; further columns of either table are ignored, whatever their names.

    A pair that meets in a window of few items has a row of its own, counted over all windows of the item.
    All pairs of a document with items of one class (see `members`) that meet only in the windows which make
    the class are one row: item_id and share are those of the class's smallest item, n_items is the
    number of its items that the document contaminates and that have no row of their own. telling says whether
    one of these items reaches the limits by the windows alone that no more than SHARED kinds of items have, of
    the words under these (of all its words, if it has no such window): a common instruction tells no item.
    """
    spark = docs.sparkSession
    bench, items = _benchmark(benchmark, window)
    sought = bench.where(~F.col("many") | F.col("first"))
    widths = tuple(sorted(r.width for r in sought.select("width").distinct().collect()))  # at most `window`
    shared = spark.sparkContext.broadcast(_bitmap(sought))
    rows = common.id_text(docs).withColumn("text_hash", F.xxhash64("text"))
    found = rows.mapInArrow(_doc_rows(widths, shared), DOC)
    b = sought.withColumnsRenamed({"hash": "bh", "width": "bw", "slots": "bslots"})
    joined = found.join(b, (F.col("hash") == F.col("bh")) & (F.col("width") == F.col("bw"))).drop("bh", "bw")
    doc = ["doc_id", "text_hash"]
    what = [*doc, *ITEM, "n_words", "share", "n_items", "telling"]

    def tells(x):
        enough = (F.col("n_own") >= min_words) | (F.col("n_own") / x["own"] >= min_share)
        return F.when(x["own"] > 0, enough).otherwise((F.col("n_words") >= min_words) | (F.col("n_words") / x["size"] >= min_share))

    def holds(x):
        return tells(x) | (F.col("n_words") >= min_words) | (F.col("n_words") / x["size"] >= min_share)

    def number(of, test):
        return F.aggregate(of, F.lit(0).cast("long"), lambda n, x: n + F.when(test(x), x["n"]).otherwise(0))

    def alone(pairs):
        x = {"size": F.col("size"), "own": F.col("own")}
        pairs = pairs.where(holds(x)).withColumn("share", F.col("n_words") / F.col("size"))
        return pairs.select(*what[:-2], F.lit(1).cast("long").alias("n_items"), tells(x).alias("telling"))

    pair = [*doc, *ITEM, "size", "own"]
    if items.where(F.col("class").isNotNull()).isEmpty():
        return alone(_covered(joined, pair))
    joined = cut(joined.select(*pair, "class", "many", "common", "exact", "t", "width", "d", "hash", "bslots", "slots"), "found")
    single, many = joined.where(~F.col("many")), joined.where("many")
    # a pair with a window of its own is counted over the item's other windows as well
    having = single.where(F.col("class").isNotNull()).select(*pair, "class").distinct()
    hits = _matched(having, many.select(*doc, "class", "hash", "width", "d", "slots").distinct(), [*doc, "class"])
    theirs = bench.where("many").select(*ITEM, "hash", "width", "t", "exact", "common", F.col("slots").alias("bslots"))
    columns = [*pair, "common", "exact", "t", "width", "d", "bslots", "slots"]
    own = alone(_covered(single.select(*columns).unionByName(_matched(hits, theirs, [*ITEM, "hash", "width"]).select(*columns)), pair))
    # the others of its class are counted together
    group = F.struct("size", "own", "n")
    classes = items.where(F.col("class").isNotNull()).groupBy("class", "least", "size", "own").agg(F.count(F.lit(1)).alias("n"))
    classes = classes.groupBy("class", "least").agg(F.collect_list(group).alias("have"))
    less = having.groupBy(*doc, "class", "size", "own").agg(F.count(F.lit(1)).alias("n")).groupBy(*doc, "class").agg(F.collect_list(group).alias("less"))
    together = _matched(_covered(many, [*doc, "class"]).join(classes, "class"), less, [*doc, "class"], "left")
    together = together.withColumn("less", F.coalesce("less", F.array().cast(less.schema["less"].dataType)))
    together = together.withColumn("n_items", number("have", holds) - number("less", holds)).withColumn("telling", number("have", tells) > number("less", tells))
    together = together.withColumns({c: F.col(f"least.{c}") for c in ITEM}).withColumn("share", F.col("n_words") / F.col("least.size"))
    return own.unionByName(together.where(F.col("n_items") > 0).select(*what))


def _benchmark(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    common.prepare(benchmark.sparkSession)
    items = common.columns(benchmark, "item_id long, text string").withColumn("item_hash", F.xxhash64("text"))
    return parts(cut(items.mapInArrow(_bench_rows(window), BENCH), "windows"))


def members(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id and item_hash of each item of a class, class_item_id and class_item_hash of the item that stands for it in `matches`.

    Items without windows that more than SHARED items have are in no class and not listed; an empty
    table gives an empty result.
    """
    items = _benchmark(benchmark, window)[1].where(F.col("class").isNotNull())
    return items.select(*ITEM, *[F.col(f"least.{c}").alias(f"class_{c}") for c in ITEM])


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that no benchmark item contaminates by windows that tell it, all columns as they are.

    Null and empty texts stay; very long ones are read whole. Repeated rows stay or go together;
    rows with a null doc_id are told apart by their text. Without items all rows stay; an empty
    table gives an empty result. Clashing names of columns do no harm.
    """
    bad = cut(matches(docs, benchmark, **how).where("telling").select("doc_id", "text_hash").distinct(), "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")
