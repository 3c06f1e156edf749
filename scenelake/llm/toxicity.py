"""Toxicity of texts whose words may be disguised: noisy-channel restoration, then a score of what is restored.

A disguised stretch (digits or symbols among letters, letters drawn out, letters set apart) becomes a lattice: a
symbol may stand for letters or for nothing, a drawn-out letter may be written once or twice, a separator may be a
space or nothing. Viterbi search finds the likeliest reading under a character trigram model counted over all
documents. Words of the restored text and their first letters are features. Of those that go with the label beyond
chance, each is kept that still tells toxic from other texts among the texts without the stronger ones; what copied
texts merely share with an insult drops out. The score is the chance that at least one feature found is right.

Defined results: null and empty texts are scored by the share of toxic labels alone; without labels of both kinds
every score is that share, or 0.5 without any; texts of any length are read whole; repeated rows are scored each; several
labels of one document count each; an empty table gives no rows; a null doc_id is held out; lang, source and other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.shingles import spans
from scenelake.llm.tables import remainder, scratch, stored

#: About so many labelled rows are learned from, chosen by a hash of their id.
SAMPLE = 20_000
#: Symbols of the character model: 0 for anything between words, 1-26 for a-z, 27 for other letters.
SYMBOLS = 28
#: What a symbol may stand for.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_SWAP, _DROP, _ONCE, _JOIN, _SPACE = -1.0, -9.0, -0.5, -0.2, -1.5
#: Restored stretches that a worker keeps, before it starts anew.
CACHE = 100_000
#: Features below this separate the classes no better than one in some thousand would by chance.
CHI_SQUARE = 12.0
#: Toxic texts that a feature must still find, and the share of toxic ones among what it finds.
FOUND, PURITY = 3, 0.8
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(ord("A"), ord("Z") + 1)]] = _KIND[[*range(ord("a"), ord("z") + 1)]] = np.arange(1, 27)
_KIND[0xC3:] = 27
_LOW = np.arange(256, dtype=np.uint16)
_LOW[ord("A") : ord("Z") + 1] += 32
_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[[ord(sign) for sign in READINGS if ord(sign) < 128]] = True
_LETTER = r"[^\W\d_]"
_SIGN = "[0-9@$!|+(€£]"
_STRETCH = re.compile(
    rf"(?<!\w){_LETTER}(?:[ .\-_*·]{_LETTER}){{3,}}(?!\w)"  # letters set apart
    rf"|(?:{_LETTER}|{_SIGN})*(?:{_LETTER}{_SIGN}+{_LETTER}|(?<!\w){_SIGN}{{1,2}}{_LETTER}{{3}})(?:{_LETTER}|{_SIGN})*"  # signs among letters
    rf"|{_LETTER}*({_LETTER})\1\1{_LETTER}*")  # letters drawn out
_WORDS = re.compile(rf"{_LETTER}+")


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol triples over all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in spans(batch.column(0)):
                symbol = _KIND[data]
                symbol = np.insert(symbol, np.repeat(offsets[:-1], 2), 0)  # two blanks before each text
                raw = np.insert(data, np.repeat(offsets[:-1], 2), 32)
                symbol = symbol[(raw & 0xC0) != 0x80].astype(np.int32)  # one symbol for a character of several bytes
                total += np.bincount((symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:], minlength=SYMBOLS**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["triple", "n"])

    sums = docs.select("text").mapInArrow(run, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3)
    counts[sums["triple"]] = sums["n"]
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def character_model(counts: np.ndarray) -> list[list[list[float]]]:
    """Log-probability of the third symbol after two: triples smoothed by pairs, pairs by single symbols."""
    single = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + SYMBOLS)
    pair = counts.sum(axis=0)
    pair = (pair + 10 * single) / (pair.sum(axis=1, keepdims=True) + 10)
    return np.log((counts + 10 * pair) / (counts.sum(axis=2, keepdims=True) + 10)).tolist()


def _symbol(character: str) -> int:
    return ord(character) - 96 if "a" <= character <= "z" else 27 if character.isalpha() else 0


def restored(stretch: str, model: list[list[list[float]]]) -> str:
    """The likeliest reading of a disguised stretch."""
    apart = re.fullmatch(rf"{_LETTER}(?:[ .\-_*·]{_LETTER})+", stretch) is not None
    text = stretch.lower()
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for at, character in enumerate(text):
        if character.isalpha():
            options = [(character, 0.0)]
            if at and text[at - 1] == character and (text[at - 2 : at - 1] == character or text[at + 1 : at + 2] == character):
                options.append(("", _ONCE))
        elif apart and at % 2:
            options = [(" ", _SPACE), ("", _JOIN)]
        else:
            options = [(letter, _SWAP) for letter in READINGS.get(character, "")] + [("", _DROP), (" ", _DROP)]
        grown: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for out, cost in options:
                if out:
                    symbol = _symbol(out)
                    state, value, way = (b, symbol), score + cost + model[a][b][symbol], (path, out)
                else:
                    state, value, way = (a, b), score + cost, path
                if state not in grown or value > grown[state][0]:
                    grown[state] = (value, way)
        best = grown
    path = max(((score + model[a][b][0], state, way) for state, (score, way) in best.items() for a, b in [state]), key=lambda x: x[:2])[2]
    letters = []
    while path is not None:
        path, out = path
        letters.append(out)
    return "".join(reversed(letters))


class Restorer:
    """Restores whole texts, with a bounded cache of stretches."""

    def __init__(self, model: list[list[list[float]]]) -> None:
        self.model, self.cache = model, {}

    def _one(self, match: re.Match) -> str:
        stretch = match.group()
        known = self.cache.get(stretch)
        if known is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            known = self.cache[stretch] = restored(stretch, self.model)
        return known

    def words(self, text: str, disguised: bool) -> set[str]:
        return set(_WORDS.findall((_STRETCH.sub(self._one, text) if disguised else text).lower()))

    def features(self, text: str, disguised: bool) -> set[str]:
        """The distinct words of a text, and their first four and five letters with a mark."""
        words = self.words(text, disguised)
        return words | {word[:4] + "~" for word in words} | {word[:5] + "~" for word in words}


def disguises(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts may hold a letter three times, a sign before a letter or four letters set apart; a cheap test."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    places = np.flatnonzero(lead)
    first = data[places]
    ascii_ = first < 0x80
    after = data[np.minimum(places + 1, len(data) - 1)] if len(data) else data
    # One number per character; of characters of three and four bytes some share one.
    code = np.where(ascii_, _LOW[first], first.astype(np.uint16) << 8 | after)
    letter = np.where(ascii_, _KIND[first] > 0, True)
    sign = _SIGNS[first] | (first == 0xE2) | (first == 0xC2)
    pad = np.zeros(8, dtype=bool)
    code, letter, n = np.concatenate([code, pad.astype(code.dtype)]), np.concatenate([letter, pad]), len(places)
    drawn = letter[:n] & (code[:n] == code[1 : n + 1]) & (code[:n] == code[2 : n + 2])
    alone = letter[:n] & ~np.concatenate([pad[:1], letter[: max(n - 1, 0)]])[:n] & ~letter[1 : n + 1]
    alone = np.concatenate([alone, pad])
    apart = alone[:n] & alone[2 : n + 2] & alone[4 : n + 4] & alone[6 : n + 6]
    hits = np.concatenate([[0], np.cumsum(drawn | (sign & letter[1 : n + 1]) | apart)])
    return hits[at[1:]] > hits[at[:-1]]


class Matcher:
    """Finds the kept features of a text; words known to have none are remembered up to a bound."""

    def __init__(self, restorer: Restorer, chances: dict[str, float]) -> None:
        self.restorer, self.chances, self.plain = restorer, chances, set()

    def found(self, text: str, disguised: bool) -> set[str]:
        found: set[str] = set()
        for word in self.restorer.words(text, disguised) - self.plain:
            own = {f for f in (word, word[:4] + "~", word[:5] + "~") if f in self.chances}
            if own:
                found |= own
            else:
                if len(self.plain) >= 4 * CACHE:
                    self.plain.clear()
                self.plain.add(word)
        return found


def _per_text(column: pa.Array, take) -> Iterator[set[str]]:
    """``take(text, whether it may hold a disguise)`` of every text."""
    for at, end, data, offsets in spans(column):
        raw, hidden = data.tobytes(), disguises(data, offsets)
        for i in range(end - at):
            yield take(raw[offsets[i] : offsets[i + 1]].decode(), bool(hidden[i]))


def chosen(marks: list[tuple[int, list[int]]], order: list[int]) -> tuple[float, dict[int, float]]:
    """The chance of a text without any kept feature, and of each kept feature, to be toxic.

    ``marks`` has the label and the features of each text; features are tried in ``order``.
    """
    where: dict[int, list[int]] = {}
    for text, (_, features) in enumerate(marks):
        for feature in features:
            where.setdefault(feature, []).append(text)
    open_, kept = [True] * len(marks), {}
    for feature in order:
        texts = [text for text in where.get(feature, ()) if open_[text]]
        toxic = sum(marks[text][0] for text in texts)
        if toxic >= FOUND and toxic >= PURITY * len(texts):
            kept[feature] = (toxic + 0.5) / (len(texts) + 1)
            for text in texts:
                open_[text] = False
    rest = [toxic for (toxic, _), free in zip(marks, open_, strict=True) if free]
    return (sum(rest) + 0.5) / (len(rest) + 1), kept


def learn(docs: DataFrame, labels: DataFrame, model: list[list[list[float]]], sample: int = SAMPLE) -> tuple[float, dict[str, float]]:
    """The chance without any feature and the chance of each feature, from labelled rows with crc32(doc_id) mod 5 other than 0."""
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    n = marked.count()
    if n > sample:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * sample / n)))
    known = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(known.value)
        seen = (Counter(), Counter())
        for batch in batches:
            for toxic, features in zip(batch.column(1).to_pylist(), _per_text(batch.column(0), restorer.features), strict=True):
                seen[toxic].update(features)
                seen[toxic][""] += 1
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[t][name] for name in names], pa.int64()) for t in (0, 1))], ["feature", "n0", "n1"])

    # The ids are a sample of bounded size.
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(marked), "doc_id").select("text", "toxic")
    folder = scratch(spark, "toxicity")
    counts = stored(rows.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), f"{folder}/counts")
    whole = counts.where("feature = ''").first()
    d0, d1 = (whole["n0"], whole["n1"]) if whole else (0, 0)
    if not d0 or not d1:
        return (d1 + 0.5) / (d0 + d1 + 1), {}
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    cross = a * (d0 - b) - b * (d1 - a)
    chi = (d0 + d1) * cross * cross / ((a + b) * (d0 + d1 - a - b) * d0 * d1)
    strong = counts.where((F.col("feature") != "") & (a + b < d0 + d1) & (cross > 0) & (chi > CHI_SQUARE))
    names = [row["feature"] for row in strong.orderBy(chi.desc(), F.length("feature"), "feature").select("feature").collect()]
    number = spark.sparkContext.broadcast({name: i for i, name in enumerate(names)})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, of = Restorer(known.value), number.value
        for batch in batches:
            found = [sorted(of[f] for f in features & of.keys()) for features in _per_text(batch.column(0), restorer.features)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    marks = [(row["toxic"], row["found"]) for row in rows.mapInArrow(mark, "toxic int, found array<int>").collect()]
    base, kept = chosen(marks, list(range(len(names))))
    return base, {names[i]: chance for i, chance in kept.items()}


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    spark = docs.sparkSession
    model = character_model(character_counts(docs))
    base, chances = learn(docs, labels, model, sample)
    known = spark.sparkContext.broadcast((model, base, chances))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters, base, chances = known.value
        matcher = Matcher(Restorer(characters), chances)
        for batch in batches:
            score = [1 - (1 - base) * math.prod(1 - chances[f] for f in sorted(found)) for found in _per_text(batch.column(1), matcher.found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
