"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a word is the sum
over all of its segmentations into pieces, by the forward algorithm; a text's is the product over its words, so the
text is read whole. The probabilities are learned by expectation-maximisation: forward and backward sums give every
piece its expected count in the words of a language, in Spark tasks over the words of a sample of labelled rows.

Defined results: a null text and a text without letters get ``und`` and score 0; so does every text where no row has
a language to learn from; likelihoods that tie go to the language first by code point; repeated rows are judged
each; an empty table gives no rows; a null doc_id is kept; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm import workers
from scenelake.llm.tables import remainder
from scenelake.llm.token_counts import chunks

UNKNOWN = "und"
#: About so many labelled rows are learned from, chosen by a hash of their id.
SAMPLE = 20_000
ROUNDS = 2
#: Added to every piece's expected count.
SMOOTHING = 0.05
#: Words whose likelihoods a worker keeps, before it starts anew.
CACHE = 300_000
#: And their letters together.
CACHED = 8_000_000
#: Words of fewer letters need no scaling: even with the rarest pieces their sums stay within a double.
SHORT = 28
_START = "▁"
#: Bits of a match's number that hold the piece's length.
_SIZE = 6
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


class Pieces:
    """The vocabulary and where its pieces match in a word; a character that is no piece matches as number 0."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.size = len(names) + 1
        self.single = {name for name in names if len(name) == 1}
        self.automaton = ahocorasick.Automaton()
        for number, name in enumerate(names, 1):
            self.automaton.add_word(name, number << _SIZE | len(name))
        self.automaton.make_automaton()

    @classmethod
    def at(cls, path: str) -> Pieces:
        """One per worker and file."""
        return workers.kept(("pieces", path), lambda: cls(path))

    def matches(self, word: str) -> list[tuple[int, int]]:
        """(last place, piece number and length in one) of every match in the word with its start mark."""
        marked = _START + word
        found = list(self.automaton.iter(marked))
        if not self.single.issuperset(marked):
            found += [(at, 1) for at, character in enumerate(marked) if character not in self.single]
            found.sort()
        return found

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(end, start, piece) of every match, by ascending end."""
        return [(last + 1, last + 1 - (code & (1 << _SIZE) - 1), code >> _SIZE) for last, code in self.matches(word)]


def forward(words: list[str], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word (rows) in each language (columns); probability is pieces by languages."""
    out = np.empty((len(words), probability.shape[1]))
    short = [i for i, word in enumerate(words) if len(word) < SHORT]
    if short:
        lasts, codes, counts = [], [], []
        for i in short:
            ends, found = zip(*pieces.matches(words[i]), strict=True)
            lasts += ends
            codes += found
            counts.append(len(ends))
        end, code = np.array(lasts, dtype=np.int16) + np.int16(1), np.array(codes)
        order = np.argsort(end, kind="stable")
        table = np.stack([end, np.repeat(np.arange(len(short)), counts), end - (code & (1 << _SIZE) - 1), code >> _SIZE], axis=1)[order]
        last = np.array([len(words[i]) + 1 for i in short])
        sums = np.zeros((last.max() + 1, len(short), probability.shape[1]))
        sums[0] = 1.0
        cuts = np.searchsorted(table[:, 0], np.arange(1, last.max() + 2))
        for end in range(1, last.max() + 1):
            part = table[cuts[end - 1] : cuts[end]]
            rows, first = np.unique(part[:, 1], return_index=True)
            sums[end, rows] = np.add.reduceat(sums[part[:, 2], part[:, 1]] * probability[part[:, 3]], first, axis=0)
        out[short] = np.log(sums[last, np.arange(len(short))])
    for i, word in enumerate(words):
        if len(word) >= SHORT:
            out[i] = _scaled(word, pieces, probability)
    return out


def _scaled(word: str, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """The forward sum of a long word, with its logarithm carried along."""
    span = 40  # no piece is longer
    sums = np.full((span, probability.shape[1]), 0.0)
    scale = np.zeros((span, probability.shape[1]))
    sums[0], at = 1.0, 0
    total = np.zeros(probability.shape[1])
    for end, start, piece in [*pieces.edges(word), (len(word) + 2, 0, 0)]:
        if end != at:
            if at:
                slot = at % span
                grown = np.log(total)
                sums[slot], scale[slot] = 1.0, grown + base
            if end > len(word) + 1:
                break
            at, base = end, scale[(end - 1) % span].copy()
            total = np.zeros(probability.shape[1])
        slot = start % span
        total = total + sums[slot] * np.exp(scale[slot] - base) * probability[piece]
    return scale[(len(word) + 1) % span]


def expected(words: list[tuple[str, int]], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in counted words of one language, given its current probabilities."""
    counts = np.zeros(pieces.size)
    for word, n in words:
        if len(word) >= SHORT:
            _expected_long(word, n, pieces, probability, counts)
            continue
        edges = pieces.edges(word)
        ahead, back = [0.0] * (len(word) + 2), [0.0] * (len(word) + 2)
        ahead[0] = back[-1] = 1.0
        values = [probability[piece] for _, _, piece in edges]
        for (end, start, _), value in zip(edges, values, strict=True):
            ahead[end] += ahead[start] * value
        for (end, start, _), value in zip(reversed(edges), reversed(values), strict=True):
            back[start] += back[end] * value
        whole = ahead[-1]
        for (end, start, piece), value in zip(edges, values, strict=True):
            counts[piece] += n * ahead[start] * value * back[end] / whole
    return counts


def _expected_long(word: str, n: int, pieces: Pieces, probability: np.ndarray, counts: np.ndarray) -> None:
    """The same for one long word, in logarithms."""
    edges = pieces.edges(word)
    values = [math.log(probability[piece]) for _, _, piece in edges]
    ahead, back = [-math.inf] * (len(word) + 2), [-math.inf] * (len(word) + 2)
    ahead[0] = back[-1] = 0.0
    for (end, start, _), value in zip(edges, values, strict=True):
        ahead[end] = _added(ahead[end], ahead[start] + value)
    for (end, start, _), value in zip(reversed(edges), reversed(values), strict=True):
        back[start] = _added(back[start], back[end] + value)
    for (end, start, piece), value in zip(edges, values, strict=True):
        counts[piece] += n * math.exp(min(0.0, ahead[start] + value + back[end] - ahead[-1]))


def _added(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    high, low = max(a, b), min(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def learn(labelled: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The languages in order and the piece probabilities (pieces by languages), from rows of doc_id, text and lang.

    What comes to the driver is one number per language and piece of the vocabulary.
    """
    spark = labelled.sparkSession
    n = labelled.count()
    chosen = labelled if n <= sample else labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * sample / n)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                seen.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            rows = [(lang, word, k) for lang, words in seen.items() for word, k in words.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()), strict=True)],
                                             ["lang", "word", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    langs = sorted(row[0] for row in counted.select("lang").distinct().collect())
    size = Pieces.at(path).size
    probability = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds if langs else 0):
        known = spark.sparkContext.broadcast(probability)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, totals = Pieces.at(path), np.zeros((len(langs), size))
            for batch in batches:
                lang, word, times = (column.to_pylist() for column in batch.columns)
                for number, name in enumerate(langs):
                    own = [(word[i], times[i]) for i in range(len(word)) if lang[i] == name]
                    totals[number] += expected(own, pieces, known.value[:, number])
            for number in range(len(langs)):
                used = np.flatnonzero(totals[number])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), number), pa.int32()), pa.array(used, pa.int32()), pa.array(totals[number, used])], ["lang", "piece", "n"])

        sums = counted.mapInArrow(gather, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((size, len(langs)), SMOOTHING)
        counts[sums["piece"], sums["lang"]] += np.round(sums["n"], 6)
        probability = counts / counts.sum(axis=0)
    counted.unpersist()
    return langs, probability


class Likelihoods(dict):
    """Word to row number of a table of log-likelihoods that grows by whole lists of new words."""

    def __init__(self, pieces: Pieces, probability: np.ndarray, limit: int = CACHE) -> None:
        super().__init__()
        self.pieces, self.probability, self.limit = pieces, probability, limit
        self.rows = np.empty((1024, probability.shape[1]))
        self.letters = 0

    def clear(self) -> None:
        super().clear()
        self.letters = 0

    def add(self, words: list[str]) -> None:
        if len(self) + len(words) > self.limit:
            self.clear()
        at = len(self)
        if at + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows[:at], np.empty((at + 2 * len(words), self.rows.shape[1]))])
        for start in range(0, len(words), 8192):
            part = words[start : start + 8192]
            self.rows[at + start : at + start + len(part)] = forward(part, self.pieces, self.probability)
        self.update(zip(words, range(at, at + len(words)), strict=True))
        self.letters += sum(map(len, words))

    def of(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """Sums of the words' log-likelihoods per text, None for a text without words."""
        wanted = set().union(*texts)
        new = wanted.difference(self)
        if len(self) + len(new) > self.limit or self.letters > CACHED:
            self.clear()
            new = wanted
        if new:
            self.add(sorted(new))
        return [self.rows[list(map(self.__getitem__, words))].sum(axis=0) if words else None for words in texts]


def _judge(texts: pa.Array, table: Likelihoods | None, langs: list[str]) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for part in chunks(texts):
        words = [words_of(text) for text in part]
        for sums in [None] * len(words) if table is None else table.of(words):
            best = None if sums is None else int(sums.argmax())
            names.append(UNKNOWN if best is None else langs[best])
            scores.append(0.0 if best is None else float(1 / np.exp(sums - sums[best]).sum()))
    return names, scores


def predicted(docs: DataFrame, langs: list[str], probability: np.ndarray, path: str) -> DataFrame:
    """Per row: doc_id, lang_pred and score, the language's share of the likelihood with equal priors."""
    known = docs.sparkSession.sparkContext.broadcast(probability)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Likelihoods(Pieces.at(path), known.value) if langs else None
        for batch in batches:
            names, scores = _judge(batch.column(1), table, langs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, path: str, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is unknown or has less than ``least`` of the likelihood."""
    langs, probability = learn(_learnable(docs), path, sample)
    known = docs.sparkSession.sparkContext.broadcast(probability)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Likelihoods(Pieces.at(path), known.value) if langs else None
        for batch in batches:
            names, scores = _judge(batch.column("text"), table, langs)
            yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where((remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def identified(docs: DataFrame, path: str, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score. Rows with crc32(doc_id) mod 3 = 1 are never learned from."""
    held_out = remainder(F.col("doc_id"), 3) == 1
    langs, probability = learn(_learnable(docs), path, sample)
    return predicted(docs, langs, probability, path).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
