"""Token counts per document by a two-tier lookup of pre-token lengths.

The first tier is a compact table of the corpus's most frequent pre-tokens and their token counts, broadcast to
every task; the second is a cache in each Python worker, filled by the tokenizer on a miss. No pre-token is
shuffled: what crosses the network is one bounded list of frequent pre-tokens per task, from which the table is
chosen. The table only saves time; counts do not depend on it.

Defined results: null and empty texts have 0 bytes and 0 tokens; texts of any length are counted whole; repeated
rows are counted each; an empty table gives no rows; a null doc_id is kept; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm import workers

#: Entries of the broadcast table, and of each task's list of candidates for it.
FREQUENT = 16_384
#: Entries of a worker's cache, which starts anew beyond it.
CACHE = 300_000
#: Characters of text tokenized at a time.
CHUNK = 1_000_000


class PreTokens:
    """Splits a text as the tokenizer does and knows how many tokens a pre-token makes.

    The tokenizer file gives the split pattern, the strings of special tokens and the merges.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        steps = [step["type"] for step in parts["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or not parts["pre_tokenizer"]["pretokenizers"][0]["invert"]:
            raise ValueError(f"{path}: another normaliser or splitter than this operator follows")
        self.find = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = re.compile("|".join(re.escape(x["content"]) for x in parts["added_tokens"] if x["special"]))
        self.model = Tokenizer.from_file(path).model
        self.alphabet = byte_alphabet()

    @classmethod
    def at(cls, path: str) -> PreTokens:
        """One per worker and file."""
        return workers.kept(("pretokens", path), lambda: cls(path))

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and its number of special tokens."""
        if "<|" not in text:
            return self._plain(text), 0
        found = len(self.special.findall(text))
        return [token for part in self.special.split(text) for token in self._plain(part)], found

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form, as characters are lowered singly
        return self.find(text.lower())

    def length(self, token: str) -> int:
        return len(self.model.tokenize("".join(map(self.alphabet.__getitem__, token.encode()))))


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(byte if byte in own else next(rest)) for byte in range(256)]


class Lengths(dict):
    """Frequent pre-tokens' lengths; anything else is looked up in a bounded cache or asked of the tokenizer."""

    def __init__(self, frequent: dict[str, int], tokens: PreTokens, limit: int = CACHE) -> None:
        super().__init__(frequent)
        self.cache: dict[str, int] = {}
        self.tokens, self.limit = tokens, limit

    def __missing__(self, token: str) -> int:
        known = self.cache.get(token)
        if known is None:
            if len(self.cache) >= self.limit:
                self.cache.clear()
            known = self.cache[token] = self.tokens.length(token)
        return known


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[list[str | None]]:
    """Texts in lists of about ``limit`` characters, so that few of them are Python objects at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def frequent_pretokens(docs: DataFrame, path: str, size: int = FREQUENT) -> list[str]:
    """The ``size`` pre-tokens counted most over all documents.

    Each task counts all of its pre-tokens, leaving out rare ones whenever their list grows beyond 16 times
    ``size``, and hands on at most ``size`` of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = PreTokens.at(path), Counter()
        for batch in batches:
            for texts in chunks(batch.column(0)):
                for text in texts:
                    seen.update(tokens.split(text or "")[0])
                if len(seen) > 16 * size:
                    seen = Counter(dict(seen.most_common(8 * size)))
        top = [(token, n) for token, n in seen.most_common(size) if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["token", "n"])

    counted = docs.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [row["token"] for row in counted.orderBy(F.desc("n"), "token").limit(size).select("token").collect()]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and whether that exceeds ``limit``. ``path`` is a tokenizer file."""
    tokens = PreTokens.at(path)
    table = docs.sparkSession.sparkContext.broadcast({token: tokens.length(token) for token in frequent_pretokens(docs, path, frequent)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PreTokens.at(path)
        lengths = Lengths(table.value, own)
        for batch in batches:
            numbers = []
            for texts in chunks(batch.column(1)):
                for text in texts:
                    found, special = own.split(text or "")
                    numbers.append(sum(map(lengths.__getitem__, found)) + special)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(numbers, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
