"""Exact encoding and decoding with a SentencePiece model of merge type, by backtracking.

A text is normalised (spaces become U+2581, one is put in front) and cut where no piece can cross: before a run of
U+2581 and around characters that are no piece. Each part is encoded left to right: the longest piece found by an
Aho-Corasick automaton is tried, then its shorter prefixes. A piece is accepted after another only if merging their
joined characters gives these two pieces again. Where none is accepted, the position is marked as failed in a bit
field and the piece before it is taken back. Unknown characters become byte pieces.

Words repeat, so a worker keeps the ids and the decoded text of the words it has met in a bounded cache.

Defined results: null and empty texts give no ids; texts of any length are encoded whole; repeated rows are encoded
each; an empty table gives no rows; a null doc_id is kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm import workers
from scenelake.llm.token_counts import chunks

SPACE = "▁"
#: Entries of a worker's caches of words and of pairs of pieces, which start anew beyond it.
WORDS = 250_000
PAIRS = 500_000
#: Longer words are encoded each time.
LONG = 64


class Words(dict):
    """What a codec makes of each word met so far."""

    def __init__(self, codec: PieceCodec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> tuple[str, int, str]:
        if len(word) > LONG:
            return self.codec.word(word)
        if len(self) >= WORDS:
            self.clear()
        known = self[word] = self.codec.word(word)
        return known


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize("A  ﬁ ") != f"{SPACE}A{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError(f"{path}: only the identity normaliser with a leading space is known here")
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(self.pieces))]
        self.ids = {piece: i for i, piece in enumerate(self.pieces) if not special[i]}
        self.score = {piece: model.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [self.pieces.index(f"<0x{byte:02X}>") for byte in range(256)]
        self.byte_of = {i: byte for byte, i in enumerate(self.bytes)}
        if any(SPACE in piece.lstrip(SPACE) or len(piece) > 1 and piece[0] == SPACE and piece[1:2] == SPACE and piece.strip(SPACE) for piece in self.ids):
            raise ValueError(f"{path}: a piece crosses a word's end")
        self.known = {piece for piece in self.ids if len(piece) == 1}
        # Pieces that merging can reach; of each, the longest shorter piece it begins with.
        self.whole = {piece for piece in self.ids if len(piece) == 1 or self.merge(piece) == [piece]}
        self.shorter = {piece: next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.whole), None) for piece in self.whole}
        self.automaton = ahocorasick.Automaton()
        for piece in self.whole:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        outside = "".join(sorted(self.known - {SPACE}))
        self.parts = re.compile(f"[{re.escape(outside)}]+|[^{re.escape(outside)}]")
        self.shown = [piece.replace(SPACE, " ") for piece in self.pieces]
        self.names = [str(i) for i in range(len(self.pieces))]
        self.runs: dict[int, list[int]] = {}
        self.words = Words(self)
        self.pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    def at(cls, path: str) -> PieceCodec:
        """One per worker and file."""
        return workers.kept(("codec", path), lambda: cls(path))

    def merge(self, text: str) -> list[str]:
        """The pieces of a short string by merging: best score first, then leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at, left = None, 0, ""
            for i, part in enumerate(parts):
                value = score.get(left + part) if i else None
                if value is not None and (best is None or value > best):
                    best, at = value, i
                left = part
            if best is None:
                return parts
            parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined characters of two pieces gives the two pieces."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a string all of whose characters are pieces."""
        if text in self.whole:
            return [text]
        longest = [0] * len(text)
        for end, size in self.automaton.iter(text):  # ends ascend: the last match from a start is its longest
            longest[end + 1 - size] = size
        pairs, shorter = self.pairs, self.shorter
        failed: bytearray | None = None  # the bit field, from the first failure on
        found: list[str] = []
        last: str | None = None
        at, piece = 0, text[: longest[0]]
        while True:
            while piece is not None:
                end = at + len(piece)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if last is None:
                        break
                    good = pairs.get((last, piece))
                    if good or good is None and self.compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece is None:
                failed = failed or bytearray(len(text) // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = found.pop()
                last = found[-1] if found else None
                at -= len(piece)
                continue
            found.append(piece)
            last, at = piece, end
            if at == len(text):
                return found
            piece = text[at : at + longest[at]]

    def spaces(self, n: int) -> list[int]:
        """Ids of a run of ``n`` spaces."""
        if n not in self.runs:
            self.runs[n] = [self.ids[piece] for piece in self.backtrack(SPACE * n)]
        return self.runs[n]

    def word_ids(self, word: str) -> list[int]:
        """Ids of a space and the characters after it, none of them a space."""
        ids: list[int] = []
        first = True
        for part in self.parts.findall(word):
            if part[0] in self.known:
                ids += map(self.ids.__getitem__, self.backtrack(SPACE + part if first else part))
            else:
                if first:
                    ids.append(self.ids[SPACE])
                ids += (self.bytes[byte] for byte in part.encode())
            first = False
        return ids or [self.ids[SPACE]]

    def word(self, word: str) -> tuple[str, int, str]:
        """For a space and ``word``: ids joined by commas, their number, and what they decode to."""
        ids = self.word_ids(word)
        return ",".join([self.names[i] for i in ids]), len(ids), self.joined(ids)

    def joined(self, ids: list[int]) -> str:
        """The text of ids: spaces for U+2581, runs of byte pieces read as UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i is not None:
                out.append(self.shown[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.joined(ids).removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.both(text)[0].split(",") if i]

    def both(self, text: str) -> tuple[str, int, str]:
        """A text's ids joined by commas, their number, and the text that they decode to."""
        if not text:
            return "", 0, ""
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            found = list(map(self.words.__getitem__, words))
        else:
            found = self._with_runs(words)
        ids = ",".join([w[0] for w in found])
        return ids, ids.count(",") + 1, "".join([w[2] for w in found]).removeprefix(" ")

    def _with_runs(self, words: list[str]) -> list[tuple[str, int, str]]:
        """Empty words are spaces before the next word's own; that one joins the run if it merges with nothing."""
        found, run = [], 0

        def flush(n: int) -> None:
            if n:
                ids = self.spaces(n)
                found.append((",".join(map(str, ids)), len(ids), " " * n))

        alone = str(self.ids[SPACE])
        for word in words:
            if not word:
                run += 1
                continue
            ids, n, text = self.words[word]
            if run and ids.partition(",")[0] == alone:
                flush(run + 1)
                if n > 1:
                    found.append((ids.partition(",")[2], n - 1, text[1:]))
            else:
                flush(run)
                found.append((ids, n, text))
            run = 0
        flush(run)
        return found


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the comma-joined ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.at(path)
        for batch in batches:
            numbers, ids, texts = [], [], []
            for part in chunks(batch.column(1)):
                for text in part:
                    joined, n, decoded = codec.both(text or "")
                    numbers.append(n)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.at(path)
        for batch in batches:
            found = [codec.both(text or "") for part in chunks(batch.column(1)) for text in part]
            ids = pa.array([[int(i) for i in f[0].split(",") if i] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([f[2] for f in found], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
