"""Number of tokens of whole texts, as a public tokenizer file gives them.

Texts reach the tokenizer's own batch call in batches of about equal bytes, whatever their number; only lengths
come back. A text longer than a piece is cut where no token and no special string can cross. Where the tokenizer
also never joins a word with the last space before the next one, which is tried when its file is read, a batch is
cut there too and each distinct word is encoded once: splitting texts into words is nine tenths of the library's
time. Both cuts are boundaries of the tokenizer itself, so the lengths add up to the whole text's.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import unused

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 15
CACHE_CHARS = 9_000_000  # of words kept by each worker, 8 added for each: about 110 MB with what Python needs
CACHED_WORD = 40
JOINED = 400
_BETWEEN_WORDS = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
_BEFORE_MARKS = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])|(?<=[^\W\d_])(?=[。，、！？；：])")
_LAST_SPACE = re.compile(r" (?=\S)")
_OTHER_SPACE = re.compile(r" (?!\S)")


class LengthEncoder:
    """Lengths of texts under a ``.json`` file of tokenizers or a ``.model`` file of sentencepiece.

    No begin, end or added special tokens, no truncation and no padding; special strings within texts are
    handled as the library does by default.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.pieces = SentencePieceProcessor(model_file=path)
            # Without the space, because the library puts one before every text. Only if no piece spans words.
            names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
            whole = all("▁" not in name.lstrip("▁") for name in names)
            led = self.pieces.encode("a", out_type=str)[0].startswith("▁")
            self.cuts, self.skip, self.lengths = _BETWEEN_WORDS if whole and led else None, 1, self._by_pieces
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
            from tokenizers import Tokenizer

            self.coder = Tokenizer.from_file(path)
            self.coder.no_truncation()
            self.coder.no_padding()
            self.cuts, self.skip = self._cuts_of_words(), 0
            self.lengths = self._by_words if self._words_stand_alone() else self._by_coder
            self.led = self._led()
            self.known: dict[str, int] = {}
            self.held = 0

    def _cuts_of_words(self) -> re.Pattern | None:
        """Where this tokenizer splits words by itself, found by asking its splitter; None if nowhere."""
        split = self.coder.pre_tokenizer
        if split is None:
            return None
        words = [word for word, _ in split.pre_tokenize_str("an old。")]
        if len(words) == 3:
            return _BEFORE_MARKS
        return _BETWEEN_WORDS if len(words) == 2 else None

    def _words_stand_alone(self) -> bool:
        """Whether a cut before the last space in front of a word changes nothing, tried on every kind of neighbour."""
        special = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        if self.cuts is None or any(re.search(r"\s", s) for s in special):
            return False
        left = ["a", "Z1", "!", "\n", "\t", " ", "a ", "\r\n ", "é", "你", "it's", "a\u00a0", "_", "🎉", *special]
        right = [" b", " 1", " !", " 你", " 's", " é", " _", " 🎉", " b\n", *(f" {s}" for s in special)]
        ids = {t: self.coder.encode(t, add_special_tokens=False).ids for t in left + right}
        return all(self.coder.encode(x + y, add_special_tokens=False).ids == ids[x] + ids[y] for x in left for y in right)

    def _led(self) -> np.ndarray | None:
        """Whether each token of a byte-level vocabulary begins with a space; None for other vocabularies."""
        if "ByteLevel" not in repr(self.coder.pre_tokenizer) or self.coder.encode(" b", add_special_tokens=False).tokens[0][0] != "Ġ":
            return None
        vocabulary = self.coder.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[k for token, k in vocabulary.items() if token[:1] == "Ġ"]] = True
        return out

    def _of_words(self, words: list[str]) -> list[int]:
        """The length of each word with a space before it; words that hold no space share texts."""
        if self.led is None:
            return self._by_coder([" " + word for word in words])
        out = np.zeros(len(words), np.int64)
        lone = np.array([" " in word for word in words], bool)
        out[lone] = self._by_coder([" " + word for word, own in zip(words, lone.tolist(), strict=True) if own])
        plain = np.flatnonzero(~lone)
        texts = [" " + " ".join([words[k] for k in plain[at : at + JOINED].tolist()]) for at in range(0, len(plain), JOINED)]
        for at, code in zip(range(0, len(plain), JOINED), self.coder.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            begins = np.flatnonzero(self.led[code.ids])
            out[plain[at : at + JOINED]] = np.diff(begins, append=len(code))
        return out.tolist()

    def _by_coder(self, texts: list[str]) -> list[int]:
        return list(map(len, self.coder.encode_batch_fast(texts, add_special_tokens=False)))

    def _by_pieces(self, texts: list[str]) -> list[int]:
        return list(map(len, self.pieces.encode(texts, num_threads=1)))

    def _by_words(self, texts: list[str]) -> list[int]:
        get = self.known.get
        first, cut, new = [], [], set()
        for text in texts:
            parts = _LAST_SPACE.split(text) if _OTHER_SPACE.search(text) else text.split(" ")
            first.append(parts[0])  # the only part without a space before it
            del parts[0]
            found = list(map(get, parts))
            if None in found:
                new.update([word for word, n in zip(parts, found, strict=True) if n is None])
            cut.append((parts, found))
        words = list(new)
        own = dict(zip(words, self._of_words(words), strict=True))
        out = []
        for n, (parts, found) in zip(self._by_coder(first), cut, strict=True):
            if None in found:
                found = [own[word] if m is None else m for word, m in zip(parts, found, strict=True)]
            out.append(n + sum(found))
        self._keep(own)
        return out

    def _keep(self, own: dict[str, int]) -> None:
        """Words for later batches; long ones, which seldom return, are not kept."""
        if self.held > CACHE_CHARS:
            self.known.clear()
            self.held = 0
        short = {word: n for word, n in own.items() if len(word) <= CACHED_WORD}
        self.held += sum(map(len, short)) + 8 * len(short)
        self.known.update(short)

    def cut(self, text: str, size: int) -> Iterator[str]:
        """The text in pieces of ``size`` characters and what follows to the next safe boundary."""
        at = 0
        while self.cuts and len(text) - at > size:
            found = self.cuts.search(text, at + size)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start() + self.skip
        yield text[at:]

    def count(self, texts: Iterator[tuple[str, int]], total: np.ndarray, batch_bytes: int, piece_chars: int) -> None:
        """Add the length of each (text, row) to ``total[row]``, batch by batch."""
        held: list[str] = []
        rows: list[int] = []
        size = 0

        def close() -> None:
            nonlocal size
            np.add.at(total, rows, self.lengths(held))
            held.clear()
            rows.clear()
            size = 0

        for text, row in texts:
            for piece in self.cut(text, piece_chars) if len(text) > piece_chars else (text,):
                held.append(piece)
                rows.append(row)
                size += len(piece) if piece.isascii() else len(piece.encode())
                if size >= batch_bytes:
                    close()
        if held:
            close()


@cache
def length_encoder(path: str) -> LengthEncoder:
    """One per worker process, so that the file is read once."""
    return LengthEncoder(path)


def _texts(column: pa.Array, sizes: np.ndarray, batch_bytes: int) -> Iterator[tuple[str, int]]:
    """Each text and its row; only a stretch of about ``batch_bytes`` is held as Python strings."""
    begin = 0
    ends = np.cumsum(sizes)
    while begin < len(column):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + batch_bytes, "right")))
        yield from zip(column.slice(begin, end - begin).to_pylist(), range(begin, end), strict=True)
        begin = end


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, text: str = "text", batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """All columns of ``docs`` but its text, and n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    n_bytes counts UTF-8. A null text is the empty one: 0, 0, false. Repeated rows are counted each. A column of
    ``docs`` that has one of the new names, in any case, gives way to the new one. An empty table gives no rows.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c != text and c.lower() not in new]
    (whole,) = unused(docs, "_text")
    ready = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(whole))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = length_encoder(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(whole))
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.zeros(len(sizes), np.int64)
            coder.count(_texts(texts, sizes, batch_bytes), total, batch_bytes, piece_chars)
            own = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays(own + [pa.array(sizes), pa.array(total), pa.array(total > limit)], names=[*kept, *new])

    schema = ready.drop(whole).schema
    for name, kind in zip(new, ("long", "long", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return ready.mapInArrow(measure, schema)
