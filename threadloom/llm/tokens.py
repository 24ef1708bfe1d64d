"""Token ids in a directly addressable binary form.

Texts are encoded with a public tokenizer file, cut into segments in ascending id order, and every segment
holds its ids as directly addressable codes: level 0 keeps the low byte of each id, a bitmap says which ids go
on, level 1 keeps the next byte of those, and so on. A rank directory (ones before every 512 bits) turns a
position of one level into the position in the next, so token ``i`` of a segment is read with one byte and one
bit per level and no block is decoded. Segments are rows of a Parquet table, which gives any store Spark can
write to and its commit protocol; the bytes of a row are a self-contained file of this format:

    "DAC1" | documents u32 | levels u32 | tokens u64
    document ids i64[documents] | null flags u8[documents] | end position of each document u64[documents]
    per level: entries u64 | u8[entries] | unless last: bitmap u8[ceil(entries/8)] | ones before each block u32[]
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import staged

END_ID = 0
SEGMENT_TOKENS = 1 << 20
CACHE_WORDS = 1_200_000  # about 60 MB in each worker
_HEADER = struct.Struct("<4sIIQ")
_BLOCK = 512

# A space or line feed between two other characters always begins a new word of byte-level BPE, so a text may
# be cut before it. A word is known by its spelling, with the line feed if it follows one and without the space.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_ANY_SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _SPACES) + "]|^$"
_MARKS = "(?P<marks>[" + "".join(f"\\x{{{ord(c):x}}}" for c in punctuation) + "]+)$"
_JOINED = 20_000
SLICE_CHARS = 1 << 23


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts; words that were seen before come from a bounded cache.

    Only for byte-level BPE whose words begin with their space. ``encode`` gives arrays of little-endian 32-bit
    integers. The cache is one Arrow array of words and one array of ids with the end of each word's share, so
    neither looking up nor learning makes a Python object of a word.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = cache_words
        self.led = {lead: self._begin_with(lead) for lead in " \n"}
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _begin_with(self, lead: str) -> np.ndarray:
        """Whether each token of the vocabulary begins with the character ``lead``."""
        sign = self.tokenizer.encode(lead, add_special_tokens=False).tokens[0]
        out = np.zeros(self.tokenizer.get_vocab_size(), bool)
        out[[k for token, k in self.tokenizer.get_vocab().items() if token.startswith(sign)]] = True
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _store(self, words: pa.Array, ids: list[np.ndarray], sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def _learn(self, words: pa.Array) -> pa.Array:
        """Cache the words, by encoding many of them as one text; gives them in the order in which they are kept."""
        odd = pc.match_substring_regex(pc.utf8_ltrim(words, "\n"), _ANY_SPACE)
        led = pc.starts_with(words, "\n")
        kept = []
        for lead, group in (" ", pc.invert(pc.or_(odd, led))), ("\n", pc.and_not(led, odd)):
            some = words.filter(group)
            for at in range(0, len(some), _JOINED):
                part = pa.concat_arrays([some.slice(at, _JOINED)])
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), lead.strip("\n"))[0].as_py()
                (code,) = self.tokenizer.encode_batch_fast([lead.strip("\n") + joined], add_special_tokens=False)
                ids = np.array(code.ids, "<u4")
                # Words hold no other white space, so only their first tokens begin with the lead.
                sizes = np.diff(np.flatnonzero(self.led[lead][ids]), append=len(ids))
                if len(sizes) != len(part):
                    raise ValueError("the tokenizer joins words with the white space before others")
                self._store(part, [ids], sizes)
            kept.append(some)
        kept.append(words.filter(odd))
        # White space inside would shift the cuts.
        codes = [self._whole(word if word[:1] == "\n" else " " + word) for word in kept[-1].to_pylist()]
        self._store(kept[-1], codes, np.array([len(code) for code in codes], np.int64))
        return pa.concat_arrays(kept)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The places in the cache of distinct words; a new word of letters with marks after it is the ids of both."""
        out = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = out < 0
        new = words.filter(pa.array(missing))
        stems = pc.utf8_rtrim(new, punctuation)
        marked = pc.and_(pc.not_equal(pc.binary_length(stems), pc.binary_length(new)), pc.utf8_is_alpha(pc.utf8_ltrim(stems, "\n")))
        stems, whole, rest = stems.filter(marked), new.filter(marked), new.filter(pc.invert(marked))
        stem_at = pc.index_in(stems, self.words)
        base = len(self.words)
        fresh = self._learn(pc.unique(pa.concat_arrays([rest, stems.filter(pc.is_null(stem_at))])))
        stem_at = pc.coalesce(stem_at, pc.add(pc.index_in(stems, fresh), base)).to_numpy(zero_copy_only=False).astype(np.int64)
        marks = pc.struct_field(pc.extract_regex(whole, _MARKS), [0]).dictionary_encode()
        codes = [self._whole(mark) for mark in marks.dictionary.to_pylist()]
        mark_sizes = np.array([len(code) for code in codes], np.int64)
        mark_ends = len(self.ids) + np.cumsum(mark_sizes)
        mark_at = marks.indices.to_numpy(zero_copy_only=False)
        ends = np.stack([self.ends[1:][stem_at], mark_ends[mark_at]], 1).ravel()
        sizes = np.stack([np.diff(self.ends)[stem_at], mark_sizes[mark_at]], 1)
        self._store(whole, [_shares(np.concatenate([self.ids, *codes]), ends, sizes.ravel())], sizes.sum(1))
        places = np.empty(len(new), np.int64)
        with_marks = marked.to_numpy(zero_copy_only=False)
        places[~with_marks] = base + pc.index_in(rest, fresh).to_numpy(zero_copy_only=False)
        places[with_marks] = base + len(fresh) + np.arange(len(whole))
        out[missing] = places
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; texts are taken in slices of about equal length, whatever their number."""
        begin = size = 0
        for at, text in enumerate(texts, 1):
            size += len(text)
            if size >= SLICE_CHARS or at == len(texts):
                yield from self._slice(texts[begin:at])
                begin, size = at, 0

    def _slice(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each distinct word is looked up once; ids are gathered by the words' numbers."""
        if len(self.words) > self.limit:
            self._forget()
        # A line feed in front makes the first word one after a line feed, and is cut off again.
        even, uneven, kinds = [], [], []
        for text in texts:
            if not text or text[0].isspace():
                kinds.append(None)
            elif _uneven("\n" + text):
                kinds.append(1)
                uneven.append([part[1:] if part[0] == " " else part for part in _CUT.split("\n" + text)])
            else:
                kinds.append(0)
                even.append("\n" + text.replace("\n", " \n"))
        cuts = pc.split_pattern(pa.array(even, pa.string()), " "), pa.array(uneven, pa.list_(pa.string()))
        parts = pa.concat_arrays([pc.list_flatten(cut) for cut in cuts]).dictionary_encode()
        numbers = self._numbers(parts.dictionary)[parts.indices.to_numpy(zero_copy_only=False)]
        sizes = np.diff(self.ends)[numbers]
        ids = _shares(self.ids, self.ends[1:][numbers], sizes)
        place, shift, docs = np.concatenate([[0], np.cumsum(sizes)]), 0, []
        for cut in cuts:
            bounds = place[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]).astype(np.int64) + shift]
            docs.append(iter(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)))
            shift += len(pc.list_flatten(cut))
        for text, kind in zip(texts, kinds, strict=True):
            if kind is None:
                yield self._whole(text)
            else:
                begin, end = next(docs[kind])
                yield ids[begin + 1 : end]


def _shares(ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` that end at ``ends``, one after the other."""
    at = np.repeat(ends - np.cumsum(sizes), sizes)
    at += np.arange(len(at))
    return ids[at]


def _uneven(text: str) -> bool:
    """Whether white space stands beside white space, or at the end; of the first character only the next counts."""
    return any(
        c in text and (c + " " in text or " " + c in text or c + "\n" in text or "\n" + c in text or text[-1] == c) for c in _SPACES
    )


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so that its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The bytes of one segment."""
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64)
    values = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    null = np.array([d is None for d in doc_ids], np.uint8)
    levels = []
    rest = values
    while True:
        more = rest > 0xFF
        levels.append((rest & 0xFF).astype(np.uint8))
        if not more.any():
            break
        levels.append(more)
        rest = rest[more] >> 8
    out = [
        _HEADER.pack(b"DAC1", len(doc_ids), len(levels) // 2 + 1, len(values)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), null.tobytes(), ends.astype("<u8").tobytes(),
    ]
    for low, more in zip(levels[::2], [*levels[1::2], None], strict=True):
        out += [struct.pack("<Q", len(low)), low.tobytes()]
        if more is not None:
            ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.int64))])
            out += [np.packbits(more, bitorder="little").tobytes(), ones[:-1].astype("<u4").tobytes()]
    return b"".join(out)


class Segment:
    """A segment read in place; ``data`` may be any buffer, also a mapped file."""

    def __init__(self, data):
        magic, docs, levels, self.n_tokens = _HEADER.unpack_from(data)
        if magic != b"DAC1":
            raise ValueError("not a segment of this format")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.null, self.ends = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
        self.levels = []
        for k in range(levels):
            n = int(take("<u8", 1)[0])
            low = take("u1", n)
            last = k == levels - 1
            self.levels.append((low, None, None) if last else (low, take("u1", (n + 7) // 8), take("<u4", -(-n // _BLOCK))))

    def token(self, i: int) -> int:
        """Token ``i`` without decoding any other."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (low, more, ones) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if more is None or not more[i >> 3] >> (i & 7) & 1:
                break
            block = i // _BLOCK
            before = np.unpackbits(more[block * _BLOCK // 8 : (i >> 3) + 1], bitorder="little")
            i = int(ones[block]) + int(before[: i - block * _BLOCK].sum())
        return value

    def tokens(self) -> np.ndarray:
        """All ids in order."""
        values = np.zeros(0, np.uint32)
        for low, more, _ in reversed(self.levels):
            here = low.astype(np.uint32)
            if more is not None:
                here[np.flatnonzero(np.unpackbits(more, count=len(low), bitorder="little"))] |= values << 8
            values = here
        return values


def token_segments(docs: DataFrame, path: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Rows of segments over ``docs`` (doc_id long, text string), in ascending order of doc_id.

    part, seg: place in the order; before: tokens of the same part that stand before the segment. Every
    document ends with ``end_id``. A null text is the empty one. Null ids come first; rows that share an id are
    ordered by a hash of their text, and repeated rows are all kept. Other columns are left out. An empty table
    gives no rows.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, words = TaskContext.get().partitionId(), encoder(path)
        end = np.array([end_id], np.uint32)
        doc_ids, ids, held, seg, before = [], [], 0, 0, 0

        def close() -> pd.DataFrame:
            nonlocal doc_ids, ids, held, seg, before
            row = pd.DataFrame({"part": [part], "seg": [seg], "before": [before], "n_tokens": [held], "segment": [pack_segment(doc_ids, ids)]})
            seg, before = seg + 1, before + held
            doc_ids, ids, held = [], [], 0
            return row

        for batch in batches:
            for doc_id, null, code in zip(batch["doc_id"].tolist(), batch["null"].tolist(), words.encode(batch["text"].tolist()), strict=True):
                doc_ids.append(None if null else doc_id)
                ids.append(np.concatenate([code, end]))
                held += len(ids[-1])
                if held >= segment_tokens:
                    yield close()
        if doc_ids:
            yield close()

    key = F.xxhash64("text")
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), key)
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key)
    )
    ready = ordered.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("null"), "text")
    return ready.mapInPandas(encode, "part int, seg int, before long, n_tokens long, segment binary")


def write_tokens(docs: DataFrame, path: str, **how) -> DataFrame:
    """Encode and write; the segments as read back from their files."""
    return staged(token_segments(docs, path, **how), "tokens")


def documents_of(segments: DataFrame) -> DataFrame:
    """One row per document of written segments: doc_id, start, n_tokens, ids_crc32, part, seg.

    What goes through the driver is one total per part, so no more than the shuffle has partitions.
    """
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, base = {}, 0
    for row in totals:
        bases[row["part"]] = base
        base += row["n"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seg, before, data in zip(batch["part"], batch["seg"], batch["before"], batch["segment"], strict=True):
                segment = Segment(data)
                ids = segment.tokens().astype("<u4", copy=False)
                begins = np.concatenate([[0], segment.ends[:-1]])
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), segment.ends.tolist(), strict=True)]
                yield pd.DataFrame({
                    "doc_id": pd.array(np.where(segment.null == 1, 0, segment.doc_ids), "Int64").copy(),
                    "start": begins + before + bases[part], "n_tokens": segment.ends - begins, "ids_crc32": crcs,
                    "part": part, "seg": seg, "null": segment.null == 1,
                })

    rows = segments.select("part", "seg", "before", "segment").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seg int, null boolean"
    )
    return rows.select(F.when(~F.col("null"), F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32", "part", "seg")
