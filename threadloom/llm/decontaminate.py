"""Passages of benchmark items in documents, found through the CGK embedding.

CGK walks along a string and, at each step, writes the character it stands on and moves on or stays, as a random
bit of step and character says, so strings that differ by few edits write mostly the same and edit distance becomes
Hamming distance. A walk that lost its twin finds it again late or never. So the embedding of a window of an item's size is
put together from walks of ``STEPS`` steps that begin anew at every ``STRIDE``-th character of the text; windows
of all items and places share them. Items are walked from each of their characters, so any place of a window meets
its own. Bit sampling compares ``SAMPLE`` random steps of a walk at once: a window and an item are candidates if
samples at two of its walks agree (one, for items under ``SHORT`` characters), at places that lie apart as they do in
the item but for a part of the edits allowed: where edits lie close together the rest of a copy is whole. Walks and samples are repeated until edited copies of the items, at the
largest allowed distance, are missed no more often than the wanted recall allows. Candidates are
verified exactly with the bit-parallel edit distance, many at a time.

Texts are compared in lower case with white space as one space.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RATE = 0.2  # edits allowed for each character of an item
RECALL = 0.999
STEPS = 24
SAMPLE = 12
STRIDE = 2  # 1 for items under SHORT characters
SHORT = 48
REPEATS = 8
APART = 12  # between the beginnings of two walks, as far as a walk gets on average
TRIALS = 400
NEAR = 8  # two walks may be displaced by this part of the edits allowed
BATCH = 2048
SLICE_CHARS = 4_000_000
_GROUP = 500_000
_STARTS = 1 << 15
_MARKS = 1 << 22
_HELD = 4_000_000
_WIDE = 64
_FEW = 16

def _search(pattern: Sequence, text: Sequence) -> tuple[int, int]:
    """Least edit distance between the pattern and any part of the text, and where the first such part ends."""
    masks: dict = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score, best = full, 0, len(pattern), (len(pattern), 0)
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if score < best[0]:
            best = score, at
    return best


def best_part(pattern: str, text: str, limit: int | None = None) -> tuple[int, int, int]:
    """Least edit distance of the pattern to a part of the text, with the bounds of that part; none above ``limit``."""
    distance, end = _search(pattern, text)
    if not end or limit is not None and distance > limit:
        return distance, 0, 0
    _, length = _search(pattern[::-1], text[:end][::-1])
    return distance, end - length, end


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def within(patterns: list[np.ndarray], texts: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """Whether each text, as codes, has a part within ``limits`` edits of its pattern; patterns are not empty."""
    out = np.zeros(len(patterns), bool)
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.lexsort((lengths, [-(-len(p) // 64) for p in patterns])) if len(patterns) else np.zeros(0, np.int64)
    # Batches of like length, as the longest text decides how many steps all take.
    cuts = [0]
    while cuts[-1] < len(order):
        rest = lengths[order[cuts[-1] : cuts[-1] + BATCH]]
        unlike = np.flatnonzero((rest > 1.3 * rest[0] + 32) | (rest < rest[0]))
        cuts.append(cuts[-1] + (int(unlike[0]) if len(unlike) else len(rest)))
    for low, high in pairwise(cuts):
        rows = order[low:high]
        out[rows] = _within([patterns[r] for r in rows], [texts[r] for r in rows], limits[rows])
    return out


def _within(patterns: list[np.ndarray], texts: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    n, size = len(patterns), np.array([len(p) for p in patterns])
    width, length = int(-(-size.max() // 64)), max(map(len, texts))
    if width > _WIDE or n < _FEW:  # one long number for each pattern
        found = (_search(p.tolist(), t.tolist())[0] for p, t in zip(patterns, texts, strict=True))
        return np.fromiter(found, np.int64, n) <= limits
    own: dict[int, int] = {}
    which = np.array([own.setdefault(id(p), len(own)) for p in patterns])
    firsts = np.unique(which, return_index=True)[1]
    chars = np.unique(np.concatenate([patterns[k] for k in firsts]))
    kind = np.uint8 if len(chars) < 256 else np.uint32
    place = np.full(int(chars[-1]) + 2, len(chars), kind)  # the last code: in no pattern
    place[chars] = np.arange(len(chars))
    table = np.full((n, length), len(chars), kind)
    for k, t in enumerate(texts):
        place.take(t, mode="clip", out=table[k, : len(t)])
    table = np.ascontiguousarray(table.T)
    masks = np.zeros((width, len(own) * (len(chars) + 1)), np.uint64)
    for k, first in enumerate(firsts):
        i = np.arange(size[first])
        np.bitwise_or.at(masks, (i // 64, k * (len(chars) + 1) + place[patterns[first]].astype(np.int64)), np.uint64(1) << (i % 64).astype(np.uint64))
    base = which * (len(chars) + 1)
    one, high = np.uint64(1), np.uint64(63)
    plus, minus = np.full((width, n), ~np.uint64(0)), np.zeros((width, n), np.uint64)
    last, bit = (size - 1) // 64, ((size - 1) % 64).astype(np.uint64)
    score, best, every = size.copy(), size.copy(), np.arange(n)
    for step in range(length):
        at = base + table[step]
        carry, up_in, down_in = np.zeros((3, n), np.uint64)
        ups, downs = np.empty((2, width, n), np.uint64)
        for w in range(width):
            eq, p, m = masks[w].take(at), plus[w], minus[w]
            both = eq & p
            part = both + p
            total = part + carry if w else part
            diagonal = (total ^ p) | eq | m
            up, down = np.bitwise_or(m, ~(diagonal | p), out=ups[w]), np.bitwise_and(p, diagonal, out=downs[w])
            up, down = up << one | up_in, down << one | down_in
            if w < width - 1:
                carry = ((part < p) | (total < part)).astype(np.uint64)
                up_in, down_in = ups[w] >> high, downs[w] >> high
            plus[w], minus[w] = down | ~(diagonal | up), up & diagonal
        up, down = (ups[0], downs[0]) if width == 1 else (ups[last, every], downs[last, every])
        score += (up >> bit & one).astype(np.int64) - (down >> bit & one).astype(np.int64)
        np.minimum(best, score, out=best)
    return best <= limits


def laid(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in one line with zeros after each, every one at a multiple of the stride; their starts and sizes."""
    sizes = np.array([len(c) for c in codes], np.int64)
    room = (sizes // STRIDE + 1) * STRIDE
    starts = np.cumsum(room) - room
    line = np.zeros(room.sum() + 1, np.uint8)
    for a, c in zip(starts, codes, strict=True):
        line[a : a + len(c)] = fold(c)
    return line, starts, sizes


class Walks:
    """Walks of one length, their samples, and where the items of one class of lengths have them."""

    def __init__(self, index: ItemIndex, own: np.ndarray, steps: int, seed: int):
        self.size, self.slack, self.own = index.size, index.limit // 8, own
        self.limit, self.short = index.limit, int(index.size[own[0]]) < SHORT
        self.stride = 1 if self.short else STRIDE
        self.steps, self.seed = steps, seed
        # The end of a text is 0, on which a walk stays.
        ends = np.cumsum(index.size[own] + 1)
        self.line = np.concatenate([np.append(fold(index.codes[k]), np.uint8(0)) for k in own] + [np.zeros(1, np.uint8)])
        self.item = np.repeat(own, index.size[own] + 1)
        self.offset = np.arange(ends[-1]) - np.repeat(ends - index.size[own] - 1, index.size[own] + 1)
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def _walk(self, line: np.ndarray, starts: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
        """A number for the sampled steps of each walk, and where it ends."""
        rng = np.random.default_rng((self.seed, self.steps, repeat))
        moves = rng.integers(0, 2, (self.steps, 256), np.int32)
        moves[:, 0] = 0
        values = rng.integers(0, 1 << 63, (self.steps, 256), np.int64)
        sampled = np.zeros(self.steps, bool)
        sampled[rng.choice(self.steps, max(1, round(self.steps * SAMPLE / STEPS)) if self.steps >= SAMPLE else self.steps, replace=False)] = True
        keys, ends = np.zeros(len(starts), np.int64), np.empty(len(starts), np.int32)
        for low in range(0, len(starts), _STARTS):
            at = starts[low : low + _STARTS].astype(np.int32)
            key = keys[low : low + _STARTS]
            for step in range(self.steps):
                c = line.take(at)
                if sampled[step]:
                    key ^= values[step].take(c)
                at += moves[step].take(c)
            ends[low : low + _STARTS] = at
        return keys, ends

    def add(self) -> None:
        """One more walk with its sample."""
        keys, ends = self._walk(self.line, np.arange(len(self.item)), len(self.tables))
        fine = np.flatnonzero(self.offset + ends - np.arange(len(ends)) <= self.size[self.item])
        fine = fine[self.line[fine] > 0]
        order = fine[np.lexsort((self.offset[fine], self.item[fine], keys[fine]))]
        # Of equal walks that begin close together in an item one is enough, as windows have that much more room.
        while True:
            k, i, o = keys[order], self.item[order], self.offset[order]
            close = np.zeros(len(order), bool)
            close[1:] = (k[1:] == k[:-1]) & (i[1:] == i[:-1]) & (o[1:] - o[:-1] <= self.slack[i[1:]])
            close[1:] &= ~close[:-1]
            if not close.any():
                break
            order = order[~close]
        seen = np.zeros(_MARKS, bool)
        seen[k & _MARKS - 1] = True
        self.tables.append((k, i, o, seen))

    def candidates(self, line: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, begin, end) of windows that agree with an item; those of one text and item are apart.

        ``line`` holds the texts, each from a place in ``starts`` that the stride divides, and zeros between them.
        """
        at = np.concatenate([np.arange(a, a + n, self.stride) for a, n in zip(starts, sizes, strict=True)])
        text = np.repeat(np.arange(len(starts)), -(-sizes // self.stride))
        shift, n_items = int(self.size.max()), len(self.size)
        key, begun = [], []
        for repeat, (keys, item, offset, seen) in enumerate(self.tables):
            here, _ = self._walk(line, at, repeat)
            hit = np.flatnonzero(seen.take(here & _MARKS - 1))
            low = np.searchsorted(keys, here[hit], "left")
            count = np.searchsorted(keys, here[hit], "right") - low
            hit, low, count = hit[count > 0], low[count > 0], count[count > 0]
            pick = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            hit = np.repeat(hit, count)
            key.append((text[hit] * n_items + item[pick] << 32) + at[hit] - starts[text[hit]] - offset[pick] + shift)
            begun.append(at[hit])
        key, begun = np.concatenate(key), np.concatenate(begun)
        if not len(key):
            return []
        order = np.argsort(key, kind="stable")
        key, begun = key[order], begun[order]
        who = key >> 32
        place = (key & 0xFFFFFFFF) - shift
        room = (self.limit // NEAR + self.slack)[who % n_items]
        first = np.flatnonzero(np.insert((who[1:] != who[:-1]) | (place[1:] - place[:-1] > room[1:]), 0, True))
        last = np.append(first[1:], len(who)) - 1
        if not self.short:
            apart = np.maximum.reduceat(begun, first) - np.minimum.reduceat(begun, first) >= APART
            first, last = first[apart], last[apart]
        if not len(first):
            return []
        who, low, high = who[first], place[first], place[last]
        size, limit, slack = (x[who % n_items] for x in (self.size, self.limit, self.slack))
        # All edits together are within the limit, before and after the walk.
        a = np.maximum(0, low - limit - slack)
        b = np.minimum(sizes[who // n_items], high + size + limit + slack)
        first = np.flatnonzero(np.insert((who[1:] != who[:-1]) | (a[1:] > b[:-1]), 0, True))
        last = np.append(first[1:], len(who)) - 1
        out = zip((who[first] // n_items).tolist(), (who[first] % n_items).tolist(), a[first].tolist(), b[last].tolist(), strict=True)
        return [w for w in out if w[2] < w[3]]


def fold(codes: np.ndarray) -> np.ndarray:
    """Characters as the numbers that walks write, 1 to 255."""
    return (codes % 255 + 1).astype(np.uint8)


def edited(text: str, edits: int, rng: random.Random) -> str:
    """The text after random substitutions, insertions and deletions, or with that many characters replaced by a foreign one."""
    chars = list(text)
    if rng.random() < 0.5:
        for k in rng.sample(range(len(chars)), min(edits, len(chars))):
            chars[k] = "\0"
        return "".join(chars)
    for _ in range(edits):
        k, what = rng.randrange(len(chars) or 1), rng.random()
        chars[k : k + (what > 1 / 3)] = rng.choice(text) if what < 2 / 3 else ""
    return "".join(chars)


class ItemIndex:
    """Everything about a slice of the benchmark that tasks need; made on the driver, sent with the task."""

    def __init__(self, items: list[tuple[int, str]], max_rate: float, recall: float = RECALL, seed: int = 7):
        kept = [(i, " ".join(words)) for i, text in items if (words := (text or "").lower().split())]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.codes = [_codes(t) for t in self.texts]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.limit = np.array([int(max_rate * n) for n in self.size], np.int64)
        # Steps after which an unbroken piece or a third of the item is written; 0: as many edits as characters, so anything may fit.
        steps = np.minimum(STEPS, np.maximum(self.size // (self.limit + 1), np.where(self.limit < self.size, self.size // 3, 0)))
        self.any = np.flatnonzero(steps == 0)
        self.sections = [np.array_split(c, -(-len(c) // 64)) for c in self.codes]
        self.walks = []
        for n in sorted(set(steps.tolist()) - {0}):
            for short in (True, False):
                own = np.flatnonzero((steps == n) & ((self.size < SHORT) == short))
                if len(own):
                    self.walks.append(self._repeated(Walks(self, own, n, seed), recall, seed))

    def _repeated(self, walks: Walks, recall: float, seed: int) -> Walks:
        """Walks added until copies with as many edits as are allowed are candidates as often as wanted."""
        rng = random.Random(seed)
        some = [rng.choice(walks.own) for _ in range(TRIALS)]
        rest = [(int(k), _codes(edited(self.texts[k], int(self.limit[k]), rng))) for k in some]
        rest = [(k, c) for k, c in rest if len(c)]
        missed = len(rest)
        while len(walks.tables) < REPEATS and (not walks.tables or missed > (1 - recall) * len(some)):
            walks.add()
            found = {(d, k) for d, k, _, _ in walks.candidates(*laid([c for _, c in rest]))}
            missed = sum((d, k) not in found for d, (k, _) in enumerate(rest))
        return walks

    def windows(self, codes: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, item, begin, end): parts of the texts that may hold copies of the item."""
        out = [(d, int(k), 0, len(c)) for k in self.any for d, c in enumerate(codes) if len(c)]
        line, starts, sizes = laid(codes)
        for walks in self.walks:
            out += walks.candidates(line, starts, sizes)
        return sorted(out)

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, distance, first word, word after the last) of every passage, each once."""
        if not self.ids:
            return []
        out: list[tuple[int, int, int, int, int]] = []
        held: list[tuple[int, str, np.ndarray, int, int, int]] = []
        group: list[tuple[int, str, np.ndarray]] = []
        chars = size = 0
        for d, text in enumerate(texts):
            plain = " ".join((text or "").lower().split())
            group.append((d, plain, _codes(plain)))
            chars += len(plain)
            if chars >= _GROUP or d == len(texts) - 1:
                for n, k, a, b in self.windows([c for _, _, c in group]):
                    held.append((*group[n], k, a, b))
                    size += b - a
                    if size >= _HELD:
                        out += self._verified(held)
                        held, size = [], 0
                group, chars = [], 0
        return sorted([*out, *self._verified(held)])

    def _verified(self, windows: list[tuple[int, str, np.ndarray, int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        # Long windows in parts of like length, which overlap by the longest copy.
        parts = []
        for n, (_, _, _, k, a, b) in enumerate(windows):
            longest = int(self.size[k] + self.limit[k])
            parts += ((n, x, min(b, x + 2 * longest)) for x in range(a, max(a + 1, b - longest), longest))
        near = self._near(windows, parts)
        parts = [part for part, fine in zip(parts, near, strict=True) if fine]
        items = np.array([windows[n][3] for n, _, _ in parts], np.int64)
        hits = within([self.codes[k] for k in items], [windows[n][2][x:y] for n, x, y in parts], self.limit[items])
        joined: list[list[int]] = []
        for (n, x, y), hit in zip(parts, hits, strict=True):
            if hit and joined and joined[-1][0] == n and x <= joined[-1][2]:
                joined[-1][2] = y
            elif hit:
                joined.append([n, x, y])
        for n, x, y in joined:
            d, plain, _, k, _, _ = windows[n]
            yield from ((d, self.ids[k], *passage) for passage in self._passages(plain, k, x, y))

    def _near(self, windows: list[tuple[int, str, np.ndarray, int, int, int]], parts: list[tuple[int, int, int]]) -> np.ndarray:
        """Whether a section of the item, of at most 64 characters, has no more than its share of the edits, as one of every copy has."""
        which, sections, texts, limits = [], [], [], []
        for at, (n, x, y) in enumerate(parts):
            _, _, codes, k, a, b = windows[n]
            own, size, begin = self.sections[k], int(self.size[k]), 0
            # Within a window a section has its place but for the edits; the ends of the text and of a part of a window say nothing.
            left, right = x == a > 0, y == b < len(codes)
            for section in own:
                end = begin + len(section)
                which.append(at)
                sections.append(section)
                texts.append(codes[x + begin if left else x : max(x, y - size + end) if right else y])
                limits.append(int(self.limit[k]) // len(own))
                begin = end
        out = np.zeros(len(parts), bool)
        out[np.array(which, np.int64)[within(sections, texts, np.array(limits, np.int64))]] = True
        return out

    def _passages(self, text: str, k: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """The nearest passage of a window, and those on either side of it."""
        todo = [(low, high)]
        ends = np.cumsum([len(w) + 1 for w in text.split(" ")])
        spans: list[tuple[int, int]] = []
        limit = int(self.limit[k])
        while todo:
            low, high = todo.pop()
            distance, a, b = best_part(self.texts[k], text[low:high], limit)
            if distance > limit or b <= a:
                continue
            a, b = a + low, b + low
            first, after = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right")) + 1
            # Passages that share a word are one, the nearest.
            if not any(first < y and x < after for x, y in spans):
                spans.append((first, after))
                yield distance, first, after
            todo += [(low, a), (b, high)]


def item_indexes(benchmark: DataFrame, max_rate: float = MAX_RATE, recall: float = RECALL, slice_chars: int = SLICE_CHARS) -> Iterator[ItemIndex]:
    """The benchmark in slices of about ``slice_chars`` characters, one after the other.

    Rows without an id or without words are no items. Equal rows count once.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").dropna().distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // slice_chars))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield ItemIndex(sorted((r["item_id"], r["text"]) for r in rows), max_rate, recall)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Passages of benchmark items in ``docs``: doc_id, item_id, distance, first_word, end_word.

    A passage is reported if its edit distance to the item is at most ``max_rate`` of the item's length. Words
    are counted in the whole text, split at white space. A null text has no words. Rows that share an id are
    searched each on its own. Other columns are left out. An empty table on either side gives no rows. The
    benchmark travels in slices of bounded size, and documents are read once per slice.
    """
    parts = []
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    for index in item_indexes(benchmark, **how):

        def search(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = index.find(batch.column("text").to_pylist())
                d, i, n, a, b = zip(*found, strict=True) if found else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(d, pa.int64())), *(pa.array(x, pa.int64()) for x in (i, n, a, b))],
                    names=["doc_id", "item_id", "distance", "first_word", "end_word"],
                )

        parts.append(narrow.mapInArrow(search, "doc_id long, item_id long, distance long, first_word long, end_word long"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that hold a passage of a benchmark item; all columns stay as they are."""
    for index in item_indexes(benchmark, **how):

        def clean(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in index.find(batch.column(text_at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        text_at = docs.columns.index("text")
        docs = docs.mapInArrow(clean, docs.schema)
    return docs
