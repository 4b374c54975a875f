"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, as_bytes, blocks, checkpointed, mixed, prepare

#: An item is found if a passage is within this share of the item's bytes in edits.
EDIT_SHARE = 0.06
#: Edits allowed for a short item all the same: an exchanged word of nine letters.
WORD_EDITS = 9
#: Items of fewer bytes after normalisation are found only as they are, between other characters than letters and digits.
SHORT = 16
#: Bytes of the grams by which windows that can't be within the radius are set aside.
GRAM = 8
#: Lengths of the items of one class differ by at most this factor.
CLASS = 1.2
#: Places of an embedding that one table samples, tables of one walk, and the most walks of a class: each walk is another chance
#: for strings to fall into step again.
SAMPLED, TABLES, MOST_WALKS = 3, 16, 8
#: The share of passages at the edge of their radius that a class's tables are to find, as trial edits show.
RECALL = 0.99
#: Bytes between the places where windows are looked at together.
STRIDE = 8
#: Places of shared grams held at once, windows embedded at once, bytes of texts searched at once.
POSTINGS, WINDOWS, SEARCHED = 1 << 20, 1 << 12, 1 << 20
#: Items of one block, and their bytes.
BLOCK_ITEMS, BLOCK_ITEM_BYTES = 4096, 4 << 20
#: Bits of the filter over the grams of all items, by which rows are set aside before the blocks, if there are several.
FILTER_BITS = 1 << 27


#: Bytes of words: ASCII letters and digits, and whatever lies beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z and Latin-1 capitals lower-cased and white space runs made one space, offsets, source index)."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[capital] += 32
    space = (low == 32) | (low >= 9) & (low <= 13)
    low[space] = 32
    keep = np.ones(len(data), bool)
    if len(data) > 1:
        keep[1:] = ~(space[1:] & space[:-1])
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        keep[inner] = True
    index = np.flatnonzero(keep)
    return low[index], np.searchsorted(index, offsets), index


def normal(text: str) -> bytes:
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" ")


def grams(data: np.ndarray) -> np.ndarray:
    """The GRAM = 8 bytes from each position on as one number, mixed; fewer at the end count as zeros."""
    x = np.zeros(len(data) + GRAM, np.uint64)
    x[: len(data)] = data
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    return ((x[: len(data)] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int32)


def radius(n: int, share: float) -> int:
    """Edits allowed for an item of n bytes, a word at least; so few that a passage within them keeps one gram at least."""
    return max(0, min(max(int(share * n), WORD_EDITS), (n - GRAM) // GRAM))


class Walks:
    """CGK's random walks: step j gives the byte under the pointer, which then moves on or stays as a random bit of (j, byte) says.

    Strings a few edits apart fall into step again soon after each edit, so their embeddings differ in few places.
    """

    def __init__(self, walks: int, steps: int, seed: int = 11):
        self.moves = np.random.default_rng(seed).integers(0, 2, (walks, steps, 256), np.uint8)

    def of(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(windows, walks * steps) bytes of the embeddings of data[start : start + length]; 0 behind a window's end."""
        walks, steps, _ = self.moves.shape
        at = np.repeat(start.astype(np.int64)[None], walks, 0)
        stop, rows = np.minimum(start + length, len(data)), np.arange(walks)[:, None]
        out = np.zeros((walks, steps, len(start)), np.uint8)
        for j in range(steps):
            byte = np.where(at < stop, data[np.minimum(at, len(data) - 1)], 0)
            out[:, j] = byte
            at += self.moves[rows, j, byte]
        return out.reshape(walks * steps, len(start)).T


@dataclass
class Class:
    """Items of similar length with their tables. direct: MOST_WALKS would fall short of RECALL, so all windows are verified."""

    low: int
    high: int
    edits: int
    least: int  # grams that a passage within the radius shares with its item
    walk: Walks
    places: np.ndarray  # (tables, SAMPLED): the places that each table samples, all of one walk
    recall: float
    direct: bool
    keys: np.ndarray  # of all tables, ascending, with the item of each
    items: np.ndarray

    def hashed(self, embedded: np.ndarray) -> np.ndarray:
        """(windows, tables): a number of the table and the bytes it samples."""
        x = np.zeros((len(embedded), len(self.places)), np.uint64) + np.arange(1, len(self.places) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(self.places.shape[1]):
            x = mixed(x + embedded[:, self.places[:, k]])
        return x


def edited(item: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """The item after single-byte edits at random."""
    out = bytearray(item)
    for _ in range(edits):
        at, kind, byte = int(rng.integers(len(out) + 1)), rng.integers(3), int(rng.integers(97, 123))
        if kind == 0 and at < len(out):
            out[at] = byte
        elif kind == 1 and at < len(out) and len(out) > 1:
            del out[at]
        else:
            out.insert(at, byte)
    return bytes(out)


def reworded(item: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """The item with words exchanged for others of random letters, as far as the edits go."""
    words = item.split(b" ")
    for _ in range(8):
        k = int(rng.integers(len(words)))
        size = int(rng.integers(1, 10))
        if max(len(words[k]), size) <= edits:
            edits -= max(len(words[k]), size)
            words[k] = rng.integers(97, 123, size, np.uint8).tobytes()
    return b" ".join(words)


class Finder:
    """The index of one block of items: classes by length and the places of every gram. Deterministic."""

    def __init__(self, items: list[tuple[object, str]], share: float = EDIT_SHARE):
        every_item = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.short: dict[int, dict[bytes, list]] = {}
        for i, t in every_item:
            if len(t) < SHORT:
                self.short.setdefault(len(t), {}).setdefault(t, []).append(i)
        self.short_keys = {n: np.sort(RollingHash(np.frombuffer(b"".join(held), np.uint8)).of(np.arange(len(held)) * n, np.arange(1, len(held) + 1) * n)) for n, held in self.short.items()}
        kept = [(i, t) for i, t in every_item if len(t) >= SHORT]
        self.ids, self.texts = [i for i, _ in kept], [t for _, t in kept]
        self.share = share
        self.radii = [radius(len(t), share) for t in self.texts]
        self.table = np.zeros(1 << 24, bool)
        made = [grams(np.frombuffer(t, np.uint8))[: len(t) - GRAM + 1] for t in self.texts]
        every = np.concatenate(made) if made else np.zeros(0, np.int32)
        self.table[every] = True
        by = np.argsort(every, kind="stable")
        self.post_item = np.repeat(np.arange(len(made)), [len(g) for g in made])[by]
        self.post_at = np.concatenate([np.arange(len(g)) for g in made])[by] if made else every
        # the grams, ascending, and where the postings of each begin and end
        self.kinds, many = np.unique(every, return_counts=True)
        self.until = np.cumsum(many)
        self.since = self.until - many
        self.longest = max(map(len, self.texts), default=0)
        self.edits, self.sizes = np.array(self.radii, np.int64), np.array([*map(len, self.texts)], np.int64)
        self.least = np.array([len(t) - GRAM + 1 - GRAM * e for t, e in zip(self.texts, self.radii)], np.int64)
        self.classes: list[Class] = []
        order = sorted(range(len(self.texts)), key=lambda k: len(self.texts[k]))
        while order:
            low = len(self.texts[order[0]])
            own = [k for k in order if len(self.texts[k]) <= low * CLASS]
            order = order[len(own) :]
            self.classes.append(self._class(own))
        self.class_of = np.zeros(len(self.texts), np.int64)
        for k, c in enumerate(self.classes):
            self.class_of[np.unique(c.items)] = k

    def _class(self, own: list[int]) -> Class:
        lengths = [len(self.texts[k]) for k in own]
        edits, least = max(self.radii[k] for k in own), int(min(self.least[k] for k in own))
        rng, steps = np.random.default_rng(len(own)), min(lengths)
        embed = lambda walk, texts: walk.of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts[:-1])]), np.array([*map(len, texts)]))
        # how often passages at the edge of the radius agree with their item in one place of each walk
        some = [own[int(k)] for k in rng.integers(0, len(own), 60)]
        all_ = Walks(MOST_WALKS, steps)
        same = embed(all_, [self.texts[k] for k in some]) == embed(all_, [(edited, reworded)[n % 2](self.texts[k], self.radii[k], rng) for n, k in enumerate(some)])
        missed = (1 - same.reshape(len(some), MOST_WALKS, steps).mean(2) ** SAMPLED) ** TABLES
        recall = lambda walks: float(1 - missed[:, :walks].prod(1).mean())
        walks = next((n for n in range(1, MOST_WALKS) if recall(n) >= RECALL), MOST_WALKS)
        walk, tables = Walks(MOST_WALKS, steps), walks * TABLES
        walk.moves = walk.moves[:walks]
        places = rng.integers(0, steps, (tables, SAMPLED)) + np.repeat(np.arange(walks) * steps, TABLES)[:, None]
        made = Class(min(lengths), max(lengths), edits, least, walk, places, recall(walks), recall(walks) < RECALL, np.zeros(0), np.zeros(0))
        keys = made.hashed(embed(walk, [self.texts[k] for k in own])).ravel()
        order = np.argsort(keys, kind="stable")
        made.keys, made.items = keys[order], np.repeat(np.array(own), tables)[order]
        return made

    def in_tables(self, data: np.ndarray, c: Class, start: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether the window at start of the item's size falls together with the item in a table of its class."""
        out = np.zeros(len(start), bool)
        for k in range(0, len(start), WINDOWS):
            begin, wanted = np.maximum(start[k : k + WINDOWS], 0), item[k : k + WINDOWS]
            keys = c.hashed(c.walk.of(data, begin, self.sizes[wanted]))
            low, high = np.searchsorted(c.keys, keys, "left"), np.searchsorted(c.keys, keys, "right")
            for n in range(int((high - low).max(initial=0))):
                held = low + n < high
                out[k : k + WINDOWS] |= (held & (c.items[np.minimum(low + n, len(c.items) - 1)] == wanted[:, None])).any(1)
        return out

    def regions(self, offsets: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """(begin, end) byte ranges that hold all windows, from any byte on, with enough grams of items for some item's radius."""
        n = len(sums) - 1
        heads = np.arange(0, n, STRIDE)
        spans = []
        for c in self.classes:
            # a window that begins within the stride lies in [head, head + STRIDE + high + edits)
            ends = np.minimum(heads + STRIDE + c.high + c.edits, n)
            some = heads[sums[ends] - sums[heads] >= c.least]
            spans.append(np.stack([some, np.minimum(some + STRIDE + c.high + c.edits, n)], 1))
        spans = np.concatenate(spans)
        if not len(spans):
            return spans
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        reach = np.maximum.accumulate(spans[:, 1])
        new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
        return np.stack([spans[new, 0], reach[np.concatenate((new[1:] - 1, [len(spans) - 1]))]], 1)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, start, item) of windows that fall together with their item in a table.

        A gram shared at offset o of the item and position p of the text puts the passage's start at p - o, off by
        at most the radius. A passage within the radius shares least grams so; only such windows are embedded.
        """
        n = len(data)
        if not n or not self.texts:
            return []
        own = grams(data)
        hit = self.table[own]
        sums = np.zeros(n + 1, np.int32)
        np.cumsum(hit, out=sums[1:])
        regions = self.regions(offsets, sums)
        found: set[tuple[int, int, int]] = set()
        at = 0
        while at < len(regions):
            # regions together, up to as many postings as are held at once
            to, pos, many = at, [], 0
            while to < len(regions) and (to == at or many < POSTINGS):
                more = regions[to, 0] + np.flatnonzero(hit[regions[to, 0] : regions[to, 1]])
                pos.append(more)
                kind = np.searchsorted(self.kinds, own[more])
                many += int((self.until[kind] - self.since[kind]).sum())
                to += 1
            at = to
            p = np.concatenate(pos)
            kind = np.searchsorted(self.kinds, own[p])
            begin, count = self.since[kind], self.until[kind] - self.since[kind]
            k = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            item = self.post_item[k].astype(np.int64)
            where = np.repeat(p, count)
            text = np.searchsorted(offsets, where, side="right") - 1
            start = where - self.post_at[k]
            order = np.lexsort((start, item, text))
            text, item, start = text[order], item[order], start[order]
            # one number ascending over (text, item, start): starts of one text and item in a row
            run = np.cumsum(np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])))) - 1 if len(text) else text
            line = run * (4 * (n + self.longest + 1)) + start + self.longest
            most = self.edits[item]
            near = np.searchsorted(line, line + 2 * most, side="right") - np.searchsorted(line, line - 2 * most)
            ok = np.flatnonzero(near >= self.least[item])
            ok = ok[np.concatenate(([True], line[ok][1:] != line[ok][:-1]))] if len(ok) else ok  # each window once
            for k in np.unique(self.class_of[item[ok]]):
                own, c = ok[self.class_of[item[ok]] == k], self.classes[k]
                if not c.direct:
                    own = own[self.in_tables(data, c, start[own], item[own])]
                found.update(zip(text[own].tolist(), start[own].tolist(), item[own].tolist()))
        return sorted(found, key=lambda x: (x[0], x[2], x[1]))

    def short_found(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, object, int, int, int]]:
        """The first place of each short item in each text, as it is, with no letter, digit or byte beyond ASCII beside it."""
        if not self.short or not len(data):
            return []
        gap = ~IN_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin = np.flatnonzero(edge[:-1] | np.concatenate(([True], gap[:-1])) | gap)
        rolling, raw, out = RollingHash(data), data.tobytes(), {}
        for n, keys in self.short_keys.items():
            at = begin[begin + n <= len(data)]
            held = rolling.of(at, at + n)
            at = at[keys[np.minimum(np.searchsorted(keys, held), len(keys) - 1)] == held]
            text = np.searchsorted(offsets, at, side="right") - 1
            end = at + n
            free = (end <= offsets[text + 1]) & (edge[end] | gap[np.minimum(end, len(data) - 1)] | gap[end - 1])
            for t, s in zip(text[free].tolist(), at[free].tolist()):
                for i in self.short[n].get(raw[s : s + n], ()):
                    out.setdefault((t, i), (t, i, 0, s, s + n))
        return list(out.values())

    def found(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, object, int, int, int]]:
        """(text, item's id, edits, start, end) of the closest passage of each item within its radius; bytes of data."""
        out, held = self.short_found(data, offsets), self.candidates(data, offsets)
        raw, k = data.tobytes(), 0
        while k < len(held):
            text, start, item = held[k]
            pattern, most = self.texts[item], self.radii[item]
            best = None
            low, stop = start - 2 * most, start + len(pattern) + 3 * most
            while True:  # candidates of one text and item, nearby ones together
                k += 1
                more = k < len(held) and held[k][0] == text and held[k][2] == item
                if more and held[k][1] <= stop:
                    stop = held[k][1] + len(pattern) + 3 * most
                    continue
                a, b = max(int(offsets[text]), low), min(int(offsets[text + 1]), stop)
                exact = raw.find(pattern, a, b)
                edits, end = (0, exact - a + len(pattern)) if exact >= 0 else closest(pattern, raw[a:b])
                if exact >= 0 and (best is None or best[0]):
                    best = (0, exact, exact + len(pattern))
                elif edits <= most and (best is None or edits < best[0]):
                    begin = max(0, end - len(pattern) - most)
                    back = closest(pattern[::-1], raw[a + begin : a + end][::-1])[1]
                    best = (edits, a + end - back, a + end)
                if not more:
                    break
                low, stop = held[k][1] - 2 * most, held[k][1] + len(pattern) + 3 * most
            if best:
                out.append((text, self.ids[item], *best))
        return out


def closest(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(edits, end) of the passage of the text nearest to the pattern in edit distance, the first such end: Myers' bit vectors."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


Items = list[tuple[object, str]]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    """The distinct items block by block. A benchmark is held by the driver, and block by block by each worker."""
    block, held = [], 0
    for item, text in benchmark.select(item_col, F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).distinct().orderBy(item_col, text_col).toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or held + len(text) > BLOCK_ITEM_BYTES):
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    yield block


class Suspects:
    """Texts that hold as many grams of any items, near each other, as some item's passage within its radius does."""

    def __init__(self, blocks_of_items: list[Items], share: float):
        self.bits, self.classes, self.short = np.zeros(FILTER_BITS // 8, np.uint8), set(), False
        for items in blocks_of_items:
            for _, text in items:
                raw = normal(text)
                if 0 < len(raw) < SHORT:
                    self.short = True
                elif raw:
                    own, edits = self.places(np.frombuffer(raw, np.uint8))[: len(raw) - GRAM + 1], radius(len(raw), share)
                    np.bitwise_or.at(self.bits, own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
                    self.classes.add((len(raw) + edits, len(raw) - GRAM + 1 - GRAM * edits))

    @staticmethod
    def places(data: np.ndarray) -> np.ndarray:
        x = np.zeros(len(data) + GRAM, np.uint64)
        x[: len(data)] = data
        x = x[:-1] | x[1:] << np.uint64(8)
        x = x[:-2] | x[2:] << np.uint64(16)
        x = x[:-4] | x[4:] << np.uint64(32)
        return (mixed(x[: len(data)]) & np.uint64(FILTER_BITS - 1)).astype(np.int64)

    def among(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text whether it has to be looked at. Short items make every text one that has to."""
        out = np.full(len(offsets) - 1, self.short)
        if self.short or not len(data):
            return out
        place = self.places(data)
        sums = np.concatenate(([0], np.cumsum(self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)))
        heads = np.arange(0, len(data), STRIDE)
        for size, least in self.classes:
            ends = np.minimum(heads + STRIDE + size, len(data))
            at = heads[sums[ends] - sums[heads] >= least]
            for edge in (at, np.minimum(at + STRIDE + size, len(data)) - 1):  # the window may reach over several texts
                out[np.searchsorted(offsets, edge, side="right") - 1] = True
            first, last = np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, np.minimum(at + STRIDE + size, len(data)) - 1, side="right") - 1
            for a, b in {*zip(first.tolist(), last.tolist())}:
                out[a : b + 1] = True
        return out


def suspected(df: DataFrame, text_col: str, blocks_of_items: list[Items], share: float, wanted: bool = True) -> DataFrame:
    """The rows that `Suspects` are among (wanted), or all others; columns c0, c1, ... of numbered names."""
    sent = df.sparkSession.sparkContext.broadcast(Suspects(blocks_of_items, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text_col, most=SEARCHED):
            data, offsets, _ = normalised(*as_bytes(part.column(part.schema.get_field_index(text_col))))
            yield part.filter(pa.array(sent.value.among(data, offsets) == wanted))

    return df.mapInArrow(run, df.schema)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """Passages of the benchmark's items in whole texts: id, item, edits, similarity, start, end (code points).

    Case of ASCII and Latin-1 letters and the kind and length of white space don't count. A passage of an item of n bytes is
    reported within share * n edits or WORD_EDITS if more, once for each text and item, where it is closest. Windows of
    an item's size that share enough grams with it at about one shift, wherever in the text, are embedded by a CGK
    random walk and looked up in tables of sampled places; what falls together is verified exactly. A class of items
    has as many walks and tables as trial edits of bytes and words need for RECALL; where MOST_WALKS would not do, its
    windows are verified without tables. Exact passages are always found. Items under SHORT bytes are found as they
    are, on word bounds.

    The items are sent to the workers in blocks of BLOCK_ITEMS and BLOCK_ITEM_BYTES. If there are several, one pass over
    all rows sets aside those without enough grams of any item, and the blocks are run over the others.
    Null and empty texts hold nothing; texts of any length are read whole; null and empty items are never found; of equally
    close passages the first counts; repeated rows and items each give rows; empty tables give none. Other columns are
    ignored, whatever their names.
    """
    spark = prepare(df.sparkSession)
    kind, item_kind = df.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"id {kind.simpleString()}, item {item_kind.simpleString()}, edits int, similarity double, start long, end long"
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def over(rows: DataFrame, block: Items) -> DataFrame:
        sent = spark.sparkContext.broadcast((block, share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = finder_of(sent)
            size = {i: len(t) for i, t in zip(finder.ids, finder.texts)}
            for part in blocks(batches, most=SEARCHED):
                source, at = as_bytes(part.column(1))
                data, offsets, index = normalised(source, at)
                rows = finder.found(data, offsets)
                if not rows:
                    continue
                points = np.concatenate(([0], np.cumsum((source & 0xC0) != 0x80)))
                begin = points[at]
                spans = [(points[index[s]] - begin[t], points[min(index[e - 1] + 1, len(source))] - begin[t]) for t, _, _, s, e in rows]
                similar = [1 - d / size.get(i, 1) for _, i, d, _, _ in rows]
                columns = [part.column(0).take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.array(similar), pa.array([int(s) for s, _ in spans]), pa.array([int(e) for _, e in spans])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "edits", "similarity", "start", "end"])

        return rows.mapInArrow(run, schema)

    items = list(item_blocks(benchmark, item_col, item_text_col))
    if len(items) > 1:
        own = checkpointed(suspected(own, "text", items, share))
    out = over(own, items[0])
    for block in items[1:]:
        out = out.union(over(own, block))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", "similarity", "start", "end")


_finders: dict = {}


def finder_of(sent) -> Finder:
    """The index of a broadcast block, built once in each worker."""
    block, share = sent.value
    key = (len(block), hash(tuple(block)), share)
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder(block, share)
    return _finders[key]


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """The rows without those whose text holds a passage of the benchmark, as `contaminated` finds them, in one pass.

    Each row is judged by its own text, whatever its id: null ids, repeated rows and columns of any names stay as they are; null
    and empty texts hold nothing; an empty table gives none.
    """
    spark = prepare(df.sparkSession)
    names = [f"c{k}" for k in range(len(df.columns))]
    text = names[df.columns.index(text_col)]
    rows = df.toDF(*names).withColumn("searched", F.col(text).cast("string"))

    def over(rows: DataFrame, block: Items) -> DataFrame:
        sent = spark.sparkContext.broadcast((block, share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = finder_of(sent)
            for part in blocks(batches, "searched", most=SEARCHED):
                data, offsets, _ = normalised(*as_bytes(part.column(part.num_columns - 1)))
                keep = np.ones(part.num_rows, bool)
                keep[[r[0] for r in finder.found(data, offsets)]] = False
                yield part.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    items = list(item_blocks(benchmark, item_col, item_text_col))
    if len(items) == 1:
        out = over(rows, items[0])
    else:
        left = checkpointed(suspected(rows, "searched", items, share))
        for block in items:
            left = checkpointed(over(left, block))
        out = suspected(rows, "searched", items, share, False).union(left)
    return out.drop("searched").toDF(*df.columns)
