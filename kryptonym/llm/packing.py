"""Bounded-space online packing of token ids into windows of one length."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, as_bytes, blocks, checkpointed, word_spans

WINDOW = 4096
#: Open windows of a partition.
OPEN = 16
#: A gap of at least so many tokens in the fullest window is filled by cutting a document; a smaller one is padded.
LEAST_CUT = 32
END_ID = 2
#: Bytes of texts encoded at once.
PACKED = 1 << 18
#: Partitions whose last windows are merged together.
MERGED = 64
#: Units whose ids each of a worker's two generations remembers; a unit of more than LONG bytes is never remembered.
MEMORY, LONG = 200_000, 64


class Memory:
    """Ids of byte strings by their 64-bit hash: an open-addressed table over one flat array of ids."""

    def __init__(self, room: int = 1 << 12):
        self.keys, self.places = np.zeros(room, np.uint64), np.zeros(room, np.int32)
        self.n, self.used = 0, 0
        self.ends = np.zeros(room // 2 + 1, np.int64)
        self.ids = np.zeros(room, "<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not held. No key is 0."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (keys & mask).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            held = self.keys[slot]
            same = held == keys[left]
            out[left[same]] = self.places[slot[same]]
            more = ~same & (held != 0)
            left, slot = left[more], (slot[more] + 1) & int(mask)
        return out

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new keys with their ids, one after the other in `ids`."""
        while 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys != 0
            kept, places = self.keys[old], self.places[old]
            self.keys, self.places = np.zeros(2 * len(self.keys), np.uint64), np.zeros(2 * len(self.places), np.int32)
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) - 1, np.int64)])
            self._place(kept, places)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[self.n + 1 : self.n + 1 + len(keys)] = self.used + np.cumsum(counts)
        self._place(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n, self.used = self.n + len(keys), self.used + len(ids)

    def _place(self, keys: np.ndarray, places: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]], self.places[slot[free]] = keys[free], places[free]
            lost = self.keys[slot] != keys
            keys, places, slot = keys[lost], places[lost], (slot[lost] + 1) & mask

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each place has, all of them one after the other)."""
        begin, count = self.ends[places], self.ends[places + 1] - self.ends[places]
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return count, self.ids[at]


class TextIds:
    """Token ids of texts by a tokenizer that lower-cases, drops white space and cuts words as PATTERN does.

    The bytes of a block are cut into units as the tokenizer's own pattern cuts them: runs of letters, single digits,
    runs of punctuation. A word (between ASCII white space) with an apostrophe, a special token's `<|`, a control
    character or any character beyond the Latin-1 letters is one unit and goes through the whole tokenizer. Ids
    of units are remembered by hash in two generations of at most MEMORY units: what is looked up again in the older
    one moves to the newer, so frequent units are never forgotten. Units over LONG bytes are never remembered.
    A tokenizer file of another make encodes whole texts by its library.
    """

    # What the tokenizer's file says of normalising and cutting.
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    CUTTERS = [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    WORD_END = "</w>"

    SPACES, LETTER, DIGIT, SIGN, ODD = range(5)
    KIND = np.full(256, ODD, np.uint8)
    KIND[33:127] = SIGN
    KIND[48:58] = DIGIT
    KIND[97:123] = LETTER
    KIND[[9, 10, 11, 12, 13, 32]] = SPACES
    KIND[39] = ODD

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        self.whole = Tokenizer.from_file(path)
        normal, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        self.known = normal.get("normalizers") == self.NORMALIZERS and cut.get("pretokenizers") == self.CUTTERS and model.get("type") == "BPE" and model.get("end_of_word_suffix") == self.WORD_END and not model.get("dropout") and all("<|" in x["content"] for x in spec["added_tokens"])
        if not self.known:
            return
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.is_end = np.zeros(1 + max(model["vocab"].values()), bool)
        self.is_end[[i for t, i in model["vocab"].items() if t.endswith(self.WORD_END)]] = True
        self.young, self.old = Memory(), Memory()

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, lower-cased where the unit is plain; starts; ends; text of each unit; whether it is odd)."""
        n = len(data)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        kind = self.KIND[low]
        lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
        if len(lead):
            tail = data[lead + 1]
            letter = (tail & 0xC0 == 0x80) & (tail & 0xDF != 0x97)
            lead, tail = lead[letter], tail[letter]
            kind[lead] = kind[lead + 1] = self.LETTER
            low[lead[tail < 0x9F] + 1] += 32  # U+00C0 to U+00DE
        kind[:-1][(data[:-1] == 60) & (data[1:] == 124)] = self.ODD
        starts, ends, row = word_spans(data, offsets)
        odd_before = np.concatenate(([0], np.cumsum(kind == self.ODD, dtype=np.int32)))
        odd = odd_before[ends] > odd_before[starts]
        # a plain word begins a unit at every digit and wherever the kind changes
        cut = np.zeros(n, bool)
        cut[1:] = kind[1:] != kind[:-1]
        cut |= kind == self.DIGIT
        cut &= kind != self.SPACES
        for s, e in zip(starts[odd].tolist(), ends[odd].tolist()):
            cut[s:e] = False
            low[s:e] = data[s:e]
        cut[starts] = True
        first = np.flatnonzero(cut)
        word = np.searchsorted(starts, first, side="right") - 1
        last = np.minimum(ends[word], np.append(first[1:], n))
        return low, first, last, row[word], odd[word]

    def encoded(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each unit has, all of them one after the other), by the tokenizer."""
        counts, parts = np.zeros(len(starts), np.int64), [np.zeros(0, "<u4")] * len(starts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            joined = b" ".join([raw[s:e] for s, e in zip(starts[plain].tolist(), ends[plain].tolist())]).decode("utf-8")
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.is_end[ids]) + 1
            counts[plain] = np.diff(stop, prepend=0)
            if len(plain) == len(starts):
                return counts, ids
            for k, a, b in zip(plain.tolist(), (stop - counts[plain]).tolist(), stop.tolist()):
                parts[k] = ids[a:b]
        strange = np.flatnonzero(odd).tolist()
        words = [raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in strange]
        for k, e in zip(strange, self.whole.encode_batch_fast(words, add_special_tokens=False)):
            parts[k] = np.array(e.ids, "<u4")
            counts[k] = len(parts[k])
        return counts, np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def of_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(little-endian unsigned 32-bit ids of all texts, offsets of each text in them)."""
        if not self.known:
            raw = data.tobytes()
            made = self.whole.encode_batch_fast([raw[s:e].decode("utf-8", "replace") for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())], add_special_tokens=False)
            return np.concatenate([np.zeros(0, "<u4"), *(np.array(x.ids, "<u4") for x in made)]), np.cumsum([0, *(len(x.ids) for x in made)])
        low, starts, ends, row, odd = self.units(data, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        keys = RollingHash(low).of(starts, ends) | np.uint64(1)
        long = ends - starts > LONG
        keys[long] = np.arange(1, 1 + int(long.sum()), dtype=np.uint64) << np.uint64(1)  # even: each by itself
        kinds, example, which = np.unique(keys, return_index=True, return_inverse=True)
        place = self.young.find(kinds)
        again = np.flatnonzero(place < 0)
        older = self.old.find(kinds[again])
        moved, new = again[older >= 0], again[older < 0]
        if len(moved):
            place[moved] = np.arange(self.young.n, self.young.n + len(moved))
            self.young.add(kinds[moved], *self.old.of(older[older >= 0]))
        raw = low.tobytes()
        counts, ids = self.encoded(raw, starts[example[new]], ends[example[new]], odd[example[new]])
        place[new] = np.arange(self.young.n, self.young.n + len(new))
        self.young.add(kinds[new], counts, ids)
        count, out = self.young.of(place[which])
        if self.young.n >= MEMORY or len(kinds) and kinds[0] & np.uint64(1) == 0:
            self._age()
        tokens = np.concatenate(([0], np.cumsum(count)))
        return out, tokens[np.searchsorted(row, np.arange(len(offsets)))]

    def _age(self) -> None:
        """The young generation becomes the old one; long units are left behind."""
        kept = self.young
        some = np.flatnonzero((kept.keys & np.uint64(1)) == 1)
        if self.young.n < MEMORY:  # only long units have to go
            self.young = Memory()
            self.young.add(kept.keys[some], *kept.of(kept.places[some]))
            return
        self.old, self.young = Memory(), Memory()
        self.old.add(kept.keys[some], *kept.of(kept.places[some]))

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as bytes."""
        ids, at = self.of_block(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        raw = ids.tobytes()
        return [raw[4 * s : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


_encoders: dict[str, TextIds] = {}


def encoder_of(path: str) -> TextIds:
    """The encoder of a file with what it remembers, one in each worker process."""
    if path not in _encoders:
        _encoders[path] = TextIds(path)
    return _encoders[path]


class Packer:
    """Windows of one partition. Takes documents one by one; `done` collects rows of closed windows."""

    def __init__(self, first: int, window: int = WINDOW, open_: int = OPEN, least: int = LEAST_CUT):
        self.next, self.window, self.most, self.least = first, window, open_, least
        self.open: list[list] = []
        self.fill: list[int] = []
        self.done: list[tuple] = []

    def close(self, pieces: list, is_open: bool = False) -> None:
        at = 0
        for doc, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), tokens, self.next, at, is_open))
            at += n
        self.next += 1

    def put(self, doc, ids: bytes) -> None:
        tokens, start = len(ids) // 4, 0
        while tokens - start >= self.window:
            self.close([(doc, start, ids[4 * start : 4 * (start + self.window)], tokens)])
            start += self.window
        left = tokens - start
        while left:
            best = -1
            for k, f in enumerate(self.fill):
                if f + left <= self.window and (best < 0 or f > self.fill[best]):
                    best = k
            if best < 0 and len(self.open) == self.most:
                fullest = max(range(self.most), key=self.fill.__getitem__)
                gap = self.window - self.fill[fullest]
                if gap >= self.least:
                    self.open[fullest].append((doc, start, ids[4 * start : 4 * (start + gap)], tokens))
                    start, left = start + gap, left - gap
                self.close(self.open.pop(fullest))
                self.fill.pop(fullest)
                continue
            if best < 0:
                self.open.append([])
                self.fill.append(0)
                best = len(self.open) - 1
            self.open[best].append((doc, start, ids[4 * start :], tokens))
            self.fill[best] += left
            left = 0
            if self.fill[best] == self.window:
                self.close(self.open.pop(best))
                self.fill.pop(best)

    def finish(self) -> None:
        """Merge the open windows into full ones, cutting where one ends; the last stays open."""
        now, fill = [], 0
        for pieces in self.open:
            for doc, start, ids, tokens in pieces:
                while ids:
                    n = min(len(ids) // 4, self.window - fill)
                    now.append((doc, start, ids[: 4 * n], tokens))
                    start, ids, fill = start + n, ids[4 * n :], fill + n
                    if fill == self.window:
                        self.close(now)
                        now, fill = [], 0
        if now:
            self.close(now, True)


def best_fit(fills: list[int], window: int) -> list[tuple[int, int]]:
    """(bin, offset) of each fill, largest first into the bin with the least room that takes it."""
    room: list[int] = []
    out = [(0, 0)] * len(fills)
    for k in sorted(range(len(fills)), key=lambda i: (-fills[i], i)):
        fits = [b for b, r in enumerate(room) if r >= fills[k]]
        b = min(fits, key=room.__getitem__, default=len(room))
        if b == len(room):
            room.append(window)
        out[k] = (b, window - room[b])
        room[b] -= fills[k]
    return out


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """Pack every row's token ids, each followed by `end_id`, into windows of at most `window` tokens.

    Each partition keeps `open_` open windows. A document's whole windows are closed at once; the rest goes into
    the open window that it leaves fullest. If none takes it, the fullest is closed, filled up first with the
    document's head unless only a few tokens are missing. At the end the open windows are merged into full
    ones, and the last ones of MERGED neighbouring partitions are merged best-fit, so padding is at most about one
    window for each partition. Memory is that of the open windows. Ids follow from the partition's number, so
    a task that runs again gives the same rows.

    Null and empty texts are one token, `end_id`. Repeated rows are packed each; an empty table gives no rows.
    Other columns are ignored. `tokenizer` is a file of the tokenizers library, there on every worker. Returns a
    row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    kind = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "is_open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, window, open_)

        def rows(kinds):
            columns = list(zip(*packer.done))
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        kinds = [pa.int64()] * 7 + [pa.bool_()]
        for block in blocks(batches, most=PACKED):
            found, at = encoder.of_block(*as_bytes(block.column(1)))
            raw, kinds[0] = found.tobytes(), block.column(0).type
            for doc, s, e in zip(block.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                packer.put(doc, raw[4 * s : 4 * e] + end)
            if packer.done:
                yield rows(kinds)
        packer.finish()
        if packer.done:
            yield rows(kinds)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for group, sequence, fill in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found.setdefault(group, []).append((sequence, fill))
        for group, windows in found.items():
            windows.sort()
            placed = best_fit([f for _, f in windows], window)
            low = (1 << 62) + (group << 20)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in windows], pa.int64()), pa.array([low + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=["old", "new", "moved"])

    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = checkpointed(own.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_open boolean"))
    last = pieces.where("is_open").groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    group = F.shiftright("sequence_id", 32) / MERGED
    grouped = last.select(group.cast("long").alias("group"), "sequence_id", "fill").repartition("group")
    moved = grouped.mapInArrow(merge, "old long, new long, moved long")
    opened = pieces.where("is_open").join(moved, F.col("sequence_id") == F.col("old"))
    columns = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens"]
    closed = pieces.where("not is_open").select(*columns, "sequence_id", "offset")
    return closed.union(opened.select(*columns, F.col("new").alias("sequence_id"), (F.col("offset") + F.col("moved")).alias("offset")))
