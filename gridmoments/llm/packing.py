"""Packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words that a worker keeps at most if nothing else is said (some 250 MB), the longest that it keeps, and examples that are packed together.
CACHE, LONGEST, GROUP = 1_500_000, 64, 1024


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


class WordEncoder:
    """A BPE tokenizer with word ends whose ids for space-separated words are kept; ids are the library's.

    Texts of plain letters only are split at white space, which the tokenizer drops; others go through the library whole,
    as do those that may hold one of its special tokens. Workers outlive their tasks and so do the words, so their number
    is bounded; when `most` would be exceeded, those that were met again stay.
    """

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        self.most = most

        self.library = Tokenizer.from_file(path)
        names = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        for name, i in names.items():
            self.ends[i] = name.endswith("</w>")
        self.odd = re.compile("[^\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]")  # no fractions, superscripts and dotted I
        letter = "a-zªµºÀ-ÖØ-öø-ɏ"
        self.token = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letter}]+|[0-9]|[^\\s0-9{letter}]+")
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.start, self.length, self.met = (np.zeros(self.most + 1, np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _thin(self) -> None:
        """Keeps the words that were met again, the most frequent of them, half of self.most at most."""
        n = len(self.slot)
        met, start, length, ids = self.met[:n], self.start[:n], self.length[:n], self.ids
        keep = np.flatnonzero(met > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(-met[keep], kind="stable")[: self.most // 2]])
        words, start, length = list(self.slot), start[keep], length[keep]  # slots are numbered in the order of the dict
        total = np.cumsum(np.append(0, length))
        ids = ids[np.repeat(start - total[:-1], length) + np.arange(total[-1])]
        self._reset()
        self.slot.update(zip(map(words.__getitem__, keep.tolist()), range(len(keep))))
        self.start[: len(keep)], self.length[: len(keep)] = total[:-1], length
        self.used = len(ids)
        self.ids = np.append(ids, np.zeros(max(len(self.ids) - len(ids), 0), np.uint32))

    def _learn(self, words: list[str]) -> None:
        if len(self.slot) + len(words) > self.most:
            self._reset()
        if len(words) > self.most:
            self.start, self.length, self.met = (np.zeros(len(words) + 1, np.int64) for _ in range(3))
        for a in range(0, len(words), 250):
            some = words[a : a + 250]
            (coded,) = self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(coded.ids, np.uint32)
            tokens = np.cumsum([len(self.token.findall(w)) for w in some])
            ends = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            bounds = np.append(0, ends[tokens])
            if len(ends) - 1 != tokens[-1] or bounds[-1] != len(ids):
                raise ValueError("the tokenizer does not split words as expected")
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            at = len(self.slot)
            self.ids[self.used : self.used + len(ids)] = ids
            self.start[at : at + len(some)] = self.used + bounds[:-1]
            self.length[at : at + len(some)] = np.diff(bounds)
            self.slot.update(zip(some, range(at, at + len(some))))
            self.used += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [None if "<|" in t or self.odd.search(t) else t.lower().split() for t in texts]
        words = list(chain.from_iterable(s for s in split if s))

        def find() -> tuple[np.ndarray, np.ndarray, list[str], set[str]]:
            slots = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
            unknown = np.flatnonzero(slots < 0)
            strange = [words[k] for k in unknown.tolist()]
            return slots, unknown, strange, set(strange)

        slots, unknown, strange, new = find()
        if len(self.slot) + len(new) > self.most:
            self._thin()
            slots, unknown, strange, new = find()
        if new:
            if len(self.slot) + len(new) > self.most:
                self._reset()
                unknown, strange, new = np.arange(len(words)), words, set(words)
            self._learn(sorted(new))
            slots[unknown] = np.fromiter(map(self.slot.__getitem__, strange), np.int64, len(strange))
        np.add.at(self.met, slots, 1)
        length = self.length[slots]
        total = np.cumsum(np.append(0, length))
        flat = self.ids[np.repeat(self.start[slots] - total[:-1], length) + np.arange(total[-1])]
        out, at = [], 0
        for t, s in zip(texts, split):
            if s is None:
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(flat[total[at] : total[at + len(s)]])
                at += len(s)
        long = [w for w in new if len(w) > LONGEST]
        if long and sum(map(len, long)) > 1 << 20:
            self._reset()
        return out


@lru_cache(maxsize=2)
def encoder(path: str, most: int = CACHE) -> WordEncoder:
    return WordEncoder(path, most)


def place(tokens: list[int], losses: list[np.ndarray | None], limits: Limits, cut: bool) -> Iterator[tuple[int, int, int, int, int]]:
    """(example, start, length, sequence, offset) of pieces; sequences are numbered from 0.

    losses[i], if given, has the number of loss-bearing tokens before each place of example i (and in all); without it
    every token bears loss. With cut, examples are cut to full sequences first. Then bins are filled one at a time: of
    the pieces that fit, the one whose demand has the largest dot product with what is left of the bin's tokens,
    segments and loss-bearing tokens, each as a share of the limit. With cut, the rest of a bin is filled by the head of
    the largest piece, and a bin that stays short is split into sequences of powers of two, which need no padding.
    Without cut, an example beyond a limit raises ValueError.
    """

    def loss(i: int, a: int, b: int) -> int:
        return b - a if losses[i] is None else int(losses[i][b] - losses[i][a])

    def reach(i: int, a: int, room: int, loss_room: int) -> int:
        """How far a piece from a may go."""
        b = min(tokens[i], a + room)
        if losses[i] is None:
            return min(b, a + loss_room)
        return min(b, int(np.searchsorted(losses[i], losses[i][a] + loss_room, "right")) - 1)

    sequence, items = 0, []
    for i, n in enumerate(tokens):
        a = 0
        while cut and a < n and (b := reach(i, a, limits.tokens, limits.loss_tokens)) - a == limits.tokens:
            yield i, a, b - a, sequence, 0
            sequence, a = sequence + 1, b
        while a < n:
            b = reach(i, a, limits.tokens, limits.loss_tokens)
            if not cut and b < n or b == a:
                raise ValueError(f"example {i} does not fit a sequence")
            items.append((i, a, b - a))
            a = b
    size = np.array([[n, 1, loss(i, a, a + n)] for i, a, n in items], np.float64).reshape(len(items), 3)
    most = np.array([limits.tokens, limits.segments, max(limits.loss_tokens, 1)], np.float64)
    share = size / most
    open_ = np.ones(len(items), bool)
    while open_.any():
        left, held = most.copy(), []
        while True:
            fits = np.flatnonzero(open_ & (size <= left).all(1))
            if len(fits):
                k = int(fits[np.argmax(share[fits] @ (left / most))])
                held.append(items[k])
                left -= size[k]
                open_[k] = False
            else:
                rest = np.flatnonzero(open_)
                if not (cut and len(rest) and left[0] >= 1 and left[1] >= 1):
                    break
                k = int(rest[np.argmax(size[rest, 0])])
                i, a, n = items[k]
                b = reach(i, a, int(left[0]), int(left[2]))
                if b == a:
                    break
                held.append((i, a, b - a))
                left -= [b - a, 1, loss(i, a, b)]
                items[k] = (i, b, n - (b - a))
                size[k] = n - (b - a), 1, loss(i, b, a + n)
                share[k] = size[k] / most
            if left[0] < 1:
                break
        total = int(limits.tokens - left[0])
        room = [limits.tokens] if not cut or total == limits.tokens else [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        offset = 0
        for i, a, n in held:
            while n:
                part = min(n, room[0] - offset)
                yield i, a, part, sequence, offset
                a, n, offset = a + part, n - part, offset + part
                if offset == room[0] and cut:
                    room.pop(0)
                    sequence, offset = sequence + 1, 0
        if offset:
            sequence += 1


Tokens = Callable[[list[str]], list[tuple[np.ndarray, np.ndarray | None]]]


def whole_texts(path: str, last: int = 1, most: int = CACHE) -> Tokens:
    """Ids of texts with a last id; every token bears loss. A worker keeps the ids of `most` words."""
    return lambda texts: [(np.append(x, np.uint32(last)).astype("<u4"), None) for x in encoder(path, most).encode(texts)]


def turns_of(conversations: DataFrame, most: int = 64, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, text): the turns of each conversation in their order as JSON, [[role, text], ...], at most `most` numbers of turns in a row of the result.

    Null roles and texts count as empty, rows with a null id or turn are dropped, of turns of one number all stay. A
    longer conversation gives several rows, so no group grows with it unless one turn repeats.
    """
    rows = conversations.where(F.col(id_col).isNotNull() & F.col("turn").isNotNull())
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = rows.groupBy(id_col, F.floor(F.col("turn") / most).alias("_part")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return held.select(id_col, F.to_json(F.transform("t", lambda t: F.array(t.role, t.text))).alias("text"))


def chat(path: str, last: int = 1, taught: str = "assistant") -> Tokens:
    """Ids of the turns that turns_of() gives, each ended by a last id; only those of the taught role bear loss."""

    def run(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray | None]]:
        turns = [json.loads(t) if t else [] for t in texts]
        coded = iter(encoder(path).encode([text for own in turns for _, text in own]))
        out = []
        for own in turns:
            ids = [np.append(next(coded), np.uint32(last)) for _ in own]
            bears = [np.full(len(x), role == taught) for x, (role, _) in zip(ids, own)]
            flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype("<u4")
            out.append((flat, np.append(0, np.cumsum(np.concatenate([np.zeros(0, bool), *bears])))))
        return out

    return run


def pack(examples: DataFrame, tokens: Tokens, limits: Limits = Limits(), cut: bool = True, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens[, ids]) of every piece of every example.

    Examples are packed in groups of at most GROUP neighbouring rows, each in one task and without a shuffle; a group's
    sequences are filled as place() tells, so that with cut none is padded. sequence_id holds the partition and a number
    within it. tokens gives an example's ids and, optionally, the running number of its loss-bearing ones; a null text is
    empty. An example of no tokens at all has no piece. Rows with a null id keep it; other columns are ignored.
    """
    rows = examples.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, done = TaskContext.get().partitionId() << 36, 0
        who: list[int] = []
        coded: list[tuple[np.ndarray, np.ndarray | None]] = []

        def close() -> pa.RecordBatch:
            nonlocal done
            pieces = list(place([len(x) for x, _ in coded], [y for _, y in coded], limits, cut))
            i, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces)) if pieces else [np.zeros(0, np.int64)] * 5
            crc = [zlib.crc32(coded[k][0][a : a + n]) for k, a, n in zip(i.tolist(), start.tolist(), length.tolist())]
            columns = [pa.array([who[k] for k in i.tolist()], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array([len(coded[k][0]) for k in i.tolist()], pa.int64()), pa.array(base + done + sequence), pa.array(offset)]
            bears = [n if (y := coded[k][1]) is None else int(y[a + n] - y[a]) for k, a, n in zip(i.tolist(), start.tolist(), length.tolist())]
            columns.append(pa.array(bears, pa.int64()))
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            if with_ids:
                columns.append(pa.array([coded[k][0][a : a + n].astype(np.int64) for k, a, n in zip(i.tolist(), start.tolist(), length.tolist())], pa.list_(pa.int64())))
                names.append("ids")
            done += int(sequence.max(initial=-1)) + 1
            return pa.RecordBatch.from_arrays(columns, names)

        size = 0
        for whole in batches:
            for batch in C.pieces(whole, "text"):
                who += batch.column("id").to_pylist()
                coded += tokens(batch.column("text").to_pylist())
                size += batch.column("text").nbytes
                if len(who) >= GROUP or size > 8 * C.CHUNK_BYTES:
                    yield close()
                    who, coded, size = [], [], 0
        if who:
            yield close()

    form = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(run, form)
