"""Offset-preserving SentencePiece encoding and decoding."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE = "▁"
#: Words that a worker keeps with their ids, and the longest that it keeps.
CACHE, LONGEST = 400_000, 64


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        n = varint() if n is None else n
        yield tag >> 3, data[at : at + n]
        at += n


def message(parts: Iterable[tuple[int, object]]) -> bytes:
    """A protocol-buffer message of ints and bytes; the inverse of fields() for these kinds."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out) + bytes([n])

    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in parts)


class Normaliser:
    """The normalisation that a SentencePiece model (or a compiled character map) tells, with its alignment.

    The map is a double-array trie from byte strings to their replacements. At each place the longest prefix in the trie
    is replaced; without one, a character stands for itself, a malformed byte for U+FFFD. Characters whose first byte
    begins no entry of the map are taken over in runs.
    """

    def __init__(self, chars: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True):
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.space = SPACE.encode() if escape else b" "
        self.units: list[int] = []
        self.strings = b""
        if chars:
            (size,) = struct.unpack_from("<I", chars)
            self.units = list(struct.unpack_from(f"<{size // 4}I", chars, 4))
            self.strings = chars[4 + size :]
        #: Bytes at which the map must be asked: those that begin an entry, and all that begin no ASCII character if any does.
        self.asked = np.zeros(256, bool)
        if self.units:
            root = self._child(self.units[0])
            for b in range(256):
                self.asked[b] = (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b
            self.asked[0xC2:0xF5] |= self.asked[0xC2:0xF5].any()

    @classmethod
    def of_model(cls, model: bytes) -> Normaliser:
        spec = dict(fields(dict(fields(model)).get(3, b"")))
        return cls(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """What the longest known prefix of raw[at:] becomes, and its length."""
        if self.units:
            found, length = -1, 0
            node = self._child(self.units[0])
            for k in range(at, len(raw)):
                node ^= raw[k]
                if node >= len(self.units):
                    break
                unit = self.units[node]
                if unit & 0x800000FF != raw[k]:
                    break
                node ^= self._child(unit)
                if unit >> 8 & 1:
                    found, length = self.units[node] & 0x7FFFFFFF, k + 1 - at
            if length:
                return self.strings[found : self.strings.index(b"\0", found)], length
        b = raw[at]
        n = 1 if b < 128 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            raw[at : at + n].decode() if n else b"\xff".decode()
        except UnicodeDecodeError:
            return "\ufffd".encode(), 1
        return raw[at : at + n], n

    def mapped(self, raw: bytes) -> tuple[bytes, np.ndarray, int]:
        """The bytes after the map alone, for each of them the place in raw where its prefix begins, and how far raw is well-formed text."""
        try:
            raw.decode()
            places = np.flatnonzero(self.asked[np.frombuffer(raw, np.uint8)]).tolist() if self.units else []
        except UnicodeDecodeError:
            places = range(len(raw))
        if not places:
            return raw, np.arange(len(raw)), len(raw)
        out, source, at = [], [], 0
        for k in places:
            if k < at:  # within a prefix that has been replaced
                continue
            to, n = self.longest(raw, k)
            if to == raw[k : k + n]:
                if n == 1:
                    continue  # part of the run
                out += [raw[at:k], to]
                source += [np.arange(at, k), np.full(n, k)]
            else:
                out += [raw[at:k], to]
                source += [np.arange(at, k), np.full(len(to), k)]
            at = k + n
        out.append(raw[at:])
        source.append(np.arange(at, len(raw)))
        return b"".join(out), np.concatenate(source), len(raw)

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and their end the place in raw that it comes from."""
        text, source, end = self.mapped(raw)
        if self.squeeze and (b"  " in text or text[:1] == b" " or text[-1:] == b" "):
            byte = np.frombuffer(text, np.uint8) == 32
            keep = ~(byte & np.append(True, byte[:-1]))  # not the first of the text, nor behind another
            if byte[-1] and keep.any() and (last := int(np.flatnonzero(keep)[-1])) >= 0 and byte[last]:
                keep[last] = False
            tail = np.flatnonzero(~byte)
            end = int(source[tail[-1] + 1]) if len(tail) and tail[-1] + 1 < len(source) else end
            text, source = np.frombuffer(text, np.uint8)[keep].tobytes(), source[keep]
        if not text:
            return b"", np.array([end])
        if self.space != b" ":
            wide = np.frombuffer(text, np.uint8) == 32
            source = np.repeat(source, np.where(wide, len(self.space), 1))
            text = text.replace(b" ", self.space)
        if self.dummy_prefix:
            text, source = self.space + text, np.append(np.full(len(self.space), source[0]), source)
        return text, np.append(source, end)


class Encoder:
    """A SentencePiece model: texts pass the normaliser above, its result is cut into pieces, and these go back to the texts' bytes.

    Pieces come from the model's own merges over normalised text (the library with its normalisation switched off). Where
    no piece has a space sign behind another character, merges never cross the place before one, so that words are
    encoded once and kept.
    """

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        parts = list(fields(model))
        self.normaliser = Normaliser.of_model(model)
        bare = message([(2, b""), (3, 0), (4, 0), (5, 0)])  # no map, no prefix, no squeezing, no space signs
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=message([*((k, v) for k, v in parts if k != 3), (3, bare)]))
        #: The model as it is, for decoding.
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        own = [not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)) for i in range(len(names))]
        #: Bytes of normalised text that an id covers.
        self.width = np.array([len(n.encode()) if o else int(self.library.is_byte(i)) for i, (n, o) in enumerate(zip(names, own))], np.int64)
        self.by_word = not any(SPACE in n.lstrip(SPACE) or "\n" in n for n, o in zip(names, own) if o)
        self.odd = re.compile(f"{SPACE}{SPACE}|{SPACE}$|\0")
        self.words: dict[str, tuple[str, tuple[int, ...]]] = {}

    def _learn(self, words: list[str]) -> dict[str, tuple[str, tuple[int, ...]]]:
        found = {}
        for w, i in zip(words, self.merges.encode([w if w[0] == "\n" else SPACE + w for w in words], num_threads=1)):
            found[w] = (",".join(map(str, i)), tuple(i))
        if len(self.words) + len(found) > CACHE:
            self.words = {}
        self.words.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
        return found

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and of its bytes and their end the places in the text's bytes."""
        out, source = self.normaliser(text.encode())
        return out.decode(), source

    def encode(self, texts: list[str]) -> Iterator[tuple[str, list[int]]]:
        """For each normalised text its ids, as text and as a list."""
        split = [t.replace("\n", f"{SPACE}\n")[1:].split(SPACE) if self.by_word and t[:1] == SPACE and t[1:2] not in ("", "\n") and not self.odd.search(t) and f"{SPACE}\n" not in t else None for t in texts]
        known = self.words
        new = {w for s in split if s for w in s if w not in known}
        found = self._learn(list(new)) if new else {}
        get = (known if known is self.words else known | self.words).get
        for t, s in zip(texts, split):
            if s is None:
                ids = self.merges.encode(t)
                yield ",".join(map(str, ids)), ids
            else:
                both = [get(w) or found[w] for w in s]
                yield ",".join([b[0] for b in both]), list(chain.from_iterable([b[1] for b in both]))

    def spans(self, text: str, source: np.ndarray, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Where each id's piece of a normalised text begins and ends in the bytes that source tells."""
        width = self.width[np.array(ids, np.int64)]
        if (unknown := self.library.unk_id()) in ids:  # an unknown piece's width is its text's
            named = self.merges.encode(text, out_type=str)
            width = np.where(np.array(ids) == unknown, [len(n.encode()) for n in named], width)
        end = np.cumsum(width)
        begin = np.append(0, end[:-1]) if len(end) else end
        return source[begin], source[end]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


FULL = {"ids": "array<int>", "begins": "array<long>", "ends": "array<long>", "decoded": "string"}
DIGEST = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "span_bytes": "long"}


def encode(docs: DataFrame, model: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, begins, ends, decoded) of every row: ids without begin or end ids, each piece's span in the text's bytes, and the ids decoded.

    With digest the workers send instead n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 and
    span_bytes, how many bytes of the text the spans cover, all of the same ids and spans. Null and empty texts have no
    ids and decode to an empty text. Whole texts are encoded, without a shuffle; other columns are ignored, and repeated
    rows give repeated rows.
    """
    form = {"id": "long"} | (DIGEST if digest else FULL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for whole in batches:
            for batch in C.pieces(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                rows = []
                normal = [e.normalised(t) for t in texts]
                for (t, source), (listed, ids) in zip(normal, e.encode([t for t, _ in normal])):
                    begin, end = e.spans(t, source, ids)
                    decoded = e.library.decode(ids)
                    if digest:
                        covered = int((end - begin).sum())
                        rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), covered))
                    else:
                        rows.append((ids, begin.tolist(), end.tolist(), decoded))
                columns = list(zip(*rows)) if rows else [()] * (len(form) - 1)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()] if digest else [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], list(form))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in form.items()))
