"""Byte-level BPE in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every word finds its lowest-ranked adjacent pair
(ranks by binary search over the sorted pair keys) and all its occurrences are merged at once; words without a known
pair leave the array. Distinct words are encoded once per task and remembered up to a bounded number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Roll, blocks, bounded_batches, flat

# The published pre-tokenisation pattern of the byte-level vocabulary; piece_starts() finds its matches.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NO_PAIR = np.int64(1 << 60)
CACHED_WORDS, BLOCK = 200_000, 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [], 256
    for b in range(256):
        if b in plain:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class Bpe:
    """Vocabulary, merges and special tokens of one tokenizer file (JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.base = np.array([vocab[c] for c in letters], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        token_bytes = [b""] * self.size
        for token, i in vocab.items():
            token_bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in token_bytes])]).astype(np.int64)
        self.token_data = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.split_special = regex.compile(b"|".join(regex.escape(t.encode()) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all words in one array."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        sym = self.base[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(n), length)
        done_sym, done_word = [], []
        while sym.size:
            inner = word[1:] == word[:-1]
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where(inner & (self.keys[at] == key), self.ranks[at], NO_PAIR), NO_PAIR)
            starts = np.flatnonzero(np.append(True, ~inner))
            sizes = np.diff(np.append(starts, sym.size))
            lowest = np.minimum.reduceat(rank, starts)
            over = np.repeat(lowest == NO_PAIR, sizes)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            hit = ~over & (rank == np.repeat(lowest, sizes))
            # in a run of equal symbols pairs overlap: of consecutive hits every second one is taken
            run = np.flatnonzero(hit)
            if not run.size:
                break
            head = np.append(True, np.diff(run) != 1)
            place = np.arange(run.size) - np.flatnonzero(head)[np.cumsum(head) - 1]
            run = run[place % 2 == 0]
            sym[run] = self.merged[rank[run]]
            stay = ~over
            stay[run + 1] = False
            sym, word = sym[stay], word[stay]
        ids = np.concatenate([*done_sym, np.zeros(0, np.int64)])
        of = np.concatenate([*done_word, np.zeros(0, np.int64)])
        ids = ids[np.argsort(of, kind="stable")]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets of each id's bytes)."""
        size = self.token_at[ids + 1] - self.token_at[ids]
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return self.token_data[np.arange(at[-1]) + np.repeat(self.token_at[ids] - at[:-1], size)], at


LETTER, NUMBER, SPACE, OTHER, WHOLE = range(5)


def letter_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    classes = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            classes[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    classes[0xD800:0xE000] = OTHER
    return classes


def piece_starts(cps: np.ndarray, classes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where PATTERN's pieces start in code points; edge marks where a text (or a part between special tokens) starts.

    A run of one class is a piece; of white space before something else the last character stands apart, and joins
    what follows if it is a plain space; an apostrophe that starts a piece takes a contraction's letters with it.
    """
    n = cps.size
    first = edge[:n].copy()
    first[1:] |= classes[1:] != classes[:-1]
    at = np.flatnonzero(first)
    end = np.append(at[1:], n)
    kind = classes[at]
    starts = np.zeros(n + 1, bool)
    starts[at] = True
    inside = ~edge[end]
    gap = (kind == SPACE) & inside & (np.append(kind[1:], WHOLE) != WHOLE)
    last = end[gap] - 1
    starts[last] = True
    joins = last[cps[last] == 0x20]
    starts[joins + 1] = False
    quote = at[(kind == OTHER) & (end - at == 1) & (cps[at] == 0x27) & inside & starts[at] & (np.append(kind[1:], WHOLE) == LETTER)]
    if quote.size:
        ahead = np.append(cps, [0, 0])
        one, two = ahead[quote + 1], ahead[quote + 2]
        same = np.append(classes, [WHOLE, WHOLE])[quote + 2] == LETTER
        same &= ~np.append(edge, True)[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = same & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for where, k in ((quote[short], 2), (quote[long], 3)):
            starts[where + 1] = False
            starts[where + k] = True
    return np.flatnonzero(starts[:n])


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the stretches a[a_start:a_end] and b[b_start:b_end] hold the same bytes."""
    size = a_end - a_start
    same = size == b_end - b_start
    size = np.where(same, size, 0)
    before = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    differ = np.flatnonzero(a[at + np.repeat(a_start - before, size)] != b[at + np.repeat(b_start - before, size)])
    if differ.size:
        same[np.searchsorted(before, differ, side="right") - 1] = False
    return same


class Encoder:
    """A Bpe with the distinct pieces that it has met; the memory is emptied when full.

    Pieces are found by hash and then compared byte by byte, so that two pieces of one hash stay two.
    """

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.classes = letter_classes()
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.ids, self.at = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.text, self.text_at, self.n = np.zeros(1 << 18, np.uint8), np.zeros(1 << 14, np.int64), 0

    def add(self, words: list[bytes]) -> np.ndarray:
        """The numbers of new words, whether the index finds them or not."""
        ids, at = self.bpe.encode_words(words)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        n, used, held = self.n, int(self.at[self.n]), int(self.text_at[self.n])
        while used + ids.size > self.ids.size:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while held + raw.size > self.text.size:
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while n + len(words) + 1 > self.at.size:
            self.at, self.text_at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.text_at))
        self.ids[used : used + ids.size], self.text[held : held + raw.size] = ids, raw
        self.at[n + 1 : n + 1 + len(words)], self.text_at[n + 1 : n + 1 + len(words)] = used + at[1:], held + ends
        self.n = n + len(words)
        return np.arange(n, self.n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids) of UTF-8 texts in one flat array."""
        if self.n > CACHED_WORDS or max(self.ids.size, self.text.size) > 32 * CACHED_WORDS:
            self.forget()
        raw = data.tobytes()
        cps = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        width = np.concatenate([[0], np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000))]).astype(np.int64)
        classes = self.classes[cps]
        edge = np.zeros(cps.size + 1, bool)
        edge[np.searchsorted(width, offsets)] = True
        special: list[tuple[int, int]] = []
        if self.bpe.split_special and any(t.encode() in raw for t in self.bpe.special):
            for i in range(len(offsets) - 1):
                for m in self.bpe.split_special.finditer(raw[offsets[i] : offsets[i + 1]]):
                    a, b = (int(np.searchsorted(width, offsets[i] + x)) for x in m.span())
                    edge[a] = edge[b] = True
                    classes[a:b] = WHOLE
                    special.append((int(width[a]), self.bpe.special[m[0].decode()]))
        start = width[piece_starts(cps, classes, edge)]
        end = np.append(start[1:], data.size)
        if not start.size:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        hashes, one, inverse = np.unique(Roll(data).of(start, end), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        known = np.fromiter((self.index.get(h, -1) for h in keys), np.int64, len(keys))
        if (met := np.flatnonzero(known >= 0)).size:
            known[met[~same_bytes(data, start[one[met]], end[one[met]], self.text, self.text_at[known[met]], self.text_at[known[met] + 1])]] = -1
        if (new := np.flatnonzero(known < 0)).size:
            known[new] = self.add([raw[a:b] for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)])
            self.index.update(zip((keys[i] for i in new.tolist()), known[new].tolist(), strict=True))
        place = known[inverse]
        odd = np.flatnonzero(~same_bytes(data, start, end, data, start[one][inverse], end[one][inverse]))
        if odd.size:
            place[odd] = self.add([raw[a:b] for a, b in zip(start[odd].tolist(), end[odd].tolist(), strict=True)])
        size = self.at[place + 1] - self.at[place]
        if special:  # a special token's string stands for its own id, unlike the same string's pieces
            where = np.searchsorted(start, [a for a, _ in special])
            size[where] = 1
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        ids = self.ids[np.arange(at[-1]) + np.repeat(self.at[place] - at[:-1], size)]
        if special:
            ids[at[where]] = [i for _, i in special]
        return ids, at[np.searchsorted(start, offsets)]


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in schema.fields if f.name != name], T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", keep_text: bool = False) -> DataFrame:
    """df with the token ids of every whole text (null reads as empty, empty gives no ids); the text goes unless kept.

    path: a tokenizer file that every executor can open. Strings of special tokens in a text become their ids. Other
    columns pass unchanged; a column already named ids_col is replaced. Texts are taken in blocks of about 256 KB.
    """
    names = [c for c in df.columns if c != ids_col and (keep_text or c != text_col)]
    schema = _field(T.StructType([df.schema[c] for c in names]), ids_col, T.ArrayType(T.IntegerType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            data, offsets = flat(column)
            for a, b in blocks(offsets, BLOCK):
                ids, at = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], out], [*names, ids_col])

    return bounded_batches(df).mapInArrow(work, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """df with the text of each list of ids, special tokens included; a null list decodes to the empty text.

    Bytes that are no UTF-8 (ids cut inside a character) come back as U+FFFD.
    """
    names = [c for c in df.columns if c != text_col and (keep_ids or c != ids_col)]
    schema = _field(T.StructType([df.schema[c] for c in names]), text_col, T.StringType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path).bpe
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            if column.null_count:
                column = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32()))
            offsets = np.asarray(column.offsets).astype(np.int64)
            for a, b in blocks(offsets, BLOCK // 4):
                ids = np.asarray(column.values[int(offsets[a]) : int(offsets[b])]).astype(np.int64)
                data, at = bpe.decode_flat(ids)
                ends, whole = at[offsets[a : b + 1] - offsets[a]], data.tobytes()
                out = pa.array([whole[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], out], [*names, text_col])

    return bounded_batches(df).mapInArrow(work, schema)
