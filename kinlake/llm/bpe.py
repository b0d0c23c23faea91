"""Byte-level BPE encoding and decoding with segment trees over adjacent pair ranks.

Each piece of a text (the pre-tokenizer's pattern) is a row of leaves, one for each adjacent
pair, holding rank * width + position. The root of the tree over them is the leftmost pair of
lowest rank; merging it changes three leaves and their paths to the root. Pieces of up to
BATCH_WIDTH bytes go through the same steps side by side, longer ones one at a time, so a piece
of n bytes takes O(n log n) whatever its length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.llm.text import large_strings

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FIND = regex.compile(PATTERN).findall
BATCH_WIDTH = 64
#: Words, and other pieces, whose ids a worker remembers in each of two generations; the older one goes when the younger is full, so memory is bounded.
REMEMBERED = 300_000
TEXTS_AT_ONCE = 1_000_000
#: The settings of a tokenizer file that this encoder follows; any other value is refused.
SETTINGS = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "decoder": {"type": "ByteLevel"},
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}
_NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def check_settings(spec: dict) -> None:
    """Raises ValueError for a tokenizer that does anything else than byte-level BPE by PATTERN."""
    for part, want in SETTINGS.items():
        found = spec.get(part)
        if want is None or found is None:
            same = want is None and found is None
        else:
            same = all(found.get(k, v) == v for k, v in want.items())
        if not same:
            raise ValueError(f"{part} of this tokenizer is {found if part != 'model' else {k: found.get(k) for k in want}}; this encoder follows {want}")
    for token in spec.get("added_tokens", []):
        if any(token.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {token['content']!r} has settings that this encoder doesn't follow")


class Parts:
    """A byte string for each id, joined for whole arrays of ids at once."""

    def __init__(self, parts: list[bytes]):
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def join(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, list[int]]:
        """The ids' strings one after another, and where those of the id at each place of `first` (up to the end) begin."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[ids] - ends[:-1], lengths)
        at += np.arange(len(at))
        return self.flat[at].tobytes(), ends[first].tolist()


class Memory:
    """What was found for the strings met lately: two generations of REMEMBERED strings."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def absent(self, wanted: set[str]) -> set[str]:
        """Which of the strings are not remembered; the others are in `young` from here until the next call."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        fresh = wanted - self.young.keys()
        if again := fresh & self.old.keys():
            self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
            fresh -= again
        return fresh


class Codec:
    """Encoder and decoder for one vocabulary; a plain object that is broadcast to the workers."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        check_settings(j)
        vocab = j["model"]["vocab"]
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.added = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = 1 + max(chain(vocab.values(), self.added.values()))
        pieces = [b""] * size
        for token, i in chain(vocab.items(), self.added.items()):
            known = all(c in to_byte for c in token)
            pieces[i] = bytes(to_byte[c] for c in token) if known else token.encode()
        self.pieces, self.numerals = Parts(pieces), Parts([b"%d," % i for i in range(size)])
        self.single = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.known, self.spaced = Memory(), Memory()

    def __getstate__(self):
        return self.__dict__ | {"known": Memory(), "spaced": Memory()}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)

    def _batch(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids, as 32-bit integers in bytes, of words of 2 to width bytes; width is a power of two."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        symbols = np.zeros((n, width + 1), np.int64)
        filled = np.arange(width + 1) < lengths[:, None]
        symbols[filled] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        alive = filled.copy()
        tree = np.full((n, 2 * width), _NONE)
        has = filled[:, 1:]
        rank = np.full((n, width), -1)
        rank[has] = self.ranks(symbols[:, :-1][has], symbols[:, 1:][has])
        tree[:, width:] = np.where(rank >= 0, rank * width + np.arange(width), _NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.flatnonzero(tree[:, 1] != _NONE)

        def put(row, leaf, value):
            node = leaf + width
            tree[row, node] = value
            while width > 1 and len(node) and node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        while len(rows):
            root = tree[rows, 1]
            at = root % width
            gone = after[rows, at]
            beyond = after[rows, gone]
            symbols[rows, at] = self.merged[root // width]
            alive[rows, gone] = False
            after[rows, at] = beyond
            last = beyond >= lengths[rows]
            before[rows[~last], beyond[~last]] = at[~last]
            put(rows, np.minimum(gone, width - 1), _NONE)
            fresh = np.full(len(rows), -1)
            r, a, b = rows[~last], at[~last], beyond[~last]
            fresh[~last] = self.ranks(symbols[r, a], symbols[r, b])
            put(rows, at, np.where(fresh >= 0, fresh * width + at, _NONE))
            left = before[rows, at]
            r, a, b = rows[left >= 0], left[left >= 0], at[left >= 0]
            fresh = self.ranks(symbols[r, a], symbols[r, b])
            put(r, a, np.where(fresh >= 0, fresh * width + a, _NONE))
            rows = rows[tree[rows, 1] != _NONE]
        ids = symbols[alive].astype(np.int32).tobytes()
        stops = [0, *(4 * np.cumsum(alive.sum(axis=1))).tolist()]
        return [ids[a:b] for a, b in zip(stops, stops[1:])]

    def _long(self, word: bytes) -> bytes:
        """Ids of one word of any length, by the same tree, in the same form."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        symbols = self.single[np.frombuffer(word, np.uint8)]
        leaf = np.full(width, _NONE)
        rank = self.ranks(symbols[:-1], symbols[1:])
        leaf[: n - 1] = np.where(rank >= 0, rank * width + np.arange(n - 1), _NONE)
        levels = [leaf]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [_NONE, *chain.from_iterable(x.tolist() for x in reversed(levels))]
        sym, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True)) if not hasattr(self, "_ranks") else self._ranks
        self._ranks = ranks

        def put(at, value):
            node = at + width
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                a = a if a < b else b
                if tree[node] == a:
                    break
                tree[node] = a
                node >>= 1

        def pair(a, b):
            r = ranks.get((sym[a] << 32) + sym[b])
            return _NONE if r is None else r * width + a

        while tree[1] != _NONE:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            beyond = after[gone]
            sym[at], sym[gone], after[at] = int(self.merged[rank]), -1, beyond
            put(gone, _NONE)
            put(at, pair(at, beyond) if beyond < n else _NONE)
            if beyond < n:
                before[beyond] = at
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        return np.array([s for s in sym if s >= 0], np.int32).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that are not remembered yet."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        known = self.known
        for p in known.absent(pieces):
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) == 1:
                known.young[p] = self.single[raw[0]].astype(np.int32).tobytes()
            elif len(raw) > BATCH_WIDTH:
                known.young[p] = self._long(raw)
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append((p, raw))
        for width, found in by_width.items():
            step = max(1, (1 << 19) // width)
            for i in range(0, len(found), step):
                part = found[i : i + step]
                known.young.update(zip((p for p, _ in part), self._batch([r for _, r in part], width), strict=True))

    def _cut(self, word: str) -> list[str]:
        """The pattern's pieces of a word and the space before it."""
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [" " + word[:-1], word[-1]]
        return _FIND(" " + word)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin (and the total).

        No piece spans a space between two characters that aren't white space, so a text is cut
        there and its words are looked up; a text with any other space is cut by the pattern as a whole."""
        spaced, known = self.spaced, self.known
        words = [t.split(" ") if not any(x in t for x in self.added) else None for t in texts]
        fresh = spaced.absent(set(chain.from_iterable(w[1:] for w in words if w)))
        odd = {w for w in fresh if not w or w[0].isspace() or w[-1].isspace()}
        cut: list[list[str]] = []
        for i, (text, w) in enumerate(zip(texts, words, strict=True)):
            if w and (not odd or odd.isdisjoint(w[1:])):
                cut.append(_FIND(w.pop(0)))
                continue
            words[i] = None
            if w:
                cut.append(_FIND(text))
            else:  # an added token is an item of its own, marked by a tuple
                parts = regex.split("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")", text)
                cut.append([p for x in parts for p in (((x,),) if x in self.added else _FIND(x))])
        fresh -= odd
        plain = {w: " " + w for w in fresh if w.isalpha()}
        mixed = {w: self._cut(w) for w in fresh - plain.keys()}
        self.learn({p for c in cut for p in c if type(p) is str}.union(plain.values(), chain.from_iterable(mixed.values())))
        piece = known.young.__getitem__
        spaced.young.update(zip(plain, map(piece, plain.values()), strict=True))
        spaced.young.update((w, b"".join(map(piece, found))) for w, found in mixed.items())
        word, out = spaced.young.__getitem__, []
        for c, w in zip(cut, words, strict=True):
            head = b"".join(np.int32(self.added[p[0]]).tobytes() if type(p) is tuple else piece(p) for p in c)
            out.append(head + b"".join(map(word, w)) if w else head)
        first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int64)
        return np.frombuffer(b"".join(out), np.int32), first

    def decode_batch(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """What each text's ids stand for; bytes that aren't UTF-8 become U+FFFD."""
        data, at = self.pieces.join(ids, first)
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]

    def digests(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """SHA-256 of each text's ids in decimal, joined by commas."""
        data, at = self.numerals.join(ids, first)
        view = memoryview(data)
        return [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]


def load(path: str) -> str:
    """The tokenizer's JSON; read once by the driver (a few MB, as large as its vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, codec, text: str = "text", into: str | None = "token_ids", decoded: str | None = None, digests: bool = False, keep_text: bool = True) -> DataFrame:
    """Adds array<int> `into`, the ids of each whole text. codec: a broadcast Codec.

    decoded names a column for what those ids decode to. digests adds n_tokens (long), ids_sha256
    (of the decimal ids joined by commas) and decoded_sha256 (of the decoded text in UTF-8), made
    of the same ids and the same decoded text by the same worker, so that neither need leave it:
    into=None leaves the ids out, keep_text=False the text.

    A null or empty text gives an empty array; special-token strings in a text become their ids,
    as the tokenizers library does; rows, repeated or not, are kept, and so are other columns.
    Columns of the input that are named like an added one are replaced.
    """
    added = {**({into: "array<int>"} if into else {}), **({decoded: "string"} if decoded else {})}
    added |= {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digests else {}
    rest = [c for c in df.columns if c not in added or c == text]
    out = [c for c in rest if c not in added and (keep_text or c != text)]
    schema = ", ".join(f"`{c.replace('`', '``')}` {kind}" for c, kind in [*((f.name, f.dataType.simpleString()) for f in df.schema if f.name in out), *added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in batches:
            texts = large_strings(batch.column(batch.schema.get_field_index(text)))
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            row = 0
            while row < len(texts):
                ahead = np.cumsum(sizes[row:])
                stop = row + max(1, int(np.searchsorted(ahead, TEXTS_AT_ONCE, "right")))
                ids, first = own.encode_batch(texts.slice(row, stop - row).to_pylist())
                part = batch.slice(row, stop - row)
                columns = {c: part.column(part.schema.get_field_index(c)) for c in out}
                if into:
                    columns[into] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                if decoded or digests:
                    back = own.decode_batch(ids, first)
                if decoded:
                    columns[decoded] = pa.array(back, pa.string())
                if digests:
                    columns["n_tokens"] = pa.array(np.diff(first), pa.int64())
                    columns["ids_sha256"] = pa.array(own.digests(ids, first), pa.string())
                    columns["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                row = stop

    return df.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)


def decode(df: DataFrame, codec, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Adds string `into`, the text that each array of ids stands for; null ids give an empty text.

    Bytes that aren't UTF-8 become U+FFFD, as in the tokenizers library.
    """
    rest = [c for c in df.columns if c != into]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.select(rest).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in batches:
            lists = [np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64) for x in batch.column(batch.schema.get_field_index(ids))]
            first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = own.decode_batch(np.concatenate([np.zeros(0, np.int64), *lists]), first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return df.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, f"{schema}, `{into}` string")
