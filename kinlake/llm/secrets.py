"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Three passes, each over whole texts. The first counts how characters follow each other in all
documents (a table of at most 97 x 97 cells). From that chain the driver draws ordinary strings
by a fixed rule and learns how the battery's statistics fall on them, for each encoding and
length. The second pass finds candidate tokens, infers their encoding, and turns the battery
into one p-value, the chance that ordinary text looks as random. The third applies the
Benjamini-Hochberg limit of each length class, found on a histogram of all p-values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.llm.text import chunks
from kinlake.llm.work import Scratch

# The base patterns.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Alphabet of each encoding that a token may be in, smallest first.
ENCODINGS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
CLASSES = (20, 24, 32, 48, 64, 96, 128)
DRAWN = 2000
#: Characters of a token that are worked on at once; a longer one is tested whole, piece by piece.
PIECE = 4096
TAIL = 0.25
SPAN = "array<struct<kind:string,start:int,end:int>>"
_CODE = np.full(256, 96, np.uint8)
_CODE[32:127] = np.arange(95)
_CODE[127:] = 95
_BINS = 16
_LEAST_P = 1e-300
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in code points, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def may_hold(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Indices of the texts of a chunk that hold a keyword or a run of 20 token characters; no other text has a span or a candidate."""
    inside = np.concatenate([[False], _TOKEN[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hits = list(starts[ends - starts >= 20])
    folded = _FOLD[data].tobytes()
    for word in _KEYWORDS:
        at = folded.find(word)
        while at >= 0:
            hits.append(at)
            at = folded.find(word, at + 1)
    rows = np.searchsorted(offsets, np.array(hits, np.int64), "right") - 1
    crossing = np.searchsorted(offsets, ends[ends - starts >= 20] - 1, "right") - 1  # a run may go on into later texts
    first = rows[: len(crossing)]
    more = [np.arange(a, b + 1) for a, b in zip(first, crossing, strict=True) if b > a]
    return np.unique(np.concatenate([rows, *more])) if len(rows) else rows


def infer_encoding(token: str) -> int:
    letters = set(token)
    return next((i for i, a in enumerate(ENCODINGS.values()) if letters <= set(a)), len(ENCODINGS) - 1)


def length_class(n: int) -> int:
    return int(np.searchsorted(CLASSES, n, "right")) - 1


def _figures(counts: np.ndarray, width: int, changes: np.ndarray, lagged: np.ndarray, squared: np.ndarray) -> np.ndarray:
    """The columns of battery() from each row's counts of codes, changes between halves, and sums of products about its mean."""
    size = counts.shape[1]
    expected = width / size
    chi = (((counts - expected) ** 2).sum(1) / expected - (size - 1)) / np.sqrt(2 * (size - 1))
    ups = counts[:, np.arange(size) >= size / 2].sum(1)
    runs = 1 + changes
    mean = 1 + 2 * ups * (width - ups) / width
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / max(width - 1, 1), 1e-9))
    runs = np.where((ups > 0) & (ups < width), (runs - mean) / np.maximum(spread, 0.25), width)
    serial = lagged / np.maximum(squared, 1e-9) * np.sqrt(width)
    return np.stack([np.maximum(chi, 0), np.abs(runs), np.abs(serial)], 1)


def _counts(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes)
    counts = np.zeros((n, size))
    np.add.at(counts, (np.arange(n)[:, None], codes), 1)
    return counts


def battery(codes: np.ndarray, size: int) -> np.ndarray:
    """For rows of codes below size, how far each test is from a uniform source (columns chi, runs, serial)."""
    high = codes >= size / 2
    x = codes - codes.mean(1, keepdims=True)
    return _figures(_counts(codes, size), codes.shape[1], (high[:, 1:] != high[:, :-1]).sum(1), (x[:, 1:] * x[:, :-1]).sum(1), (x * x).sum(1))


def _codes(tokens: list[str], encoding: int, kind: type = np.int64) -> np.ndarray:
    table = np.zeros(256, kind)
    alphabet = list(ENCODINGS.values())[encoding]
    table[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
    return table[np.frombuffer("".join(tokens).encode(), np.uint8)].reshape(len(tokens), -1)


def departure(codes: np.ndarray, encoding: int) -> np.ndarray:
    """The battery as one figure for each row of codes; small means random-looking.

    Besides the three tests it holds how far the row lacks character classes of its alphabet
    (digits, lower and upper case). The padding sign = is no part of a token here."""
    size = len(list(ENCODINGS.values())[encoding])
    return _departure(battery(codes, size), _counts(codes, size), codes.shape[1], encoding)


def _departure(figures: np.ndarray, counts: np.ndarray, width: int, encoding: int) -> np.ndarray:
    alphabet = list(ENCODINGS.values())[encoding]
    out = np.sqrt((figures**2).sum(1))
    for kind in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        member = np.array([c in kind for c in alphabet])
        share = member.mean()
        if 0 < share < 1:
            want = share * width
            out += np.maximum(want - counts[:, member].sum(1), 0) / np.sqrt(max(want * (1 - share), 1e-9))
    return out


def long_departure(token: str, encoding: int) -> np.ndarray:
    """departure() of one whole token of any length, PIECE characters at a time."""
    codes, size = _codes([token], encoding, np.uint8)[0], len(list(ENCODINGS.values())[encoding])
    width, counts = len(codes), np.bincount(codes, minlength=size).astype(float)
    mean = counts @ np.arange(size) / width
    changes, lagged = 0, 0.0
    for i in range(0, width - 1, PIECE):
        part = codes[i : i + PIECE + 1]  # with the next piece's first
        high, x = part >= size / 2, part - mean
        changes += int((high[1:] != high[:-1]).sum())
        lagged += float((x[1:] * x[:-1]).sum())
    squared = counts @ (np.arange(size) - mean) ** 2
    return _departure(_figures(counts[None], width, *(np.array([v]) for v in (changes, lagged, squared))), counts[None], width, encoding)


def chance(null: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The chance of a departure of at most `value`: by sorted draws, and by an exponential tail below their TAIL quantile.

    The tail's rate comes from the quantiles TAIL and TAIL / 2, not from the least draws, since the
    chain holds the secrets' own characters too and some draws wander into those. A tail that falls
    faster than an exponential, like a normal one, makes the chance too large, not too small."""
    edge, half = np.quantile(null, [TAIL, TAIL / 2])
    mean = max((edge - half) / np.log(2), 1e-9)
    drawn = (1 + np.searchsorted(null, value, "right")) / (1 + len(null))
    return np.maximum(np.where(value < edge, TAIL * np.exp((np.minimum(value, edge) - edge) / mean), drawn), _LEAST_P)


class Ordinary:
    """Strings drawn from the documents' own chain of characters, and where their departures fall."""

    def __init__(self, table: np.ndarray, seed: int = 7):
        self.table, self.seed, self.seen = table, seed, {}

    def reference(self, encoding: int, length: int) -> np.ndarray:
        """Sorted departures of ordinary strings of this length written in this encoding's alphabet."""
        length = CLASSES[length_class(length)]
        if (encoding, length) not in self.seen:
            rng = np.random.default_rng([self.seed, encoding, length])
            alphabet = list(ENCODINGS.values())[encoding]
            own = np.array([ord(c) - 32 for c in alphabet])
            chain = self.table[np.ix_(own, own)] + 1e-3
            cumulated = np.cumsum(chain / chain.sum(1, keepdims=True), 1)
            start = np.cumsum(chain.sum(1) / chain.sum())
            at = np.searchsorted(start, rng.random(DRAWN)).clip(0, len(own) - 1)
            rows = [at]
            for _ in range(length - 1):
                at = (cumulated[at] < rng.random(DRAWN)[:, None]).sum(1).clip(0, len(own) - 1)
                rows.append(at)
            self.seen[encoding, length] = np.sort(departure(np.stack(rows, 1), encoding))
        return self.seen[encoding, length]

    def p_values(self, tokens: list[str]) -> np.ndarray:
        """The chance that ordinary text departs as little from randomness as each token."""
        out, groups = np.ones(len(tokens)), {}
        for i, t in enumerate(tokens):
            bare = t.rstrip("=")
            encoding = infer_encoding(bare)
            if len(bare) > PIECE:
                out[i] = chance(self.reference(encoding, len(bare)), long_departure(bare, encoding))[0]
            else:
                groups.setdefault((encoding, len(bare)), []).append((i, bare))
        for (encoding, length), found in groups.items():
            null = self.reference(encoding, length)
            value = departure(_codes([t for _, t in found], encoding), encoding)
            out[[i for i, _ in found]] = chance(null, value)
        return out


def character_chain(df: DataFrame, text: str = "text") -> np.ndarray:
    """How often each printable ASCII character follows another, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(97 * 97, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                code = _CODE[data].astype(np.int32)
                pairs = code[:-1] * 97 + code[1:]
                pairs[offsets[(offsets > 0) & (offsets < len(data))] - 1] = 96 * 97  # from one text to the next; no real pair
                total += np.bincount(pairs, minlength=97 * 97)
        total[96 * 97] = 0
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

    cells = df.select(F.col(text)).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most 97 * 97 rows
    table = np.zeros(97 * 97)
    table[cells.cell.to_numpy(np.int64)] = cells.n.to_numpy(np.float64)
    return table.reshape(97, 97)


def scan(df: DataFrame, ordinary, keys: list[str], text: str = "text") -> DataFrame:
    """keys, spans of the base patterns, and candidate tokens with length class and p-value."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(keys).schema)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ordinary.value
        for batch in batches:
            base: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            tokens, places = [], []
            for first, data, offsets in chunks(batch.column(len(keys))):
                for i in may_hold(data, offsets).tolist():
                    t, row = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"), first + i
                    found = base_spans(t)
                    base[row] = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]
                    for m in CANDIDATE.finditer(t):
                        if not any(a < m.end() and m.start() < b for a, _, b in found):
                            tokens.append(m[0])
                            places.append((row, m.start(), m.end()))
            candidates: list[list[dict]] = [[] for _ in base]
            for (row, a, b), t, p in zip(places, tokens, own.p_values(tokens).tolist(), strict=True):
                candidates[row].append({"start": a, "end": b, "size": length_class(len(t.rstrip("="))), "p": p})
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(base, span), pa.array(candidates, cand)], [*keys, "base", "candidates"])

    return df.select(*keys, text).mapInArrow(run, f"{schema}, base {SPAN}, candidates array<struct<start:int,end:int,size:int,p:double>>")


def discovery_limits(found: DataFrame, level: float) -> dict[int, float]:
    """For each length class the largest p-value that Benjamini-Hochberg declares at this level.

    The classes are tested apart, so the many short tokens don't decide about the long ones."""
    p = F.col("c.p")
    bins = (
        found.select(F.explode("candidates").alias("c"))
        .select("c.size", F.floor(F.log2(p) * -_BINS).cast("int").alias("bin"), p.alias("p"))
        .groupBy("size", "bin")
        .agg(F.count("*").alias("count"), F.max("p").alias("upper"))
        .toPandas()  # some 16,000 bins at most for each of 7 classes, _BINS for each halving of p
    )
    limits = {}
    for size, g in bins.groupby("size"):
        g = g.sort_values("bin", ascending=False)
        upper, below = g["upper"].to_numpy(), g["count"].cumsum().to_numpy()
        good = upper <= level * below / below[-1]
        if good.any():
            limits[int(size)] = float(upper[good].max())
    return limits


def find_secrets(df: DataFrame, keys: list[str], text: str = "text", level: float = 0.01, scratch: Scratch | None = None) -> DataFrame:
    """keys, base and spans: for each row the base spans, and all spans with those of the battery.

    Spans are (kind, start, end) in code points, end exclusive, by start and then kind in the
    order assign, access, hex, random. A null or empty text has none; rows, repeated or not, are
    all kept; an empty table gives an empty result; texts are scanned whole. A token that meets a
    base span is not tested again.
    """
    spark = df.sparkSession
    ordinary = Ordinary(character_chain(df, text))
    for encoding in range(len(ENCODINGS)):
        for length in CLASSES:
            ordinary.reference(encoding, length)
    found = (scratch or Scratch(spark)).keep(scan(df, spark.sparkContext.broadcast(ordinary), keys, text))
    limits = discovery_limits(found, level)
    passes = lambda c: F.lit(False)
    if limits:
        table = F.create_map(*(F.lit(x) for kv in sorted(limits.items()) for x in kv))
        passes = lambda c: c["p"] <= F.coalesce(F.try_element_at(table, c["size"]), F.lit(0.0))
    extra = F.transform(
        F.filter("candidates", passes),
        lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end")),
    )
    return found.select(*keys, "base", F.array_sort(F.concat("base", extra), _by_start).alias("spans"))


def _order(s: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((_order(a) - _order(b)).cast("int"))


def joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
