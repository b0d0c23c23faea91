"""Fuzzy line dedup: one occurrence stays of each connected group of near-equal lines.

Lines are normalised (A-Z lower, digits as 0, one space for all other ASCII between words); lines
with one form are one node. A node's SimHash has BLOCKS blocks of WIDTH bits and 64 more bits. By
the pigeonhole principle two nodes that differ in fewer than BLOCKS of the blocks' bits share a
block; most that differ in more do so too, since several of those bits fall into one block. Two
nodes are linked if they share a block, differ in at most APART of the 64 bits and APART_ALL of
all bits, and are within the edit similarity. The size of a bucket changes nothing: a large one
is dealt to tasks by pairs of parts, so any two nodes of it meet all the same. They are compared
where they share their first block only.

The join on blocks is a shuffle of arrays: each task sends the (block, node, 64 bits) of all its
nodes as one row for each part of the buckets, and a part's rows are sorted as numbers. What
leaves it are the nodes that have a partner by the 64 bits. These are held to all bits, and only
the forms of nodes that still have a partner are read again and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.llm.editing import all_within
from kinlake.llm.text import chunks, mix, spans, word_hashes
from kinlake.llm.work import Scratch, by_many_runs, by_runs, components, deal, in_blocks, shuffled

BLOCKS, WIDTH = 16, 28
#: Of the 64 bits beside the blocks, and of all bits; of lines within an edit similarity of 0.9 that share a block one in a hundred differs in more than 77 of all, unrelated ones in some 230.
APART, APART_ALL = 14, 80
#: Bytes of a feature, and the features of a line that are used (about; of longer lines those with the least hashes).
GRAM, FEATURES = 3, 64
WORDS = BLOCKS * WIDTH // 64 + 1
#: Nodes of a block of a dealt bucket while only SimHashes are compared, and nodes and characters of one while forms are.
CROWD_BITS, CROWD, CHARS = 8192, 2048, 4_000_000
#: Words of either line that are passed over at once to find where both go on alike.
WINDOW = 4
#: Pairs that are put in order together, and those that are compared before it is asked again which ones are still apart.
WAITING, AT_ONCE = 200_000, 4096
#: (block, node) entries of a part of the buckets, on average, and the least number of parts. The larger a part, the oftener it holds several blocks of a node, which then shrink together.
PART, LEAST_PARTS = 1 << 21, 16
#: Counts of keys' hashes in a part, at most.
COUNTS = (1 << 24) - 1
#: Forms whose SimHash a task remembers to have sent; beyond that it may send some again.
SENT = 500_000
ROWS_AT_ONCE = 1024
FILTER_BITS, PROBES = (16, 26), (0, 19, 38)
_FORM = np.full(256, 32, np.uint8)
_FORM[128:] = np.arange(128, 256)
_FORM[[*b"abcdefghijklmnopqrstuvwxyz"]] = [*b"abcdefghijklmnopqrstuvwxyz"]
_FORM[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = [*b"abcdefghijklmnopqrstuvwxyz"]
_FORM[[*b"0123456789"]] = 48
_ODD = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def _ranges(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs of n from each start, and where each run begins among them."""
    begin = np.cumsum(n) - n
    return np.repeat(starts - begin, n) + np.arange(int(n.sum())), begin


def _features(grams: np.ndarray, starts: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct grams, n from each of the ascending starts, whose 40-bit hash is at most `most`; by row, at least one for each."""
    base, stop = int(starts[0]), int(starts[-1] + n[-1])
    found = grams[base:stop] >> np.uint64(24)
    gap = np.append(starts[1:], stop) - starts - n  # grams after each row's own, up to the next row
    edges = np.stack([starts - base, starts - base + n], 1).ravel()
    least = np.minimum.reduceat(np.append(found, np.uint64(0)), edges)[::2]
    limit = np.stack([np.maximum(most, least) + np.uint64(1), np.zeros(len(n), np.uint64)], 1).ravel()  # none after its own
    counts = np.stack([n, gap], 1).ravel()
    keep = np.flatnonzero(found < np.repeat(limit, counts))
    row = np.searchsorted(starts - base, keep, "right") - 1
    found = np.sort(row.astype(np.uint64) << np.uint64(40) | found[keep])
    found = found[np.diff(found, prepend=~found[:1]) != 0]
    return (found >> np.uint64(40)).astype(np.int64), found & np.uint64((1 << 40) - 1)


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of some texts: where it starts, its text, and its number in it."""
    breaks = np.flatnonzero(data == 10)
    bounds = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")  # a line starts with its text or after a newline
    owner = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
    return bounds, owner, np.arange(len(owner)) - np.searchsorted(owner, owner)


def spots(text_id: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line's place, its text's id and its number there."""
    return mix(text_id.view(np.uint64) ^ mix(number.astype(np.uint64) + np.uint64(1))).view(np.int64)


class Lines:
    """The lines of a chunk of texts that are compared: owner (the text), number in it, size of the form, and words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """Keeps lines whose form isn't empty."""
        bounds, owner, number = line_starts(data, offsets)
        self.data = _FORM[data]
        edges = np.append(bounds, len(data))
        starts, ends, first = spans(self.data, edges)
        words = np.diff(first)
        lengths = np.concatenate([[0], np.cumsum(ends - starts)])
        size = lengths[first[1:]] - lengths[first[:-1]] + np.maximum(words - 1, 0)
        keep = np.flatnonzero(size >= 1)
        self.owner, self.number, self.size = owner[keep], number[keep], size[keep]
        self.low, self.high = first[:-1][keep], first[1:][keep]
        self.starts, self.ends = starts, ends
        self.hashes = word_hashes(self.data, starts, ends)
        self._joined = None

    def ids(self) -> np.ndarray:
        """A 64-bit hash of each form: a sum over its words, each mixed with its place."""
        n = self.high - self.low
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        words = self.hashes[np.repeat(self.low, n) + place]
        mixed = mix(words ^ mix(place.astype(np.uint64) + np.uint64(1)))
        return mix(np.add.reduceat(mixed, np.cumsum(n) - n) + n.astype(np.uint64)).view(np.int64) if len(n) else np.zeros(0, np.int64)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes with one space after each, and where each form starts in them."""
        if self._joined is None:
            inner = self.data != 32
            inner[1:] |= inner[:-1].copy()
            places = np.cumsum(inner) - inner
            self._joined = self.data[inner], places[self.starts[self.low]]
        return self._joined

    def simhashes(self, own: np.ndarray) -> np.ndarray:
        """WORDS words of SimHash of each of these lines, of at least GRAM bytes: the blocks' bits and, last, the 64 others."""
        data, starts = self.joined()
        wide = data.astype(np.uint64)
        grams = mix((wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)) + np.uint64(1)) if len(data) >= GRAM else np.zeros(0, np.uint64)
        out = np.zeros((len(own), WORDS), np.uint64)
        for low in range(0, len(own), ROWS_AT_ONCE):
            part = own[low : low + ROWS_AT_ONCE]
            n = self.size[part] - GRAM + 1
            row, found = _features(grams, starts[part], n, np.minimum(FEATURES / n * 2.0**40, 2.0**40).astype(np.uint64))
            met = np.bincount(row, minlength=len(part))
            few = np.flatnonzero((met < FEATURES // 3) & (n > FEATURES // 3))
            if len(few):  # lines that repeat their grams have fewer features than others of their length; twice, four times .. as many are tried
                wider = FEATURES / n[few] * 2.0 ** (40 + np.floor(np.log2(FEATURES / met[few])))
                more, rest = _features(grams, starts[part[few]], n[few], np.minimum(wider, 2.0**40).astype(np.uint64)), ~np.isin(row, few)
                row, found = np.concatenate([row[rest], few[more[0]]]), np.concatenate([found[rest], more[1]])
                order = np.argsort(row, kind="stable")
                row, found = row[order], found[order]
            out[low : low + len(part)] = majority(row, found, len(part))
        return out

    def forms(self, own: np.ndarray) -> pa.Array:
        """These lines' forms, as strings."""
        data, starts = self.joined()
        at, begin = _ranges(starts[own], self.size[own])
        raw, ends = data[at].tobytes(), np.append(begin, len(at)).astype(np.int32)
        try:
            raw.decode()
        except UnicodeDecodeError:  # bytes that aren't UTF-8 become U+FFFD
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string())
        return pa.StringArray.from_buffers(len(own), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw))


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bitwise sum of three, and what it carries."""
    d = a ^ b
    return d ^ c, (a & b) | (d & c)


def majority(row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """For rows 0 to n - 1, each with a run of features: the bits that most of the features' hashes have, those of the first where as many have them as not.

    Counts are kept as bit planes: plane p holds bit p of the counts of all WORDS * 64 bits of a row."""
    hashes = feature[:, None] * _ODD
    hashes ^= hashes >> np.uint64(32)  # the low bits of a product depend on few bits, the high ones on all
    m = np.bincount(row, minlength=n)
    order = np.argsort(-m, kind="stable")
    first, sizes = (np.cumsum(m) - m)[order], m[order]
    planes = np.zeros((max(3, int(sizes[0]).bit_length()), n, WORDS), np.uint64)
    hashes = np.concatenate([hashes, np.zeros((1, WORDS), np.uint64)])  # the last one stands for none
    for t in range(0, int(sizes[0]), 4):  # four features at once
        longer = int(np.searchsorted(-sizes, -t))  # rows with more than t features
        place = first[:longer] + t
        x = [hashes[place], *(hashes[np.where(sizes[:longer] > t + k, place + k, -1)] for k in (1, 2, 3))]
        ones, a = _add(planes[0, :longer], x[0], x[1])
        planes[0, :longer], b = _add(ones, x[2], x[3])
        planes[1, :longer], carry = _add(planes[1, :longer], a, b)
        for plane in planes[2 : max(3, (t + 4).bit_length())]:
            plane = plane[:longer]
            on = plane & carry
            plane ^= carry
            carry = on
    half = sizes // 2
    more, even = np.zeros((n, WORDS), np.uint64), np.full((n, WORDS), ~np.uint64(0))
    for p in range(len(planes) - 1, -1, -1):
        bit = np.where(half >> p & 1, ~np.uint64(0), np.uint64(0))[:, None]
        more |= even & planes[p] & ~bit
        even &= ~(planes[p] ^ bit)
    ties = sizes % 2 == 0
    more[ties] |= even[ties] & hashes[first[ties]]
    out = np.empty_like(more)
    out[order] = more
    return out


def block_keys(words: np.ndarray) -> np.ndarray:
    """The blocks of each SimHash, each with its number in the upper bits."""
    out = np.empty((len(words), BLOCKS), np.uint32)
    for k in range(BLOCKS):
        w, shift = divmod(k * WIDTH, 64)
        bits = words[:, w] >> np.uint64(shift)
        if shift + WIDTH > 64:
            bits = bits | words[:, w + 1] << np.uint64(64 - shift)
        out[:, k] = (bits & np.uint64((1 << WIDTH) - 1)).astype(np.uint32) | np.uint32(k << WIDTH)
    return out


def least_bytes(percent: int) -> int:
    """Forms shorter than this allow no edit, so they have no near ones."""
    return max(GRAM, -(-100 // (100 - percent))) if percent < 100 else 1 << 62


def line_table(docs: DataFrame, percent: int) -> DataFrame:
    """(line_id, doc_id, text_id, line_no, simhash) for every line with a form; simhash once or a few times for each form, and only of forms that may have near ones."""
    least = least_bytes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            doc, text = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, data, offsets in chunks(batch.column(2)):
                x = Lines(data, offsets)
                ids = x.ids()
                lead = np.unique(ids, return_index=True)[1]
                lead = lead[x.size[lead] >= least]
                if len(sent) > SENT:
                    sent.clear()
                lead = np.array([i for i, name in zip(lead.tolist(), ids[lead].tolist(), strict=True) if name not in sent], np.int64)
                lead.sort()
                sent.update(ids[lead].tolist())
                has = np.zeros(len(ids), bool)
                has[lead] = True
                owner = row + x.owner
                columns = [pa.array(ids), pa.array(doc[owner], pa.int64()), pa.array(text[owner], pa.int64()), pa.array(x.number.astype(np.int32)), _words_array(x.simhashes(lead), has)]
                yield pa.RecordBatch.from_arrays(columns, ["line_id", "doc_id", "text_id", "line_no", "simhash"])

    return docs.mapInArrow(run, "line_id long, doc_id long, text_id long, line_no int, simhash binary")


def _words_array(words: np.ndarray, has: np.ndarray) -> pa.Array:
    """SimHashes as a column of binaries, null where `has` isn't set."""
    offsets = np.concatenate([[0], np.cumsum(has * (8 * WORDS))]).astype(np.int32)
    marks = np.packbits(has, bitorder="little").tobytes()
    return pa.BinaryArray.from_buffers(pa.binary(), len(has), [pa.py_buffer(marks), pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.tobytes())])


def _words(simhash: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The SimHashes of a column without nulls, a row each."""
    if isinstance(simhash, pa.ChunkedArray):
        simhash = simhash.combine_chunks()
    first = np.frombuffer(simhash.buffers()[1], np.int32)[simhash.offset] if len(simhash) else 0
    return np.frombuffer(simhash.buffers()[2] or b"", np.uint64, len(simhash) * WORDS, int(first)).reshape(-1, WORDS) if len(simhash) else np.zeros((0, WORDS), np.uint64)


def entries(nodes: DataFrame, parts: int) -> DataFrame:
    """(part, entries): the (block, node, 64 bits) of all blocks of a task's nodes, by part of the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _words(batch.column(1))
            found = np.empty((len(words), BLOCKS), _ENTRY)
            found["key"] = block_keys(words)
            found["id"] = batch.column(0).to_numpy()[:, None]
            found["bits"] = words[:, -1:]
            found = found.ravel()
            part = (mix(found["key"].astype(np.uint64) + np.uint64(1)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            found, part = found[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            blobs = [found[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(found)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(blobs, pa.binary())], ["part", "entries"])

    return nodes.mapInArrow(run, "part long, entries binary")


_ENTRY = np.dtype([("key", "<u4"), ("id", "<i8"), ("bits", "<u8")])


def _not_alone(blobs: pa.ChunkedArray) -> np.ndarray:
    """The entries of these blobs but for most of those whose key no other one has, told by counts of the keys' hashes."""
    found = []
    for x in blobs.chunks:
        ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
        found.append(np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    found = np.concatenate(found).view(_ENTRY)
    slot = found["key"] * np.uint32(0x9E3779B1) >> np.uint32(32 - min(2 * len(found), COUNTS).bit_length())
    return found[np.flatnonzero(np.bincount(slot)[slot] > 1)]


def partners(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the entries, sorted by key, have another one of their key within APART bits, and where each key begins. In a key of more than CROWD_BITS entries all count as such."""
    begin = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    n = np.diff(np.append(begin, len(key)))
    has = np.repeat(n > CROWD_BITS, n)
    left = np.where(has, 0, np.repeat(begin + n, n) - np.arange(len(key)) - 1)  # entries of the key that follow
    at, step = np.flatnonzero(left), 1
    while len(at):
        near = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= APART]
        has[near] = has[near + step] = True
        step += 1
        at = at[left[at] >= step]
    return has, begin


def candidates(nodes: DataFrame, parts: int) -> DataFrame:
    """(component, id, first, size): the nodes of each bucket that have a partner in it, how many they are, and the bucket's block; component stands for that set of nodes, so it is the same for buckets with the same ones."""

    def run(part: pa.Table) -> pa.RecordBatch | None:
        found = _not_alone(part["entries"])
        if not len(found):
            return None
        found = found[np.argsort(found["key"].astype(np.uint64) << np.uint64(32) | mix(found["id"].view(np.uint64)) >> np.uint64(32))]
        again = (found["key"][1:] == found["key"][:-1]) & (found["id"][1:] == found["id"][:-1])  # a node may have been sent by several tasks
        found = found[np.concatenate([[True], ~again])]
        key, ids = found["key"], found["id"]
        has, begin = partners(key, found["bits"])
        has_before = np.concatenate([[0], np.cumsum(has)])
        n = has_before[np.append(begin[1:], len(key))] - has_before[begin]
        ids = ids[has]
        if not len(ids):
            return None
        n = n[n > 0]
        sets = np.add.reduceat(mix(ids.view(np.uint64) + np.uint64(1)), np.cumsum(n) - n)
        block = (key[has] >> np.uint32(WIDTH)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(mix(sets).view(np.int64), n)), pa.array(ids), pa.array(block), pa.array(np.repeat(n, n))], ["component", "id", "first", "size"])

    return by_runs(entries(nodes, parts), ["part"], run, "component long, id long, first int, size long")


def _field(column: str, low: int, high: int):
    return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids, of 16 bits each and 8 MB at most; the ids are hashes, so their bits are the places."""
    bits = min(max((16 * ids.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    places = ids.select(F.explode(F.array(*(_field("id", s, s + bits) for s in PROBES))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    rows = words.toPandas()  # at most 2 ** 20 rows
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def may_contain(filter_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    found, ids = np.ones(len(ids), bool), ids.view(np.uint64)
    for s in PROBES:
        p = (ids >> np.uint64(s)) & np.uint64(64 * len(filter_) - 1)
        found &= (filter_[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return found


def hashes_of(lines: DataFrame, wanted: DataFrame, spot: bool = False) -> DataFrame:
    """(id, simhash) of the wanted ids and of a few others, once each, and, if asked for, the spot of one of the id's lines. A Bloom filter keeps most others from the shuffle or, where more than some millions are wanted, a part; the join that follows keeps out the rest."""
    marks = lines.sparkSession.sparkContext.broadcast(bloom(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.filter(pa.array(may_contain(marks.value, batch.column(0).to_numpy())))
            own = [pa.array(spots(found.column(2).to_numpy(), found.column(3).to_numpy()))] if spot else []
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1), *own], ["id", "simhash", "spot"][: 2 + spot])

    columns = ["line_id", "simhash", "text_id", "line_no"][: 4 if spot else 2]
    found = lines.where("simhash is not null").select(*columns).mapInArrow(run, "id long, simhash binary" + ", spot long" * spot)
    return found.dropDuplicates(["id"])


def forms_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, form) of the lines at the wanted spots (a column id), and of a few others, once each; a Bloom filter as in hashes_of(). Other lines aren't taken apart."""
    marks = docs.sparkSession.sparkContext.broadcast(bloom(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = marks.value
        for batch in batches:
            text_id = batch.column(0).to_numpy()
            for row, data, offsets in chunks(batch.column(1)):
                bounds, owner, number = line_starts(data, offsets)
                keep = np.flatnonzero(may_contain(filter_, spots(text_id[row + owner], number)))
                if not len(keep):
                    continue
                size = np.append(bounds[1:], len(data))[keep] - bounds[keep]
                at, begin = _ranges(bounds[keep], size)
                x = Lines(data[at], np.append(begin, len(at)))  # each line as a text of its own
                ids = x.ids()
                own = np.unique(ids, return_index=True)[1]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), x.forms(own)], ["id", "form"])

    return docs.select("text_id", "text").mapInArrow(run, "id long, form string").dropDuplicates(["id"])


def rewritten(a: str, b: str, most: int) -> bool:
    """Whether `most` edits are enough by one plain way: words in step, up to WINDOW of them written anew where they differ. True is certain, False says nothing."""
    x, y = a.split(" "), b.split(" ")
    n, m, i, j, cost = len(x), len(y), 0, 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        if i + 1 < n and j + 1 < m and x[i + 1] == y[j + 1]:  # one word for another, the commonest change
            cost += max(len(x[i]), len(y[j]))
            if cost > most:
                return False
            i, j = i + 1, j + 1
            continue
        p, q = next(((p, s - p) for s in range(1, WINDOW + 1) for p in range(s + 1) if i + p < n and j + s - p < m and x[i + p] == y[j + s - p]), (1, 1))
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q) - (1 if p and q else 0)
        if cost > most:
            return False
        i, j = i + p, j + q
    cost += sum(map(len, x[i:])) + n - i + sum(map(len, y[j:])) + m - j
    return cost <= most


def likely_pairs(task: np.ndarray, part: np.ndarray, first: np.ndarray, alone: np.ndarray, words: np.ndarray, chars: np.ndarray, percent: int, wanted=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, apart): the pairs of rows of each task that may be linked, and the bits in which they differ, at most one with each a at a time.

    Rows of a task stand together. Left out are pairs of one part in a task of two, pairs whose
    first common block is not `first`, pairs that differ in too many bits or in length, and those
    that wanted(a, b), asked each time, doesn't want."""
    begin = np.flatnonzero(np.diff(task, prepend=-1))
    n = np.diff(np.append(begin, len(task)))
    left = np.repeat(begin + n, n) - np.arange(len(task)) - 1
    keys, at, step = block_keys(words), np.flatnonzero(left), 1
    while len(at):
        a = at[np.bitwise_count(words[at, -1] ^ words[at + step, -1]) <= APART]
        b = a + step
        fits = (100 * np.abs(chars[a] - chars[b]) <= (100 - percent) * np.maximum(chars[a], chars[b])) & (alone[a] | (part[a] != part[b]))
        if wanted is not None:
            fits &= wanted(a, b)
        a, b = a[fits], b[fits]
        apart = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64)
        same = keys[a] == keys[b]
        fits = (apart <= APART_ALL) & (same.argmax(1) == first[a]) & same[np.arange(len(a)), first[a]]
        if fits.any():
            yield a[fits], b[fits], apart[fits]
        step += 1
        at = at[left[at] >= step]


class Forest:
    """Links that join up numbered rows, each only if it joins two that were apart."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def _tops(self, x: np.ndarray) -> np.ndarray:
        top = self.root[x]
        while ((up := self.root[top]) != top).any():
            top = up
        self.root[x] = top
        return top

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._tops(a) != self._tops(b)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            x = root[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.root[self.find(a)] = self.find(b)
        self.links.append((a, b))


def _tasks(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """The rows' task numbers, parts, first blocks, whether their task is of one part, and SimHash words."""
    group, i, j, part = (rows[c].to_numpy() for c in ("group", "i", "j", "block"))
    task = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    return task, part, group & (BLOCKS - 1), i == j, _words(rows["simhash"])


def held_to_all_bits(tasks: DataFrame) -> DataFrame:
    """(component, id): the nodes of each task that have a likely partner in it; component's last four bits are the block. tasks: group (its last four bits: the block), i, j, id, block, simhash."""

    def run(rows: pa.Table) -> pa.RecordBatch | None:
        task, part, first, alone, words = _tasks(rows)
        has = np.zeros(len(task), bool)
        for a, b, _ in likely_pairs(task, part, first, alone, words, np.zeros(len(task), np.int64), 0, lambda a, b: ~(has[a] & has[b])):
            has[a] = has[b] = True
        kept = np.flatnonzero(has)
        if not len(kept):
            return None
        group, i, j, ids = (rows[c].to_numpy()[kept] for c in ("group", "i", "j", "id"))
        name = mix(group.view(np.uint64) ^ mix(i.astype(np.uint64) << np.uint64(32) | j.astype(np.uint64)))
        name = (name & np.uint64(~(BLOCKS - 1) & (1 << 64) - 1)).view(np.int64) + first[kept]
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(ids)], ["component", "id"])

    return by_many_runs(tasks, ["group", "i", "j"], run, "component long, id long")


def confirmed(tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the linked lines of each task; tasks: as for held_to_all_bits(), and form."""

    def run(rows: pa.Table) -> pa.RecordBatch | None:
        task, part, first, alone, words = _tasks(rows)
        ids, chars = rows["id"].to_numpy(), pc.utf8_length(rows["form"]).to_numpy().astype(np.int64)
        forms, forest, held = rows["form"].to_pylist(), Forest(len(ids)), []

        def still_apart(a: np.ndarray, b: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
            """The pairs that no link joins yet, AT_ONCE asked at a time, each with the edits that it allows."""
            for k in range(0, len(a), AT_ONCE):
                x, y = a[k : k + AT_ONCE], b[k : k + AT_ONCE]
                apart = forest.apart(x, y)
                x, y = x[apart], y[apart]
                yield list(zip(x.tolist(), y.tolist(), ((100 - percent) * np.maximum(chars[x], chars[y]) // 100).tolist(), strict=True))

        def texts(x: int, y: int, most: int) -> tuple[str, str, int]:
            return forms[x], forms[y], most

        def settle():  # the likeliest first, since one link spares others; the slower way last, when fewest pairs are apart
            a, b, apart = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, rest = np.argsort(apart, kind="stable"), []
            for pairs in still_apart(a[order], b[order]):
                for x, y, most in pairs:
                    if forest.find(x) != forest.find(y):
                        if rewritten(*texts(x, y, most)):
                            forest.join(x, y)
                        else:
                            rest.append((x, y))
            for pairs in still_apart(*np.array(rest, np.int64).reshape(-1, 2).T):
                for (x, y, _), near in zip(pairs, all_within([texts(*p) for p in pairs]).tolist(), strict=True):
                    if near and forest.find(x) != forest.find(y):
                        forest.join(x, y)

        waiting = 0
        for found in likely_pairs(task, part, first, alone, words, chars, percent, forest.apart):
            held.append(found)
            waiting += len(found[0])
            if waiting > WAITING:
                settle()
                waiting = 0
        if held:
            settle()
        if not forest.links:
            return None
        links = np.array(forest.links)
        return pa.RecordBatch.from_arrays([pa.array(ids[links[:, 0]]), pa.array(ids[links[:, 1]])], ["a", "b"])

    return by_many_runs(tasks, ["group", "i", "j"], run, "a long, b long")


def find_duplicates(docs: DataFrame, percent: int = 90, scratch: Scratch | None = None) -> DataFrame:
    """(component, line_id, place, keep) of every line whose form occurs again or is linked to another: its (doc_id, text_id, line_no), and that of the line of its group that stays."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_id"), F.col("text").cast("string").alias("text"))
    lines = scratch.keep(line_table(docs, percent), "snappy")
    parts = max(LEAST_PARTS, -(-lines.count() * BLOCKS // PART))
    met = candidates(lines.where("simhash is not null").select("line_id", "simhash"), parts).groupBy("component", "id").agg(F.min("first").alias("first"), F.max("size").alias("size"))
    met = scratch.keep(met.select("id", (F.col("component").bitwiseAND(F.lit(-BLOCKS)) + F.col("first")).alias("component"), F.ceil(F.col("size") / CROWD_BITS).cast("int").alias("blocks")), "snappy")
    wanted = scratch.keep(met.select("id").distinct())
    alive = scratch.keep(held_to_all_bits(in_blocks(met).join(shuffled(hashes_of(lines, wanted)), "id")))
    scratch.release(met, wanted)
    wanted = scratch.keep(alive.select("id").distinct())
    hashes = scratch.keep(hashes_of(lines, wanted, spot=True).join(shuffled(wanted), "id"), "snappy")
    known = scratch.keep(forms_of(docs, hashes.select(F.col("spot").alias("id"))).join(shuffled(hashes.drop("spot")), "id"))
    scratch.release(hashes)
    dealt = deal(alive, known.select("id", F.length("form").cast("long").alias("weight")), CROWD, CHARS)
    links = scratch.keep(confirmed(dealt.join(known, "id"), percent))
    scratch.release(alive, wanted, known)
    near = components(spark, links, scratch).withColumnRenamed("id", "line_id")
    again = lines.groupBy("line_id").agg(F.count("*").alias("n")).where("n > 1").select("line_id")
    named = scratch.keep(again.join(near, "line_id", "full").select("line_id", F.coalesce("component", "line_id").alias("component")))
    place = F.struct("doc_id", "text_id", "line_no").alias("place")
    rows = scratch.keep(lines.select("line_id", place).join(named, "line_id"))
    scratch.release(lines, links, named)
    first = scratch.keep(rows.groupBy("component").agg(F.min("place").alias("keep")))  # a table of its own, so that the join back can be split
    return rows.select("component", "line_id", "place").join(first, "component")


def deduplicate(docs: DataFrame, percent: int = 90, scratch: Scratch | None = None) -> DataFrame:
    """docs with all but one occurrence of every group of near-equal lines cut from the texts, and n_lines, n_removed and removed (line numbers).

    Lines end in a newline. Two forms are linked if they share a block of their SimHashes, differ
    in at most APART of their other 64 bits and APART_ALL of all, and 100 * edit distance <= (100 - percent) * the longer
    length; groups are connected by links. The occurrence with the smallest (doc_id, hash of the
    text, line number) stays. Lines without a letter, a digit or a character beyond ASCII have no
    form and always stay. A null text stays null, with no line; an empty one has one. Rows without
    a doc_id stay as they are; rows that share doc_id and text are treated alike; columns of docs
    are kept, but for those named like the three new ones; an empty table gives an empty result.
    """
    extra = find_duplicates(docs, percent, scratch).where("place <> keep").select("place.*")
    cut = extra.groupBy(F.col("doc_id").alias("__cut_id"), F.col("text_id").alias("__cut_text")).agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    same = (F.col("doc_id") == F.col("__cut_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__cut_text"))
    joined = docs.select(*(F.col(f"`{c}`") for c in kept)).join(cut, same, "left")
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    stay = F.filter(F.split(F.col("text"), "\n", -1), lambda _, i: ~F.array_contains("removed", i))
    return joined.select(
        *(F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in kept),
        F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long").alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )
