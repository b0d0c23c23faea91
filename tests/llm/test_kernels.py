"""Kernels without Spark, each against a plain version."""

import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinlake.llm import bpe, decontaminate, editing, lines, neardup, secrets, substrings, text, toxicity, vectors, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b\x1c😀", max_size=30)), max_size=8))
def test_words(texts):
    found = []
    for _, data, offsets in text.chunks(pa.array(texts, pa.string())):
        starts, ends, first = text.spans(data, offsets)
        words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        found += [words[a:b] for a, b in zip(first, first[1:])]
        hashes = text.word_hashes(data, starts, ends)
        assert len({(w, h) for w, h in zip(words, hashes.tolist())}) == len(set(words)) == len(set(hashes.tolist()))
    assert found == [WORD.findall(t or "") for t in texts]


def test_long_words_and_texts():
    texts = ["a" * 200_000 + " b " + "ab " * 900_000, "b", "a" * 200_000]
    seen = {}
    for _, data, offsets in text.chunks(pa.array(texts)):
        starts, ends, first = text.spans(data, offsets)
        for size, h in zip((ends - starts).tolist(), text.word_hashes(data, starts, ends).tolist()):
            seen.setdefault(size, set()).add(h)
    assert {n: len(h) for n, h in seen.items()} == {200_000: 1, 1: 1, 2: 1}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=14), st.text(alphabet="abc", max_size=14), st.integers(0, 14))
def test_distance(a, b, most):
    assert editing.distance(a, b, most) == min(plain_distance(a, b), most + 1)


def test_decontamination_matches_brute_force():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    items = [(i, decontaminate.normal(" ".join(word() for _ in range(12)))) for i in range(12)]
    found = decontaminate.Matcher(items, 0.1)
    for trial in range(60):
        i, item = rng.choice(items)
        edited = list(item)
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(edited))
            edited[at] = rng.choice(["", rng.choice("abcdefghijkl"), edited[at] + "z"])
        passage = decontaminate.normal("".join(edited))
        doc = decontaminate.normal(" ".join(word() for _ in range(20)) + " " + passage + " " + " ".join(word() for _ in range(20)))
        hits = {n for n, *_ in found.search(doc)}
        for n, form in items:
            best = editing.best_end(editing.masks(form), len(form), doc, len(form))
            assert (n in hits) == (best[0] <= int(len(form) * 0.1)), (trial, n, best)


def test_minhash_and_confirm():
    sets = [np.unique(np.random.default_rng(i // 2).integers(0, 1 << 60, 200, dtype=np.uint64)) for i in range(10)]
    sets[1] = sets[0][:180].copy()
    links = neardup.confirm(np.arange(10), sets, 85)
    assert {tuple(sorted(x)) for x in links} == {(0, 1), (2, 3), (4, 5), (6, 7), (8, 9)}
    assert neardup.depth_for(85) == 6 and neardup.depth_for(80) == 4


def test_winnowing_owner_is_the_last_least():
    h = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    got = substrings.winnow(h, 24)
    for i in range(len(h) - 23):
        w = h[i : i + 24]
        assert got[i] == i + max(j for j in range(24) if w[j] == w.min())


def test_edit_distances_side_by_side(monkeypatch):
    rng = random.Random(6)
    pairs = [("", "", 0), ("", "abc", 3), ("", "abc", 2), ("a" * 64, "a" * 63 + "b", 1), ("x" * 65, "y" * 65, 64), ("x" * 65, "y" * 65, 65), ("a\0b", "acb", 1)]
    for _ in range(600):
        a = "".join(rng.choice("abcdé😀 ") for _ in range(rng.choice((3, 20, 64, 65, 130, 300))))
        b = list(a)
        for _ in range(rng.randint(0, 30)):
            spot, kind = rng.randrange(len(b) + 1), rng.random()
            if kind < 0.4 and b:
                b[min(spot, len(b) - 1)] = rng.choice("abcdxyz")
            elif kind < 0.7:
                b.insert(spot, rng.choice("abcq"))
            elif b:
                del b[min(spot, len(b) - 1)]
        pairs.append((a, "".join(b), rng.randint(0, 25)))
    want = [plain_distance(a, b) <= most for a, b, most in pairs]
    for longest in (editing.SIDE_BY_SIDE, 100):
        monkeypatch.setattr(editing, "SIDE_BY_SIDE", longest)
        assert editing.all_within(pairs).tolist() == want
    monkeypatch.setattr(editing, "TABLE", 1 << 10)
    assert editing.all_within(pairs).tolist() == want
    assert editing.all_within([]).tolist() == []


def test_long_texts_without_common_grams_are_told_apart_without_columns(monkeypatch):
    rng = random.Random(31)
    text = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(n))
    pairs = []
    for n in (120, 250, 600):
        a = text(n)
        most = len(a) // 10
        for edits in (0, most // 2, most, 2 * most):
            b = list(a)
            for _ in range(edits):
                i = rng.randrange(len(b))
                b[i : i + 1] = rng.choice([[], ["\ud800"], [b[i], "z"], [" "]])
            pairs.append((a, "".join(b), most))
        pairs += [(a, "", len(a)), (a, text(n), most)]
    for marks in (editing.MARKS, 1):  # all pairs together, and each alone
        monkeypatch.setattr(editing, "MARKS", marks)
        may = editing.may_be_within(pairs)
        assert all(may[i] for i, (a, b, most) in enumerate(pairs) if editing.distance(a, b, most) <= most) and not may[5::6].any()
    monkeypatch.setattr(editing, "_side_by_side", lambda pairs: 1 / 0)
    a = text(300)
    assert editing.all_within([(a, (text(300) + a)[: len(a)], len(a) // 10)]).tolist() == [False]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_maximal_repeats():
    assert substrings.maximal(np.array([9, 3, 4, 3, 20]), 5).tolist() == [[3, 14], [20, 25]]
    assert substrings.maximal(np.array([0, 5, 11]), 5).tolist() == [[0, 10], [11, 16]]
    assert substrings.maximal(np.zeros(0, int), 5).tolist() == []


def test_line_forms_and_ids():
    texts = ["The quick, brown fox jumps 12\n\n__short\nthe quick BROWN fox-jumps 93", None, "é É x\n"]
    ((_, data, offsets),) = text.chunks(pa.array(texts))
    x = lines.Lines(data, offsets)
    assert x.owner.tolist() == [0, 0, 0, 2] and x.number.tolist() == [0, 2, 3, 0]
    assert x.forms(np.arange(4)).to_pylist() == ["the quick brown fox jumps 00", "short", "the quick brown fox jumps 00", "é É x"]
    ids, hashes = x.ids(), x.simhashes(np.arange(4))
    assert ids[0] == ids[2] != ids[1] and x.size.tolist() == [28, 5, 28, 7]
    assert (hashes[0] == hashes[2]).all() and (hashes[0] != hashes[1]).any()


def test_simhash_is_the_majority_of_the_features():
    rng = np.random.default_rng(1)
    m = rng.integers(1, 20, 50)
    row, feature = np.repeat(np.arange(50), m), rng.integers(0, 1 << 40, m.sum()).astype(np.uint64)
    got = lines.majority(row, feature, 50)
    hashes = feature[:, None] * lines._ODD
    hashes ^= hashes >> np.uint64(32)
    bits = np.unpackbits(got.view(np.uint8), axis=1, bitorder="little")
    keys = lines.block_keys(got)
    for r in range(50):
        own = np.unpackbits(hashes[row == r].view(np.uint8), axis=1, bitorder="little")
        twice = 2 * own.sum(0, dtype=int)
        assert (bits[r] == np.where(twice == m[r], own[0], twice > m[r])).all()
        for k in range(lines.BLOCKS):
            block = bits[r, k * lines.WIDTH : (k + 1) * lines.WIDTH].astype(np.int64) @ (1 << np.arange(lines.WIDTH))
            assert keys[r, k] == block + (k << lines.WIDTH)


def test_partners_of_line_entries():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 40, 120).astype(np.uint32))
    bits = rng.integers(0, 1 << 12, 120).astype(np.uint64) * np.uint64(0x1001001001001)
    for crowd in (1, 3, 1000):
        lines.CROWD_BITS, held = crowd, lines.CROWD_BITS
        try:
            has, begin = lines.partners(key, bits)
        finally:
            lines.CROWD_BITS = held
        assert begin.tolist() == [int(np.argmax(key == k)) for k in np.unique(key)]
        for i in range(120):
            others = [j for j in np.flatnonzero(key == key[i]) if j != i]
            assert has[i] == (len(others) >= crowd or any(int(bits[i] ^ bits[j]).bit_count() <= lines.APART for j in others))


def test_marginals_match_plain_forward_backward():
    rng = np.random.default_rng(0)
    f = toxicity.Field(np.zeros(toxicity.BUCKETS + 1), rng.normal(size=(2, 2)), rng.normal(size=2))
    first = np.concatenate([[0], np.cumsum([0, 3, 64, 65, 1, 200, 0])])
    scores = rng.normal(size=first[-1]) * 2
    got = f.marginals(scores, first)
    t = np.exp(f.transitions)
    for a, b in zip(first, first[1:]):
        v, alpha = np.exp(f.start), []
        for i in range(a, b):
            v = (v @ t) * np.array([1, np.exp(scores[i])])
            v = v / v.sum()
            alpha.append(v)
        v = np.ones(2)
        for i in range(b - 1, a - 1, -1):
            both = alpha[i - a] * v
            assert got[i] == pytest.approx(both[1] / both.sum(), abs=1e-12)
            v = t @ (v * np.array([1, np.exp(scores[i])]))
            v = v / v.sum()


def test_battery_tells_random_from_ordinary():
    table = np.full((97, 97), 0.01)
    words = "the cat sat on a mat and then the other one came along too "
    for x, y in zip(words * 50, words[1:] * 50):
        table[ord(x) - 32, ord(y) - 32] += 1
    o = secrets.Ordinary(table)
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(20)]
    ordinary = ["thecatsatonamatandthentheotheronecame"] * 3 + ["a" * 40]
    assert np.median(o.p_values(tokens)) < 0.01 and o.p_values(ordinary).min() > 0.01
    assert o.p_values([]).shape == (0,)


def test_secret_spans_follow_the_plain_patterns():
    plain = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    rng = random.Random(2)
    parts = ["token", "secret", "API_KEY", "passwd", "=", ":", " ", '"', "abc", "abcdefg", "AKIA", "A" * 16, "AKIA" + "B" * 16, "f" * 24, "0" * 23, "é", "ſecret", "K", "\n"]
    for _ in range(800):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = [(m.start(), 0, m.end()) for m in plain.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secrets.base_spans(t) == sorted(want)
        if want:
            (_, data, offsets), *_ = text.chunks(pa.array([t]))
            assert secrets.may_hold(data, offsets).tolist() == [0]


def test_warc_round_trip():
    payloads = [b"", b"x", b"a\r\n\r\nb\0", bytes(range(256)) * 100_000]
    whole = [warc.record(f"<urn:{i}>", i, "http://e/ x", warc.DATE, warc.http_head(len(p)), p, warc.digest(p), len(p)) for i, p in enumerate(payloads)]
    for raw in (b"".join(m for r in whole for m in warc.members(r)), b"".join(whole)):
        got = [warc._head(h, b) for h, b in warc.records(raw)]
        assert [p for _, p in got] == payloads and [h[:4] for h, _ in got] == [[f"<urn:{i}>", "response", i, "http://e/%20x"] for i in range(4)]
    with pytest.raises(ValueError):
        list(warc.records(raw[:-3]))
    with pytest.raises(ValueError):
        warc._head({"warc-type": "response", "warc-record-id": "x", "warc-payload-digest": "sha1:" + warc.digest(b"y")}, b"HTTP/1.1 200 OK\r\n\r\nx")
    assert all(m[-1] == 0 for p in payloads for m in warc.members(p))


def test_bpe_matches_the_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    c = bpe.Codec(bpe.load(P.path("byte_bpe_50k.json")))
    texts = ["", " ", "\n", "Hello, world's <|endoftext|> x", "a" * 3000, "ab" * 400 + "  c", " é😀\x1c\x85 y", "don't  stop\n\n now ", "1234 a1b2", "x" * 64, "x" * 65]
    want = t.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):  # met for the first time, then remembered
        ids, first = c.encode_batch(texts)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [w.ids for w in want]
        assert c.decode_batch(ids, first) == [t.decode(w.ids, skip_special_tokens=False) for w in want]
        assert c.digests(ids, first) == [hashlib.sha256(",".join(map(str, w.ids)).encode()).hexdigest() for w in want]


def test_bpe_remembers_two_generations(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    c = bpe.Codec(bpe.load(P.path("byte_bpe_50k.json")))
    for text in ("one two three four five", "two six, seven eight! nine", "one six, ten eleven twelve", "two one nine thirteen"):
        ids, _ = c.encode_batch([text])
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
        assert max(len(m.young) + len(m.old) for m in (c.known, c.spaced)) <= 20


def test_bpe_refuses_other_tokenizers():
    P = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError):
        bpe.Codec(bpe.load(P.path("word_bpe_49k.json")))
    spec = json.loads(bpe.load(P.path("byte_bpe_50k.json")))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.check_settings(spec | change)


def test_vector_scan_finds_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    norm = np.linalg.norm(x, axis=1).max()
    index = vectors.Index(x[:200], np.arange(200), norm, 600, 5)
    lists_ = index.nearest(index.turn(x), 1)[:, 0]
    order = np.argsort(lists_, kind="stable")
    probes = list(index.nearest(index.turn_query(x[:50]), len(index.centroids)))
    a, b, s = vectors.scan(index, lists_[order], order, x[order], np.arange(50), x[:50], probes, np.full(50, -np.inf))
    good = 0
    for q in range(50):
        full = x @ x[q]
        full[q] = -np.inf
        good += len(set(np.argsort(-full)[:5]) & set(order[b[a == q]]))
    assert good >= 0.97 * 250
