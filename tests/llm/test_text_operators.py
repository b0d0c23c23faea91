"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinlake.llm import bpe, decontaminate, lines, neardup, quality, secrets, substrings, toxicity, vectors, warc, work

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, `group` string, removed string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s" if i is None or i % 3 else None, len(t or ""), 7, "g", "r") for i, t in texts], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base = [prose(rng, 120) for _ in range(6)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "two words"), (6, "é ü"), (7, prose(rng, 60_000))]
    for b in base:
        for edits in (0, 0, 1, 2, 4, 8):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "changed"
            out.append((len(out), " ".join(w)))
    out.append((len(out), prose(rng, 40) + " " + " ".join(base[0].split()[10:60])))
    return out


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (200, None)]
    got = dict(work.components(spark, spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert work.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_small_runs(spark, monkeypatch):
    monkeypatch.setattr(work, "LINKS_AT_ONCE", 4)
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1001 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(60)]
    rng.shuffle(links)
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(links, "a long, b long").repartition(5).coalesce(5)
    got = work.components(spark, df).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert len(got) == len(linked) and {r["id"]: r["component"] for r in got} == {x: find(x) for x in linked}


def test_near_duplicates_against_brute_force(spark, corpus):
    sets = {}
    for i, t in corpus:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, corpus), 3, 85).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert got[4][1] == 3
    twice = neardup.near_duplicates(table(spark, corpus[3:5] + corpus[3:5] + [(None, "one")]), 3, 85)
    assert sorted((r["doc_id"], r["component_id"]) for r in twice.collect()) == [(3, 3), (3, 3), (4, 3), (4, 3)]
    assert neardup.near_duplicates(table(spark, []), 3, 85).count() == 0


def test_large_components_are_split_into_blocks(spark, corpus, monkeypatch):
    want = sorted(tuple(r) for r in neardup.near_duplicates(table(spark, corpus), 3, 85).collect())
    monkeypatch.setattr(neardup, "BLOCK", 2)
    assert sorted(tuple(r) for r in neardup.near_duplicates(table(spark, corpus), 3, 85).collect()) == want


def test_substrings_against_brute_force(spark, corpus):
    words = {i: WORD.findall(t or "") for i, t in corpus}
    seen = Counter(" ".join(w[j : j + 35]) for w in words.values() for j in range(len(w) - 34))
    want = {}
    for i, w in words.items():
        gone = {k for j in range(len(w) - 34) if seen[" ".join(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.deduplicate(table(spark, corpus)).collect()}
    assert got == want
    assert substrings.deduplicate(table(spark, [])).count() == 0
    same = prose(random.Random(1), 50)
    one = substrings.deduplicate(table(spark, [(1, same + " x " + same), (None, same)])).collect()
    assert [(r["n_words"], r["n_removed"]) for r in one] == [(101, 100)]
    other, end = prose(random.Random(2), 50), prose(random.Random(3), 40)
    shared = substrings.deduplicate(table(spark, [(1, same), (1, other + " " + end), (2, end), (3, other), (3, other), (4, "few words"), (4, "few words")])).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in shared) == [(1, 50, 0), (1, 90, 90), (2, 40, 40), (3, 50, 50), (3, 50, 50), (4, 2, 0), (4, 2, 0)]


def test_warc_revisits(spark):
    rows = [(1, "http://a", "x", 1), (2, None, "x", 1), (3, "u\r\nv", None, 1), (4, "w", "", 1), (None, "n", "x", 1), (5, "é", "ß" * 5000, 1), (5, "é", "ß" * 5000, 1)]
    heads, path = warc.deduplicate(spark.createDataFrame(rows, "page_id long, url string, html string, body int"))
    got = sorted((tuple(r)[:1] + tuple(r)[2:] for r in heads.collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, "revisit", 1, sha("x"), 2), (2, "response", 1, sha("x"), None), (3, "revisit", 0, sha(""), 4), (4, "response", 0, sha(""), None), (None, "revisit", 1, sha("x"), 2)]
    want += [(5, "response", 10_000, sha("ß" * 5000), None)] * 2
    assert got == sorted(want, key=str)
    empty, _ = warc.deduplicate(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.count() == 0


def warc_text(kind, name, block, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: " + headers.pop("date", "2020-01-01T00:00:00Z")]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_back(spark, path):
    """Payloads by record id, and the RECORD rows."""
    found = {}
    for row in warc._archives(spark, path).collect():
        for h, b in warc.records(bytes(row["content"])):
            found.setdefault(h["warc-record-id"], []).append((h["warc-type"], warc.split_block(b)[1]))
    return found, {r["rec"]: r for r in warc.read_records(spark, path).collect()}


def test_warc_of_others(spark, tmp_path):
    """Archives written elsewhere: other kinds of records, revisits of the source, file names, no page ids."""
    import gzip

    http, page = b"HTTP/1.1 200 OK\r\nServer: a\r\n\r\n", b"<p>one</p>"
    sha = lambda x: "sha1:" + warc.digest(x)
    one = [
        warc_text("warcinfo", "i", b"software: x\r\n", Content_Type="application/warc-fields"),
        warc_text("request", "q", b"GET / HTTP/1.1\r\n\r\n", WARC_Target_URI="http://a/"),
        warc_text("response", "a", http + page, WARC_Target_URI="http://a/", WARC_Payload_Digest=sha(page)),
        warc_text("response", "b", http + page, WARC_Target_URI="http://b/", date="2021-01-01T00:00:00Z"),
        warc_text("metadata", "m", b"k: v\r\n", WARC_Concurrent_To="<a>"),
    ]
    two = [
        warc_text("revisit", "r", http, WARC_Refers_To="<a>", WARC_Target_URI="http://a/"),
        warc_text("revisit", "s", http, WARC_Payload_Digest=sha(b"elsewhere"), WARC_Refers_To="<z>"),
        warc_text("response", "p1", http + b"two", X_Page_Id="1", WARC_Payload_Digest=sha(b"two")),
        warc_text("revisit", "p2", http, X_Page_Id="2", WARC_Payload_Digest=sha(b"two"), X_Refers_To_Page_Id="1"),
        warc_text("response", "e", http, X_Page_Id="3"),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one))
    (tmp_path / "in" / "y.warc").write_bytes(b"".join(two))
    warc.rewrite(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    payloads, rows = read_back(spark, f"file://{tmp_path}/out")
    assert payloads == {
        "<i>": [("warcinfo", b"software: x\r\n")], "<q>": [("request", b"GET / HTTP/1.1\r\n\r\n")], "<m>": [("metadata", b"k: v\r\n")],
        "<a>": [("response", page)], "<b>": [("revisit", b"")], "<r>": [("revisit", b"")], "<s>": [("revisit", b"")],
        "<p1>": [("revisit", b"")], "<p2>": [("response", b"two")], "<e>": [("response", b"")],
    }
    assert {n: rows[n]["refers"] for n in ("<b>", "<r>", "<s>", "<p1>")} == {"<b>": "<a>", "<r>": "<a>", "<s>": "<z>", "<p1>": "<p2>"}
    assert rows["<p1>"]["refers_page"] == 2 and rows["<p1>"]["bytes"] == 3 and rows["<a>"]["http"] == http and rows["<b>"]["date"] == "2021-01-01T00:00:00Z"
    warc.rewrite(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/again")
    assert read_back(spark, f"file://{tmp_path}/again") == (payloads, rows)


def test_warc_keeps_every_payload_however_small_its_filters(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILTER_BITS", (6, 6))  # nearly every record meets such a filter
    rows = [(i, f"http://{i}", f"text {i % 60}" if i % 7 else "") for i in range(200)]
    heads, path = warc.deduplicate(spark.createDataFrame(rows, "page_id long, url string, html string"))
    last = {}
    for i, _, h in rows:
        last[h] = max(i, last.get(h, -1))
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in heads.collect()} == {(i, "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, _, h in rows}
    payloads, found = read_back(spark, path)
    assert len(payloads) == 200 and {found[n]["page_id"]: p for n, [(kind, p)] in payloads.items() if kind == "response"} == {i: h.encode() for h, i in last.items()}


def test_warc_small_payloads_are_all_responses(spark):
    rows = [(1, None, "ab"), (2, None, "ab"), (3, None, "abcdef"), (4, None, "abcdef")]
    heads, _ = warc.deduplicate(spark.createDataFrame(rows, "page_id long, url string, html string"), least_bytes=5)
    assert {r["page_id"]: r["refers_to"] for r in heads.collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_toxicity_learns_and_tags(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(300):
        w = prose(rng, 40).split()
        if i % 3 == 0:
            w[rng.randrange(40)] = "vilewords"
            w[rng.randrange(40)] = "vilewords!"
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    docs += [(900, None), (901, ""), (902, "vilewords " * 30_000), (902, "fine"), (903, "éö " + docs[0][1])]
    d, known = table(spark, docs), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    field = spark.sparkContext.broadcast(toxicity.fit(d, known))
    got = toxicity.tag(d, field).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] < 300}
    assert len(got) == 305 and all(0 <= r["score"] <= 1 for r in got)
    assert sum((by[i]["score"] >= 0.5) == (i % 3 == 0) for i in range(300)) >= 295
    for i, t in (docs[0], docs[-1]):  # offsets in code points
        (spans,) = (r["spans"] for r in got if r["doc_id"] == i)
        assert spans and all("vilewords" in t[s["start"] : s["end"]] and t[s["start"] : s["end"]].strip() == t[s["start"] : s["end"]] for s in spans)
    assert toxicity.tag(table(spark, []), field).count() == 0
    bare = toxicity.fit(d, known.where("false"))
    assert toxicity.tag(d, spark.sparkContext.broadcast(bare)).count() == 305


def test_secrets(spark):
    rng = random.Random(6)
    rows = [(0, None), (1, ""), (2, "token = abcdef0"), (3, "é" * 5 + " AKIA" + "Z" * 16), (4, "f" * 30), (5, prose(rng, 9000)), (5, "token: x"), (None, "secret=abcdefg")]
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48))
    rows += [(10 + i, f"see {key[i:] + key[:i]} there") for i in range(12)]
    got = secrets.find_secrets(table(spark, rows), ["doc_id"]).collect()
    base = {(r["doc_id"], tuple(map(tuple, r["base"]))) for r in got}
    assert len(got) == len(rows)
    assert (2, (("assign", 0, 15),)) in base and (3, (("access", 6, 26),)) in base and (4, (("hex", 0, 30),)) in base and (None, (("assign", 0, 14),)) in base
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got}
    assert sum(found[10 + i] == [("random", 4, 52)] for i in range(12)) >= 11
    assert found[0] == found[1] == []
    assert secrets.find_secrets(table(spark, []), ["doc_id"]).count() == 0


def test_lines(spark):
    rng = random.Random(8)
    a, b = prose(rng, 90), prose(rng, 12)
    near = a.replace(a.split()[40], "q", 1)
    rows = [(1, f"{a}\n{b}\nshort"), (2, f"{b.upper()}\n\nshort\n{prose(rng, 20)}"), (3, near), (4, None), (5, ""), (6, f"{b}\n{b}"), (None, a)]
    got = {r["doc_id"]: r for r in lines.deduplicate(table(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["text"] == "\n" + rows[1][1].split("\n")[3] and got[2]["removed"] == [0, 2] and got[2]["n_lines"] == 4
    assert got[6]["text"] == "" and got[6]["n_removed"] == 2 and got[4]["text"] is None and got[4]["n_lines"] == 0
    assert got[5]["n_lines"] == 1 and got[None]["text"] == a and got[1]["group"] == "g"
    assert lines.deduplicate(table(spark, [])).count() == 0


def test_decontamination(spark):
    rng = random.Random(12)
    item = "The Quick, brown fox; jumps over " + prose(rng, 20)
    docs = [(1, "İx " + prose(rng, 30) + " " + item.upper().replace(" ", "\n  ") + " end"), (2, prose(rng, 50)), (3, None), (4, ""), (5, item), (5, item), (None, item)]
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "tiny", 0), (1, item, 0), (9, "", 0)], "item_id long, text string, doc_id int")
    got = decontaminate.contaminated(table(spark, docs), bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == {(1, 1): 2, (5, 1): 4, (None, 1): 2}
    hit = next(r for r in got if r["doc_id"] == 1)
    assert decontaminate.normal(docs[0][1][hit["start"] : hit["end"]]) == decontaminate.normal(item) and hit["distance"] == 0
    assert sorted(r["doc_id"] for r in decontaminate.clean(table(spark, docs[:6]), bench).collect()) == [2, 3, 4]
    assert decontaminate.contaminated(table(spark, []), bench).count() == 0
    assert decontaminate.contaminated(table(spark, docs), bench.where("false")).count() == 0


def test_benchmark_blocks(spark, monkeypatch):
    rng = random.Random(13)
    items = [(i, prose(rng, 15)) for i in range(9)]
    docs = table(spark, [(i, prose(rng, 5) + " " + t) for i, t in items])
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i, _ in items}


def test_bpe_operator(spark, corpus):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    codec = spark.sparkContext.broadcast(bpe.Codec(bpe.load(P.path("byte_bpe_50k.json"))))
    rows = corpus + [(3, "one"), (None, "<|endoftext|> x")]
    got = bpe.decode(bpe.encode(table(spark, rows), codec), codec).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["token_ids"] == t.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "") and r["group"] == "g"
    digests = bpe.encode(table(spark, rows).withColumn("n_tokens", F.lit("x")), codec, into=None, decoded="group", digests=True, keep_text=False)
    assert sorted(digests.columns) == sorted(["doc_id", "lang", "source", "n_chars", "id", "removed", "group", "n_tokens", "ids_sha256", "decoded_sha256"])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((i, x or "", len(ids), sha(",".join(map(str, ids))), sha(x or "")) for i, x in rows for ids in [t.encode(x or "", add_special_tokens=False).ids])
    assert Counter((r["doc_id"], r["group"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests.collect()) == want
    assert bpe.encode(table(spark, []), codec).count() == 0 and bpe.encode(table(spark, []), codec, into=None, digests=True).count() == 0


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).round(3)
    x[50:120] = x[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (920, [0.0] * 8, 0), (940, [1.0, None] + [0.0] * 6, 0), (960, [float("nan")] * 8, 0), (980, [1.0, 2.0], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = defaultdict(list)
    for r in vectors.search(df, F.pmod("id", F.lit(20)) == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 20)) and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        hits += len(set(want) & {v for v, _ in found})
        assert all(abs(s[v] - y) < 1e-12 for v, y in found) and [(-y, v) for v, y in found] == sorted((-y, v) for v, y in found)
    assert hits >= 0.95 * 20 * len(got)
    few = vectors.search(df.where("vec_id < 5"), F.col("id") == 0, 20).collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4]
    assert vectors.search(df.where("false"), F.col("id") == 0, 20).count() == 0


def test_quality(spark):
    rng = random.Random(14)
    docs, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        docs.append((i, prose(rng, 60) if good else " ".join(w + "###" for w in prose(rng, 60).split())))
        labels.append((i, int(good), 0))
    docs += [(900, None), (901, ""), (902, prose(rng, 30_000)), (902, "fine words here")]
    d = table(spark, docs).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).otherwise((F.col("doc_id") % 5).cast("string")))
    known = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score(d, known).collect()
    assert len(got) == 244
    assert sum((r["posterior"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in got if r["doc_id"] < 240) == 240
    assert all(0 < r["host_share"] < 1 and 0 < r["path_share"] < 1 for r in got)
    assert quality.keep_good(d, known).columns == d.columns
    assert quality.score(table(spark, []), known).count() == 0
    assert quality.score(d, known.where("false")).count() == 244


def test_posteriors_against_plain_arithmetic(spark):
    import math

    rng = random.Random(15)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, "x", "y"]), rng.gauss(1, 2), i) for i in range(300)] + [("d", "z", -3.0, 300)]
    got = {r["total"]: r for r in quality.posteriors(spark.createDataFrame(rows, "h string, q string, evidence double, total long"), "h", "q").collect()}
    share = lambda e: 1 / (1 + math.exp(-e))
    logit = lambda p: math.log(p / (1 - p))

    def strength(groups, means):
        n = sum(len(g) for g in groups)
        between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, means))
        noise = sum((sum(x * x for x in g) - sum(g) ** 2 / len(g)) / max(len(g) - 1, 1) for g in groups)
        return min(max(max(m * (1 - m) for m in means) / max((between - noise) / n, 1e-9) - 1, 2), 10_000)

    hosts, paths = defaultdict(list), defaultdict(list)
    for h, q, e, _ in rows:
        hosts[h].append(share(e))
        paths[h, q].append(share(e))
    mean = sum(map(sum, hosts.values())) / len(rows)
    up = strength(list(hosts.values()), [mean] * len(hosts))
    host_share = {h: (sum(g) + up * mean) / (len(g) + up) for h, g in hosts.items()}
    inner = strength(list(paths.values()), [host_share[h] for h, _ in paths])
    for h, q, e, i in rows:
        g = paths[h, q]
        others = (sum(g) - share(e) + inner * host_share[h]) / (len(g) - 1 + inner)
        assert got[i]["host_share"] == pytest.approx(host_share[h])
        assert got[i]["path_share"] == pytest.approx((sum(g) + inner * host_share[h]) / (len(g) + inner))
        assert got[i]["posterior"] == pytest.approx(share(e + logit(others) - logit(mean)))


def test_sparse_sites_shrink_to_the_levels_above(spark):
    rows = [("big", "a", 5.0)] * 300 + [("big", "b", -5.0)] * 300 + [("bad", "c", -5.0)] * 400 + [("one", "d", -5.0)]
    got = {(r["source"], r["lang"]): r for r in quality.posteriors(spark.createDataFrame(rows, "source string, lang string, evidence double"), "source", "lang").distinct().collect()}
    assert got["big", "a"]["path_share"] > 0.9 and got["big", "b"]["path_share"] < 0.1 and 0.4 < got["big", "a"]["host_share"] < 0.6
    assert got["one", "d"]["host_share"] > got["bad", "c"]["host_share"]


def test_near_duplicates_send_no_table_to_the_driver(spark):
    """Tables of ids are narrow in files, so the engine takes them for small, at any number of rows."""
    rng = random.Random(17)
    text = prose(rng, 60)
    df = table(spark, [(i, text if i % 2 else prose(rng, 60)) for i in range(40)])
    found = neardup.near_duplicates(df)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["component_id"] for r in found.collect() if r["doc_id"] % 2} == {1}
