"""Links of lines: exactly those of the definition at every bucket size, and most of those of edit distance."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kinlake.llm import lines
from kinlake.llm.editing import distance
from kinlake.llm.text import chunks
from tests.llm.test_text_operators import prose, table


def near(a, b, percent=90):
    most = (100 - percent) * max(len(a), len(b)) // 100
    return distance(a, b, most) <= most


def groups_of(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = defaultdict(set)
    for i in range(n):
        out[find(i)].add(i)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def found(spark, forms):
    got = defaultdict(set)
    for r in lines.find_duplicates(table(spark, list(enumerate(forms)))).collect():
        got[r["component"]].add(r["place"]["doc_id"])
    return {frozenset(g) for g in got.values()}


def changed(rng, base):
    """base with a letter, a word, or some letters changed."""
    spot, w, letters = rng.randrange(len(base)), base.split(), list(base)
    w[rng.randrange(len(w))] = "zz"
    for i in rng.sample(range(len(base)), max(1, len(base) // 25)):
        letters[i] = "y"
    return [base[:spot] + "z" + base[spot + 1 :], " ".join(w), "".join(letters)]


def test_links_are_those_of_the_definition_at_every_bucket_size(spark, monkeypatch):
    rng = random.Random(21)
    bases = [prose(rng, n) for n in (3, 7, 12, 25, 60, 90) for _ in range(4)]
    forms = sorted({x for b in bases for x in [b, *changed(rng, b)]})
    ((_, data, offsets),) = chunks(pa.array(forms))
    words = lines.Lines(data, offsets).simhashes(np.arange(len(forms)))
    keys, bits = lines.block_keys(words), words[:, -1]

    def linked(i, j):
        return bool((keys[i] == keys[j]).any()) and int(bits[i] ^ bits[j]).bit_count() <= lines.APART and int(np.bitwise_count(words[i] ^ words[j]).sum()) <= lines.APART_ALL and near(forms[i], forms[j])

    want = groups_of(len(forms), linked)
    assert len(want) >= 15
    for crowd, part in ((lines.CROWD, lines.PART), (1, 64), (3, 500)):
        monkeypatch.setattr(lines, "CROWD", crowd)
        monkeypatch.setattr(lines, "CROWD_BITS", crowd)
        monkeypatch.setattr(lines, "PART", part)
        assert found(spark, forms) == want


def test_what_is_rewritten_is_within_the_edits():
    rng = random.Random(25)
    hits = 0
    for _ in range(400):
        a = prose(rng, rng.randint(1, 12)).split()
        b = [w for w in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), prose(rng, 1))
        a, b = " ".join(a), " ".join(b)
        d = distance(a, b, 1000)
        for most in (d - 1, d, d + 3):
            assert not lines.rewritten(a, b, most) or d <= most
            hits += lines.rewritten(a, b, most)
    assert hits > 300


def test_recall_of_a_changed_word_in_long_lines(spark):
    rng = random.Random(22)
    pairs = [(b, changed(rng, b)[1]) for b in (prose(rng, 90) for _ in range(60))]
    forms = [x for p in pairs for x in p]
    assert all(near(*p) for p in pairs)
    assert len(found(spark, forms) & {frozenset((2 * i, 2 * i + 1)) for i in range(60)}) >= 54


def test_variants_of_one_line_are_one_group(spark, monkeypatch):
    rng = random.Random(23)
    base = prose(rng, 60).split()
    forms = sorted({" ".join(w if i != spot else prose(rng, 1) for i, w in enumerate(base)) for spot in range(60) for _ in range(3)})
    for crowd in (16, lines.CROWD):
        monkeypatch.setattr(lines, "CROWD", crowd)
        assert found(spark, forms) == {frozenset(range(len(forms)))}


def test_short_lines_lose_exact_repeats(spark, tmp_path):
    from kinlake.llm.queries import op6_lines

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, [(1, "All rights reserved.\n\nyes"), (2, "all  rights reserved!\n\nall rights reserved.\nYES"), (3, "")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_removed"] for r in op6_lines(spark, str(tmp_path)).collect()} == {1: 0, 2: 3, 3: 0}
    assert {r["doc_id"]: r["text"] for r in pipeline.without_repeated_lines(spark, docs, "").collect()}[2] == ""


def test_rows_that_share_a_doc_id(spark):
    rng = random.Random(24)
    a, b = prose(rng, 20), prose(rng, 20)
    rows = [(1, f"{a}\n{b}"), (1, f"{b}\n{a}"), (1, f"{a}\n{b}"), (2, a)]
    got = lines.deduplicate(table(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) in ([(1, 0), (1, 0), (1, 2), (2, 1)], [(1, 0), (1, 2), (1, 2), (2, 1)])
    assert sum(len(r["text"].split()) for r in got if r["n_removed"] == 0 and r["doc_id"] == 1) in (40, 80)


def test_forms_are_read_again_at_their_spots_only(spark):
    rng = random.Random(5)
    texts = ["\n".join([prose(rng, 12) for _ in range(40)] + ["", "  The one\tthat is wanted, 7 times  "] + [prose(rng, 5)]) for _ in range(30)]
    docs = table(spark, list(enumerate(texts))).selectExpr("doc_id", "xxhash64(text) as text_id", "text").cache()
    rows = lines.line_table(docs, 90).cache()
    wanted = rows.where("doc_id % 10 = 3 and line_no in (0, 41)").select("line_id", "text_id", "line_no", "doc_id").toPandas()
    spots = lines.spots(wanted["text_id"].to_numpy(), wanted["line_no"].to_numpy())
    got = lines.forms_of(docs, spark.createDataFrame([(int(x),) for x in spots], "id long")).toPandas().set_index("id")["form"].to_dict()
    assert set(wanted["line_id"]) <= set(got) and len(got) < 20  # of some 1,200 forms
    assert {got[i] for i in wanted.loc[wanted["line_no"] == 41, "line_id"]} == {"the one that is wanted 0 times"}
    found = lines.hashes_of(rows, spark.createDataFrame([(int(x),) for x in wanted["line_id"]], "id long"), spot=True).toPandas()
    again = lines.forms_of(docs, found[["spot"]].pipe(lambda f: spark.createDataFrame([(int(x),) for x in f["spot"]], "id long"))).toPandas()
    assert set(wanted["line_id"]) <= set(again["id"])


def test_entries_alone_in_their_key_are_left_out():
    rng = np.random.default_rng(3)
    found = np.zeros(5000, lines._ENTRY)
    found["key"], found["id"] = rng.choice(1 << 32, 5000, replace=False), np.arange(5000)
    found["key"][1::50] = found["key"][::50]
    blobs = [found[i : i + 700].tobytes() for i in range(0, 5000, 700)]
    got = lines._not_alone(pa.chunked_array([pa.array(blobs[:3], pa.binary()), pa.array(blobs, pa.binary())[3:]]))
    assert {*range(0, 5000, 50), *range(1, 5000, 50)} <= set(got["id"].tolist()) and len(got) < 2500
    assert len(lines._not_alone(pa.chunked_array([pa.array([found[:1].tobytes()], pa.binary())]))) == 0
