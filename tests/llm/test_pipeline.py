"""The corpus pipeline: each stage against a plain version, on rows of every kind, and the whole of it."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinlake.llm import quality
from kinlake.llm.editing import distance
from tests.llm.test_text_operators import prose

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed string, `group` string, component_id long, posterior double"
ITEM = "Which of the following words is the name of a colour that is often seen in the sky at noon?"


def rows():
    """Good and bad texts, copies, near copies, shared lines, a benchmark passage, nulls, empty and long texts, ties and repeats."""
    rng = random.Random(3)
    out = []
    for i in range(40):
        text = prose(rng, 80) if i % 4 else " ".join(w + "###" for w in prose(rng, 80).split())
        out.append([i, text])
    base = prose(rng, 200)
    words = base.split()
    words[100] = "changed"
    line = prose(rng, 30)
    out += [[50, base], [51, base], [52, " ".join(words)], [53, f"{prose(rng, 60)}\n{line}"], [54, f"{line}\n{prose(rng, 60)}"], [55, f"{prose(rng, 40)} {ITEM.upper()} {prose(rng, 40)}"]]
    out += [[60, None], [61, ""], [62, " \n\t"], [63, "short"], [64, "short"], [65, prose(rng, 20_000)], [66, "é ü ß"], [None, prose(rng, 50)], [50, base], [67, prose(rng, 50)], [67, prose(rng, 50)]]
    return out


def frame(spark, found):
    return spark.createDataFrame([(i, t, "en", "s" if i is None or i % 2 else None, len(t or ""), "x", "y", 7, 0.5) for i, t in found], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables of a small corpus, and an empty one."""
    at = tmp_path_factory.mktemp("pipeline")
    for name, found in (("full", rows()), ("empty", [])):
        frame(spark, found).write.parquet(f"{at}/{name}/documents.parquet")
        spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(40)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/{name}/labels.parquet")
        spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/{name}/benchmark.parquet")
    return str(at)


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def docs_of(spark, found):
    return frame(spark, found)


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stage_on_an_empty_table(spark, folder, stage):
    docs = docs_of(spark, [])
    out = stage(spark, docs, f"{folder}/empty")
    assert out.count() == 0 and (stage is pipeline.tokens or out.schema == docs.schema)


def test_quality_stage(spark, folder):
    docs = docs_of(spark, rows())
    out = pipeline.good_quality(spark, docs, f"{folder}/full")
    assert out.columns == docs.columns
    labels = spark.read.parquet(f"{folder}/full/labels.parquet")
    judged = quality.score(docs, labels, keys=("doc_id", "text")).collect()
    assert texts(out) == Counter((r["doc_id"], r["text"]) for r in judged if r["posterior"] >= 0.5)
    ids = {r[0] for r in texts(out)}
    assert {i for i in range(40) if i % 4} <= ids and not {i for i in range(40) if i % 4 == 0} & ids and None in ids and 65 in ids


def form(line):
    return re.sub(r"[^a-z0\x80-\U0010ffff]+", " ", re.sub("[0-9]", "0", "".join(c.lower() if c.isascii() else c for c in line))).strip(" ")


def test_line_stage(spark, folder):
    found = [r for r in rows() if r[0] not in (50, 67)] + [[50, rows()[40][1]]]
    out = pipeline.without_repeated_lines(spark, docs_of(spark, found), "")
    got = {r["doc_id"]: r for r in out.collect()}
    at = sorted((i, n, form(x)) for i, t in found if i is not None and t is not None for n, x in enumerate(t.split("\n")))
    root = {x: x for *_, x in at if x}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    forms = list(root)
    for k, a in enumerate(forms):
        for b in forms[:k]:
            most = max(len(a), len(b)) // 10
            if abs(len(a) - len(b)) <= most and distance(a, b, most) <= most:
                root[find(a)] = find(b)
    seen, want = set(), defaultdict(list)
    for i, n, x in at:
        if not x or find(x) not in seen:
            want[i].append(n)
        if x:
            seen.add(find(x))
    for i, t in found:
        lines = None if t is None else t.split("\n")
        expected = t if i is None or t is None else "\n".join(lines[n] for n in want[i])
        assert got[i]["text"] == expected and got[i]["removed"] == "x"
        assert got[i]["n_chars"] == (len(expected) if expected is not None else 0) or got[i]["text"] == t


def test_near_stage(spark, folder):
    found = rows()
    out = pipeline.without_near_duplicates(spark, docs_of(spark, found), "")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    sets = [(i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())) for i, t in found if i is not None for w in [words(t)]]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert texts(out) == Counter((i, t) for i, t in found if i is None or find(i) == i)
    assert {51, 52, 64} & {r[0] for r in texts(out)} == set()


def test_benchmark_stage(spark, folder):
    found = rows()
    out = pipeline.without_benchmark(spark, docs_of(spark, found), f"{folder}/full")
    assert texts(out) == Counter((i, t) for i, t in found if i != 55) and out.columns == docs_of(spark, []).columns


def test_token_stage(spark, folder):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = rows()
    got = pipeline.tokens(spark, docs_of(spark, found), "").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((i, tuple(ids), len(ids), sha(",".join(map(str, ids))), sha(x or "")) for i, x in found for ids in [t.encode(x or "", add_special_tokens=False).ids])
    assert Counter((r["doc_id"], tuple(r["token_ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_run_is_its_stages_one_after_another(spark, folder):
    docs = docs_of(spark, rows())
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, f"{folder}/full")
        assert after.schema == docs.schema
        docs = spark.createDataFrame(after.collect(), docs.schema)
    want = pipeline.STAGES[-1][1](spark, docs, "")
    key = lambda df: Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect())
    got = pipeline.run(spark, f"{folder}/full")
    assert key(got) == key(want) and got.columns == want.columns
    assert pipeline.run(spark, f"{folder}/empty").count() == 0
    assert not set(got.where(F.col("doc_id").isin(0, 4, 55)).toPandas()["doc_id"])
