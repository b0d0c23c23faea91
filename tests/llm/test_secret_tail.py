"""A few secrets among many ordinary tokens."""

import random

import numpy as np

from kinlake.llm import secrets
from tests.llm.test_text_operators import table


def test_few_random_keys_among_many_ordinary_tokens(spark):
    rng = random.Random(31)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def slug():
        out = rng.choice(words)
        while len(out) < 48:
            out += "-" + rng.choice(words)
        return out[:47] + "e"

    rows = [(i, f"see {slug()} there and {slug()} here") for i in range(1000)]
    rows += [(5000 + i, "see " + "".join(rng.choice(letters) for _ in range(48)) + " there") for i in range(40)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.find_secrets(table(spark, rows), ["doc_id"]).collect()}
    assert sum(got[5000 + i] == [("random", 4, 52)] for i in range(40)) >= 36
    assert sum(len(got[i]) for i in range(1000)) <= 2


def test_limits_are_those_of_benjamini_and_hochberg(spark):
    """Against sorted p-values: the limit is never above the plain one, and below it by one bin at most."""
    rng = np.random.default_rng(9)
    for case in range(4):
        groups = {size: np.concatenate([rng.random(400), 10.0 ** -rng.uniform(2, 12, 5 * case + size)]) for size in range(3)}
        rows = [([{"start": 0, "end": 1, "size": int(size), "p": float(p)}],) for size, ps in groups.items() for p in ps]
        df = spark.createDataFrame(rows, "candidates array<struct<start:int,end:int,size:int,p:double>>")
        got = secrets.discovery_limits(df, 0.01)
        for size, ps in groups.items():
            ordered = np.sort(ps)
            good = np.flatnonzero(ordered <= 0.01 * np.arange(1, len(ordered) + 1) / len(ordered))
            if not len(good):
                assert size not in got
                continue
            plain = ordered[good[-1]]
            below = ordered[ordered <= plain * 2 ** (-1 / secrets._BINS)]
            assert got.get(size, 0.0) <= plain and (not len(below) or got[size] >= below[-1])


def test_long_tokens_are_tested_whole():
    """Every other character of this token is the same one, which characters spread evenly over it don't show."""
    rng = np.random.default_rng(4)
    letters = np.array(list(secrets.ENCODINGS["base64"]))
    random_ = "".join(rng.choice(letters, 4 * 4096))
    half = "".join(c + "a" for c in random_[: 2 * 4096])
    table = np.zeros((97, 97))
    for a in "etaoinshrdlu":
        for b in "etaoinshrdlu":
            table[ord(a) - 32, ord(b) - 32] = 1000
    p = secrets.Ordinary(table).p_values([random_, half])
    assert p[0] < 1e-3 and p[1] > 0.5


def test_pieces_of_a_long_token_add_up():
    rng = np.random.default_rng(5)
    for encoding, letters in enumerate(secrets.ENCODINGS.values()):
        for n in (secrets.PIECE + 1, 2 * secrets.PIECE, 3 * secrets.PIECE + 77):
            token = "".join(rng.choice(list(letters), n))
            whole = secrets.departure(secrets._codes([token], encoding), encoding)
            assert np.allclose(secrets.long_departure(token, encoding), whole, rtol=1e-9)
