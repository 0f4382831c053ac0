import random
import time

import numpy as np
import pyarrow as pa

from quarrykit.operators import similar


def test_pairs_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "WHOLE", 8)  # so that most sets go by their rarest grams and are settled afterwards
    monkeypatch.setattr(similar, "CELLS", 64)
    r = random.Random(5)
    texts = [" ".join(r.choice(["the", "and", "ing", "tion", "ß", "er"]) for _ in range(r.randint(1, 60))) for _ in range(150)]
    texts += [t[5:] for t in texts[:60]] + texts[:10] + ["", "", "a", "ab", None, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(x["a"], x["b"]): x["similarity"] for x in similar.similar_pairs(df, "id", "t", 0.85).collect()}
    sets: dict = {}
    for i, t in enumerate(texts):
        t = None if t is None else t.strip(" ")
        sets.setdefault(None if t is None else frozenset({t[k : k + 4] for k in range(len(t) - 3)} or {t}), []).append(i)
    want = {(ids[0], i): 1.0 for ids in sets.values() for i in ids[1:]}
    known = [(s, ids[0]) for s, ids in sets.items() if s is not None]
    for s, a in known:
        for z, b in known:
            if a < b and len(s & z) / min(len(s), len(z)) > 0.85:
                want[a, b] = round(len(s & z) / min(len(s), len(z)), 6)
    assert got == want and len(want) > 80


def test_bits_are_counted():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 6, 41):
        bits = r.integers(0, 2, (n, 3, 128), np.uint8)
        planes = similar._bit_counts(np.packbits(bits, axis=-1, bitorder="little").view("<u8").astype(np.uint64))
        need = np.array([n // 2, 1, n + 1])
        got = np.unpackbits(similar._reached(planes, need).astype("<u8").view(np.uint8), axis=-1, bitorder="little")
        assert (got == (bits.sum(0, dtype=np.int64) >= need[:, None])).all()


def test_common_grams_of_a_tile_are_counted_for_many_sets_at_once():
    r = np.random.default_rng(3)
    grams = [np.sort(r.choice(200, 60, False)).astype(np.uint64) for _ in range(8192)]
    schema = pa.schema([("a", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("g", pa.binary())])
    batch = lambda some: pa.RecordBatch.from_pylist([{"a": i, "h": i, "n": 60, "g": grams[i].tobytes()} for i in some], schema)
    index = similar._Postings([batch(range(8192))], schema)
    began = time.process_time()
    found = [x for part in index.matches(batch(range(1500)), 0.5, ["x", "y", "hx", "hy", "nx", "ny", "common"]) for x in part.to_pylist()]
    assert time.process_time() - began < 1  # 0.1 seconds; by lists of numbers it took 2.6
    held = np.zeros((8192, 200), np.float32)
    for i, g in enumerate(grams):
        held[i, g.astype(int)] = 1
    both = held[:1500] @ held.T
    want = {(x, y): both[x, y] for x, y in np.argwhere(both >= 30).tolist() if y > x}
    assert {(f["x"], f["y"]): f["common"] for f in found} == want


def test_sets_that_share_a_least_key_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(similar, "WHOLE", 8)
    long = "the quick brown fox jumps over the lazy dog and runs away from all the hounds of the village"
    df = spark.createDataFrame([(1, long), (1, long + " at"), (2, long + " at night"), (3, "quite another text")], "id long, t string")
    got = sorted((x["a"], x["b"], x["similarity"]) for x in similar.similar_pairs(df, "id", "t", 0.85).collect())
    assert got == [(1, 2, 1.0), (1, 2, 1.0)]
