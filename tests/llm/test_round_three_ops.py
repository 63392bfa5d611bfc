"""Word windows, whitening and hard negatives against brute force."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridmoments.llm import mining, whitening, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed_by_brute_force(docs, n):
    first, out = {}, []
    for i, text in docs:
        w = WORD.findall(text or "")
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    for i, text in docs:
        w = WORD.findall(text or "")
        gone = {k + j for k in range(len(w) - n + 1) for j in range(n) if i is not None and first[tuple(w[k : k + n])] < i}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    docs = []
    for i in range(n):
        words = []
        while len(words) < rng.choice((0, 5, 30, 200)):
            words += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        docs.append((i * 3, rng.choice((" ", "\n", " \t ")).join(words)))
    return docs


def plain_rows(df):
    return sorted(((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [3, 13])
def test_windows_against_brute_force(spark, n, monkeypatch):
    docs = corpus(n)
    docs += [(1000, None), (1001, ""), (1002, " \n "), (docs[5][0], docs[7][1]), docs[9], (None, docs[9][1]), (None, "a b"), (-7, docs[11][1]), (1003, "x " * 50), (1004, "x y " * 40)]
    monkeypatch.setattr(windows, "CHUNK", 6000)
    monkeypatch.setattr(windows, "SHARD", 20_000)
    monkeypatch.setattr(windows.C, "CHUNK_BYTES", 700)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, id string, chunk long").repartition(5)
    found = windows.earlier_windows(df, n)
    assert plain_rows(found) == removed_by_brute_force(docs, n)
    for r in found.collect():
        assert sum(s["b"] - s["a"] for s in r["spans"]) == r["n_removed"] and all(x["b"] < y["a"] for x, y in zip(r["spans"], r["spans"][1:]))


def test_windows_of_one_long_text_and_of_copies(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(200_000)) + " " + "y" * 700_000
    docs = [(k, "one two three four " * 10) for k in range(300)] + [(500, long), (400, long[3000:9000]), (2, long[-5000:])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert plain_rows(windows.earlier_windows(df)) == removed_by_brute_force(docs, 13)
    got = {r["doc_id"]: r for r in windows.digest_rows(df.where("doc_id < 400 and doc_id > 3")).collect()}
    assert got[5]["n_removed"] == 40 and got[5]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["n_removed"] == 0
    assert windows.digest_rows(df.where("false")).count() == 0


def test_files_of_chunks_are_small_and_shards_are_grouped_in_parts(spark, monkeypatch):
    docs = corpus(5) + [(1000 + k, "a b c d " * 30) for k in range(60)]
    docs += [(-1 - i, t) for i, t in docs]
    monkeypatch.setattr(windows, "CHUNK", 2000)
    monkeypatch.setattr(windows, "PART", 50, raising=False)
    paths, write = [], windows.C.Scratch.write
    monkeypatch.setattr(windows.C.Scratch, "write", lambda self, df, name, **options: paths.append(self.path(name)) or write(self, df, name, **options))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert plain_rows(windows.earlier_windows(df)) == removed_by_brute_force(docs, 13)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in Path(next(p for p in paths if p.endswith("/chunks")).removeprefix("file:")).glob("*.parquet")]
    assert sum(sizes) > 24 and max(sizes) <= 8


def test_sketch_never_counts_less():
    rng = np.random.default_rng(1)
    truth, sketch = np.zeros(4096, int), windows.Sketch(4096)
    for _ in range(40):
        cells = np.unique(rng.integers(0, 4096, 60))
        many = (rng.random(len(cells)) < 0.1).astype(np.int64)
        again = windows.Sketch.unpacked(windows.Sketch.packed(cells, many).tobytes())
        assert (again[0] == cells).all() and (again[1] == many).all()
        sketch.add(*again)
        truth[cells] += 1 + many
    assert (sketch.repeated(np.arange(4096)) == (truth > 1)).all()
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, (1 << 64) - 1], np.uint64)
    assert (windows.from_varints(windows.varints(values)[0].tobytes()) == values).all()


FORM = "vec_id long, embedding array<float>, label int, id string, row long, x string"


def vectors(n=400, width=12, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, width)) * np.linspace(3, 0.1, width) @ rng.standard_normal((width, width)) * 0.2).astype(np.float32)
    x[40:80] = x[40]
    rows = [(int(i) if i != 100 else 50, [float(c) for c in x[i]], int(rng.integers(0, 4)) if i % 3 else 1) for i in range(n)]
    return rows + [(n, None, 1), (n + 1, [float("nan")] * width, 1), (n + 2, [1.0, None] + [0.0] * (width - 2), 1), (n + 3, [0.0] * width, 1), (n + 4, [float("-inf")] * width, 2), (n + 5, rows[50][1], None), (n + 6, [], 1), (n + 7, rows[50][1][:3], 1), (None, rows[3][1], 2)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 0, "y") for i, v, l in rows], FORM).repartition(3)


def numbers(rows, scale, width):
    return [(i, np.pad(np.floor(scale * np.array(v, np.float64)), (0, width - len(v))).astype(np.int64), l) for i, v, l in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def test_whitening_against_eigenvectors(spark):
    rows = vectors()
    have = numbers(rows, 256, 12)
    fit = np.unique(np.stack([x for _, x, _ in have]), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    got = {}
    for r in whitening.whiten(table(spark, rows)).collect():
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-9
        got.setdefault(r["id"], []).append((r["component"], r["whitened"], r["deviation"]))
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(12)])
    want = {}
    for i, x, _ in have:
        z = (x - s / n) @ (axes[:, :4] * signs[:4]) / np.sqrt(e[:4])
        want.setdefault(i, []).extend((k + 1, z[k], int(((n * x - s) ** 2).sum())) for k in range(4))
    assert set(got) == set(want) and None in got
    for i in want:
        for x, y in zip(sorted(got[i]), sorted(want[i])):
            assert x[0] == y[0] and x[2] == y[2] and abs(x[1] - y[1]) < 1e-7


def test_whitening_of_little_and_nothing(spark):
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect()
    assert len(one) == 4 and all(r["n"] == 1 and r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in one)
    line = whitening.whiten(table(spark, [(k, [float(k), 2.0 * k, 0.0], 1) for k in range(5)])).collect()
    assert len(line) == 15 and all((r["whitened"] is None) == (r["component"] > 1) for r in line) and all(r["identity_error"] < 1e-12 for r in line)
    large = whitening.whiten(table(spark, [(1, [1e30, 0.0], 1), (2, [-1e30, 1.0], 1)])).collect()
    assert {r["deviation"] for r in large} == {(1 << 63) - 1}


def test_rotations_keep_small_components():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((9, 9)))
    lengths = 10.0 ** -np.arange(9)
    found, v = whitening.rotated(np.diag(lengths) @ q.T)
    assert np.allclose(found, lengths, rtol=1e-10) and np.allclose(np.abs((v * q).sum(0)), 1)


def test_triangles_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STACK_BYTES", 1)
    rows = vectors(seed=4)
    df = table(spark, rows).repartition(9)
    a = {(r["id"], r["component"], round(r["whitened"], 6)) for r in whitening.whiten(df).collect()}
    monkeypatch.undo()
    assert a == {(r["id"], r["component"], round(r["whitened"], 6)) for r in whitening.whiten(table(spark, rows)).collect()}


def mined(rows, width, every, positives, negatives):
    have = [(n, i, x, l) for n, (i, x, l) in enumerate(numbers(rows, 256, width)) if l is not None and i is not None]
    out = []
    for n, i, x, l in have:
        if i % every:
            continue
        scores = [(-int(x @ y), j, m, k) for m, j, y, k in have if m != n]
        for p, j, _, k in sorted(s for s in scores if s[3] == l)[:positives]:
            fits = sorted(s for s in scores if s[3] != l and -50 * p <= -100 * s[0] <= -95 * p)[:negatives]
            out += [(i, j, r, s[1], -p, -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, block, group, scale", [(0, 4096, 512, 1.0), (1, 37, 5, 1.0), (2, 64, 3, 3e4)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, seed, block, group, scale):
    monkeypatch.setattr(mining, "BLOCK", block)
    monkeypatch.setattr(mining, "GROUP", group)
    rows = [(i, v and [c and c * scale for c in v], l) for i, v, l in vectors(seed=seed)]
    rows = [(i, v and [c and float(np.float32(c)) for c in v], l) for i, v, l in rows]
    want = mined(rows, 12, 10, 5, 3)
    got = sorted(tuple(r) for r in mining.hard_negatives(table(spark, rows), every=10).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert len(want) > 200 and got == want


def test_hard_negatives_of_nothing_and_extremes(spark):
    assert mining.hard_negatives(table(spark, [])).count() == 0 and mining.hard_negatives(table(spark, [(50, None, 1), (100, [1.0], None)])).count() == 0
    assert mining.hard_negatives(table(spark, [(50, [1.0, 0.0], 1), (7, [0.5, 0.0], 2)])).count() == 0  # no positive
    far = table(spark, [(50, [1e30, 0.0], 1), (1, [1e30, 0.0], 1), (2, [6e5, 0.0], 2), (3, [-1e30, 0.0], 2)])
    got = mining.hard_negatives(far).collect()
    assert all(r["positive_score"] > 0 for r in got)


def test_intervals_drop_pairs_before_the_last_plane():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.standard_normal((600, 64)) / 8).astype(np.int64)
    planes = int(np.where(x < 0, -x - 1, x).max()).bit_length() + 1
    a = x[:20]
    best = mining.Best(np.full((20, 1), -(1 << 62)), np.full((20, 1), 1 << 62), 3)
    allowed = np.arange(600) != np.arange(20)[:, None]
    mining.search(a, best, (np.arange(600), np.arange(600), mining.sliced(x, planes)), allowed, planes)
    scores = np.where(allowed, a @ x.T, -(1 << 60))
    for n in range(20):
        assert best.found[2][best.found[0] == n].tolist() == np.lexsort((np.arange(600), -scores[n]))[:3].tolist()
    assert best.dropped[1] > 0.9 * best.dropped[0]
