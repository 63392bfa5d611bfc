"""Vector search, neighbour graph, components and archives against brute force."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from gridmoments.llm import common, descent, topk, warc

FORM = "vec_id long, embedding array<float>, label int, id string, component long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 0) for i, v, l in rows], FORM).repartition(3)


def vectors(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    x[50:110] = x[50] + 0.01 * rng.standard_normal((60, 16))
    x[120:124] = x[120]
    rows = [(int(i), [float(c) for c in x[i]], int(i % 3) if i < 50 or i > 130 else 1) for i in range(n)]
    return rows + [
        (n, None, 1), (n + 1, [float("nan")] * 16, 1), (n + 2, [1.0, None] + [0.0] * 14, 1), (n + 3, [0.0] * 16, 1), (n + 4, [float("inf")] * 16, 2), (n + 5, rows[50][1], None), (n + 6, [], 1), (n + 7, rows[50][1][:3], 1),
    ]


def usable(rows):
    return {i: np.pad(np.array(v, np.float64), (0, 16 - len(v))) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)}


def test_top_k_against_brute_force(spark):
    rows = vectors()
    have = {i: np.floor(1024 * v).astype(np.int64) for i, v in usable(rows).items()}
    got = {}
    for r in topk.top_k(table(spark, rows), k=10, every=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in have if i % 10 == 0}
    for q, found in got.items():
        want = sorted(((-int(have[q] @ v), i) for i, v in have.items() if i != q))[:10]
        assert sorted(found) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]


def test_top_k_of_few_ties_and_nothing(spark):
    few = table(spark, [(100, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (200, None, 1)])
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(few).collect()) == [(100, 1, 3, 1 << 20), (100, 2, 7, 1 << 20)]
    assert topk.top_k(few.where("false")).count() == 0 and topk.top_k(few.where("vec_id = 7")).count() == 0
    large = table(spark, [(0, [1e30, -1e30], 1), (1, [1e30, 0.0], 1), (2, [-1e30, 0.0], 1)])
    assert [r["vec_id"] for r in topk.top_k(large).orderBy("rank").collect()] == [1, 2]


def test_top_k_skips_annuli_and_takes_repeated_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = 20 * rng.standard_normal((12, 600))
    rows = [(i % 1900, [float(c) for c in centres[i % 12] + 0.1 * rng.standard_normal(600)]) for i in range(2000)]
    have = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    monkeypatch.setattr(topk, "PASS_BYTES", 40_000)
    search = topk.TopK(df, 5, 100, 1024)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search.result().collect())
    want = []
    matrix = np.stack([v for _, v in have])
    for n, (q, v) in enumerate(have):
        if q % 100 == 0:
            near = sorted((-int(s), i) for m, (s, (i, _)) in enumerate(zip(matrix @ v, have)) if m != n)[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(near, 1)]
    assert got == sorted(want)
    assert 0 < search.met < 0.5 * search.pairs


@pytest.mark.parametrize("size", [1 << 10, 1 << 24, 1 << 30, 1 << 40])
def test_scores_are_exact_at_any_size(size):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-size, size, (4, 900)) for _ in range(2))
    want = [[max(min(sum(int(x) * int(y) for x, y in zip(p, q)), (1 << 63) - 1), topk.LOW + 1) for q in b] for p in a]
    assert topk._scores(a.astype(np.float64), b.astype(np.float64)).tolist() == want


def test_near_duplicates_against_brute_force(spark):
    rows = vectors()
    have, label = usable(rows), {i: l for i, _, l in rows}
    root, links = {i: i for i, _, _ in rows}, dict.fromkeys((i for i, _, _ in rows), 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in have:
        for b in have:
            if a < b and label[a] is not None and label[a] == label[b] and (n := np.linalg.norm(have[a]) * np.linalg.norm(have[b])) > 0 and have[a] @ have[b] / n >= 0.98:
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in descent.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: (links[i], find(i), find(i) == i) for i in links}
    assert max(links.values()) > 40
    assert descent.near_duplicates(table(spark, rows).where("false")).count() == 0


def circle(angles):
    """Vectors at angles on a circle, each with a slight share of its own in another direction."""
    return [[float(np.cos(a)), float(np.sin(a)), *(0.004 * (k == i % 14) for k in range(14))] for i, a in enumerate(angles)]


def test_near_duplicates_link_two_dense_groups(spark):
    rows = [(i, v, 1) for i, v in enumerate(circle([0.0005 * i for i in range(30)] + [0.19 + 0.0005 * i for i in range(30)]))]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = (x @ x.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    assert hit[:30, :30].sum() == 30 * 29 and 0 < hit[:30, 30:].sum() < 900
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in descent.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: (int(hit[i].sum()), 0, i == 0) for i in range(60)}


def test_near_duplicates_where_no_audit_passes(spark, monkeypatch):
    """The descent is crippled, so that the exact tiles of all blocks must count the links."""
    for name, value in (("ROUNDS", 1), ("MOST_ROUNDS", 2), ("LIST", 1), ("BLOCK", 4), ("BLOCK_BYTES", 1)):
        monkeypatch.setattr(descent, name, value)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x[200:] = x[:200] + 0.02 * rng.standard_normal((200, 16))
    rows = [(int(k), [float(c) for c in x[k]], 1) for k in range(400)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in descent.near_duplicates(table(spark, rows)).collect()}
    assert got == {k: (1, k % 200) for k in range(400)}


def test_near_duplicates_of_repeated_rows(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (3, [1.0, 0.01], 1), (9, [0.0, 1.0], 2), (None, [1.0, 0.0], 1)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in descent.near_duplicates(table(spark, rows)).collect())
    assert got == [(3, 2, 3, True), (5, 0, 5, True), (5, 2, 3, False), (5, 2, 3, False), (9, 0, 9, True)]


def test_audit_counts_links_between_components(spark):
    d = descent.Descent(spark.createDataFrame([(i, "a", [1.0, 0.001 * i]) for i in range(20)], "id long, label string, v array<double>"), 0.98)
    alone = d.blocks(None)
    assert d.audit(alone) == 0.0
    state, blocks, passed = d.search()
    assert passed and d.recall == 1.0 and blocks.count() >= 1


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    root = {v: v for e in edges for v in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    scratch = common.Scratch(spark, "test")
    got = {r["id"]: r["component"] for r in common.components(spark, spark.createDataFrame(edges, "a long, b long").repartition(6), scratch, "c").collect()}
    assert got == {i: find(i) for i in root if any(i in e and e[0] != e[1] for e in edges)}


def test_archives_round_trip(spark, tmp_path):
    big, other = "ä" * 700, "b" * 1500
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nEvil: 1", big), (3, None, None), (4, "http://a/4", other), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (9, "u", big), (None, "u", big)]
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, size string, sha string").repartition(2)
    got = {r["page_id"]: r for r in warc.archive_pages(df, folder=f"file://{tmp_path}").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 9}
    for i, _, h in rows:
        if i is not None:
            raw = (h or "").encode()
            assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {1: ("revisit", 9), 2: ("revisit", 9)}
    assert got[2]["target_uri"] == "http://a/2 Evil: 1" and got[3]["target_uri"] is None
    files = sorted((tmp_path / "records").glob("*.warc.gz"))
    assert files and sorted((tmp_path / "monolithic").glob("*.warc.gz"))
    for f in files:
        data, index = f.read_bytes(), (f.parent / (f.name + ".idx")).read_text().splitlines()[1:]
        end = 0
        for line in index:
            offset, length = map(int, line.split("\t")[3:])
            assert offset == end
            z = zlib.decompressobj(31)
            record = z.decompress(data[offset : offset + length])
            assert z.eof and not z.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            end = offset + length
        assert end == len(data)
    assert warc.archive_pages(df.where("false")).count() == 0


def test_archives_of_repeated_pages(spark):
    x, y = "x" * 1200, "y" * 1300
    df = spark.createDataFrame([(1, "u", x), (1, "u", x), (9, "u", x), (9, "u", x), (9, "u", y), (4, "u", y), (4, "u", "s"), (4, "u", "s")], "page_id long, url string, html string").repartition(3)
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(df).collect())
    assert got == [(1, 1200, "revisit", 9), (1, 1200, "revisit", 9), (4, 1, "response", None), (4, 1, "response", None), (4, 1300, "revisit", 9), (9, 1200, "response", None), (9, 1200, "response", None), (9, 1300, "response", None)]


def test_streams_of_one_and_of_many_members():
    one = warc.record("response", 1, "u", b"x" * 100, hashlib.sha1(b"x" * 100).digest(), 100, None)
    two = warc.record("revisit", 2, "u", b"y" * 9, hashlib.sha1(b"y" * 9).digest(), 9, 1)
    for data in (warc.member(one + two), warc.member(one) + warc.member(two)):
        found = list(warc.records(io.BufferedReader(warc.Inflated(io.BytesIO(data)))))
        assert [f["x-page-id"] for f, _, _ in found] == ["1", "2"] and [b for _, b, _ in found] == [b"x" * 100, b""]
        assert b"".join(w for _, _, w in found) == one + two
        assert base64.b32decode(found[1][0]["warc-payload-digest"][5:]) == hashlib.sha1(b"y" * 9).digest()
    with pytest.raises(ValueError):
        list(warc.records(io.BufferedReader(io.BytesIO(one[:-60]))))


def test_audit_meets_rare_links(spark, monkeypatch):
    """Five links among many vectors, which no early probe has: an audit of components of one vector each finds them all missing."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((900, 24))
    for k in range(5):
        x[700 + k] = x[100 + 7 * k] * (1 + k)
    rows = [(int(i), [float(c) for c in v], 1) for i, v in enumerate(x)]
    for k in range(5):
        rows[700 + k][1][0] += 1e-3
    monkeypatch.setattr(descent, "PROBES", 150)
    monkeypatch.setattr(descent, "PROBE_BYTES", 1)
    d = descent.Descent(spark.createDataFrame(rows, "id long, v array<double>, label string"), 0.98)
    alone = d.reps.selectExpr("row", "row as component", "false as full")
    assert d.audit(d.blocks(alone)) == 0.0
    found = descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert sorted(r["vec_id"] for r in found.where("n_links = 1").collect()) == sorted([700 + k for k in range(5)] + [100 + 7 * k for k in range(5)])
