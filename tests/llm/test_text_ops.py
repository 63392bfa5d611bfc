"""Operators on documents against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmoments.llm import common, jaccard, licenses, packing, pieces, quality, suffix, toxicity

FORM = "doc_id long, text string, id string, component long, score double"
P = pytest.importorskip("public_tokenizers")


def documents(spark, texts):
    """Rows with extra columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in texts], FORM).repartition(3)


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ré", "SU") for b in ("ta", "ne", "bo", "", "x")]
    base = [[rnd.choice(words) for _ in range(rnd.randint(0, 120))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(words)
        out.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "a b c d"), (n + 6, "x" * 5000), (n + 7, "Ab " * 900), (n + 8, "\0" * 300)]


def sets(texts, k=4):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def linked(s, percent):
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(s), 2):
        both = len(s[a] & s[b])
        if s[a] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in s}


def test_jaccard_against_brute_force(spark):
    texts = corpus()
    s = sets(texts)
    want = linked(s, 85)
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(documents(spark, texts)).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s[i]), want[i]) for i in s}
    assert len(set(want.values())) < len(want) - 5


@pytest.mark.parametrize("first", [1, 8])
def test_jaccard_of_near_copies_of_one_text(spark, monkeypatch, first):
    """Links of chains of copies survive one round of hubs and tiles where a pair meets at its first common token."""
    monkeypatch.setattr(jaccard, "HUBS", 1)
    monkeypatch.setattr(jaccard, "FIRST", first)
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(150)]
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(30)}"
        texts.append((i, " ".join(w)))
    for i in range(90, 120):  # each step lies farther from the base than the one before
        w = texts[-1][1].split() if i > 90 else list(base)
        w[rnd.randrange(len(w))] = f"z{i}"
        texts.append((i, " ".join(w)))
    s = sets(texts, 5)
    want = linked(s, 80)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(documents(spark, texts), words=5, percent=80).collect()}
    assert got == want and 1 < len(set(want.values())) < 100


@pytest.mark.parametrize("bits", [6, 9, 14])
def test_census_at_any_number_of_buckets(spark, monkeypatch, bits):
    """The same result, and what a bucket returns grows with the shingles alone."""
    monkeypatch.setattr(jaccard, "census_bits", lambda size: bits)
    texts = corpus(3)
    s = sets(texts)
    scratch = common.Scratch(spark, "census")
    docs = documents(spark, texts).select(F.col("doc_id").alias("id"), "text")
    kept = {}
    write = scratch.write
    monkeypatch.setattr(scratch, "write", lambda df, name: kept.setdefault(name, write(df, name)))
    told = {r["id"]: r for r in jaccard.census(spark, docs, scratch, 4, 85).collect()}
    assert {i: r["n"] for i, r in told.items()} == {i: len(v) for i, v in s.items()}
    for a, b in combinations(s, 2):
        both = len(s[a] & s[b])
        if s[a] and 100 * both >= 85 * (len(s[a]) + len(s[b]) - both):
            assert told[a]["near"] and told[b]["near"]
    sent = kept["census"].where("bucket >= 0").selectExpr("sum(octet_length(value)) v", "sum(octet_length(owner)) o").first()
    assert sent["v"] == sent["o"] <= 4 * sum(map(len, s.values()))


def test_census_by_its_own_formulas():
    """From 0.5 GB to 100 TB: shingles in a bucket, and rows of a chunk and bucket for each shingle."""
    for size in (5e8, 3e10, 1e12, 1e14):
        bits = jaccard.census_bits(int(size))
        bucket = size / 18 / 2**bits
        assert bucket <= 1 << 22
        of_row = jaccard.chunk_bytes(bits) / 18 * jaccard.CENSUS / 256 / 2**bits
        assert of_row >= (60 if size <= 1e12 else 1)


def test_jaccard_of_repeated_rows_and_of_nothing(spark):
    df = documents(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A b c d e")])
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert jaccard.jaccard_components(df.where("false")).count() == 0


def brute_removal(texts, length):
    raw = {i: (t or "").encode() for i, t in texts}
    seen = Counter(b[a : a + length] for b in raw.values() for a in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = [False] * len(b)
        for a in range(len(b) - length + 1):
            if seen[b[a : a + length]] > 1:
                gone[a : a + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("heavy", [2048, 1])
def test_suffix_removal_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffix, "HEAVY", heavy)
    texts = corpus(1, 40)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.digest_rows(documents(spark, texts), 200).collect()}
    assert got == brute_removal(texts, 200)
    assert suffix.digest_rows(documents(spark, texts).where("false")).count() == 0


def test_suffix_removal_of_repeated_ids(spark):
    rnd = random.Random(12)
    a, b = ("".join(rnd.choice("abcdefgh ") for _ in range(900)) for _ in range(2))
    rows = [(1, a), (1, b), (2, "z" + a[300:650]), (3, b), (3, b)]
    got = sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffix.digest_rows(documents(spark, rows)).collect())
    assert got == [(1, 350, 1), (1, 900, 1), (2, 350, 1), (3, 900, 1), (3, 900, 1)]


def test_suffix_order_is_right():
    rnd = random.Random(2)
    for _ in range(40):
        contexts = [bytes(rnd.choice(b"aab\0c") for _ in range(rnd.randint(1, 12) + 15)) for _ in range(15)]
        contexts += [c[:2] + b"z" + c[3:] for c in contexts[:5]]
        starts = np.array([len(c) - 15 for c in contexts])
        copies = np.array([rnd.choice([1, 1, 1, 2]) for _ in contexts])
        count = Counter()
        for c, m, n in zip(contexts, starts, copies):
            for a in range(m):
                count[c[a : a + 16]] += int(n)
        want = [count[c[a : a + 16]] > 1 for c, m in zip(contexts, starts) for a in range(m)]
        assert suffix.repeated(contexts, starts, copies, 16).tolist() == want


def test_long_texts_are_cut_into_overlapping_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 700)
    rnd = random.Random(3)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(6000))
    texts = [(1, a), (2, "y" * 10 + a[2500:2900] + "w"), (3, a[:199])]
    batch = pa.record_batch([pa.array([a.encode()], pa.binary())], ["text"])
    starts = sorted(s - at[t] + base[t] for raw, at, _, base in suffix.parts(batch, "text", 200) for h, t, s, n in [suffix.anchored(raw, at, 40, 200)] for s, t, n in [(x, y, z) for x, y, z in zip(s, t, n)] for s in range(s, s + n))
    assert starts == list(range(len(a) - 199))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.digest_rows(documents(spark, texts)).collect()}
    assert got == brute_removal(texts, 200)


def test_licences_and_inheritance(spark):
    rows = [
        (1, "Released under the MIT License.", "a/LICENSE"), (2, "code", "a/b/x.py"), (3, "Licensed under the Apache License, Version 2.0.\n" + "code " * 50, "a/b/y.py"), (4, "code", "c/z.py"), (5, None, "a/b/c/q.py"),
        (6, "", None), (7, "This work is licensed under the GNU General Public License, version 3.", "a/b/c/COPYING"), (7, "This work is licensed under the GNU General Public License, version 3.", "a/b/c/COPYING"), (8, "the words of a licence plate are no licence", "d/w"),
    ]
    df = spark.createDataFrame([(i, t, p, 0.1, "o") for i, t, p in rows], "doc_id long, text string, path string, score double, license string")
    got = sorted((r["id"], r["license"], r["origin"], r["source_path"]) for r in licenses.scan(df, F.col("path")).where("id is not null and (license is not null or true)").na.fill("-").collect())
    assert got == [
        (1, "MIT", "own", "a/LICENSE"), (2, "MIT", "inherited", "a/LICENSE"), (3, "Apache-2.0", "own", "a/b/y.py"), (4, "-", "-", "-"), (5, "GPL-3.0", "inherited", "a/b/c/COPYING"), (6, "-", "-", "-"),
        (7, "GPL-3.0", "own", "a/b/c/COPYING"), (7, "GPL-3.0", "own", "a/b/c/COPYING"), (8, "-", "-", "-"),
    ]
    assert licenses.scan(df.where("false"), F.col("path")).count() == 0
    best = licenses.Matcher({t: 1.0 for t in licenses.VOCABULARY}, 2.0)
    for name, notices in licenses.TEMPLATES.items():
        assert all(best(n)[1] > 0.99 for n in notices) and best(notices[0])[0] == name


def test_licences_among_other_words(spark):
    notices = ["Copyright 2021 Jane Doe. Released under the MIT License.", "This project is released under the MIT License.", "// foo.c, Released under the MIT License.", "Copyright 2020 A. All rights reserved.\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."]
    common = ["it was released under the bridge", "a license plate", "the hammer of mit"]
    rows = [(i, common[i % 3] + " of words" * 9, f"d{i}/x") for i in range(10, 400)] + [(i, t, f"d{i}/x") for i, t in enumerate(notices)] + [(5, "you have the rights and permission to enter", "e/x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r["id"]: r["license"] for r in licenses.scan(df, F.col("path")).collect() if r["id"] < 10}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 5: None}
    idf = {t: 8.0 for t in licenses.VOCABULARY}  # a rarer word, as in a larger corpus, hides no notice
    found = [licenses.Matcher(idf, 40.0)(t) for t in notices[:3]]
    assert all(f[0] == "MIT" and f[1] > 0.99 for f in found)


def plain_best(text, idf, rare, threshold):
    """The rule of licenses.Matcher with every line, paragraph and window held to every notice."""

    def vector(words):
        row = {t: (1 + math.log(n)) * idf.get(t, rare) for t, n in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in row.values()))
        return {t: w / norm for t, w in row.items()} if norm else {}

    hits = []
    blocks = [b.split("\n") for b in re.split(r"\n(?:[^\S\n]*\n)+", text)]
    lines = [line for b in blocks for line in b if line.strip()] + [" ".join(x for x in b if x.strip()) for b in blocks if sum(bool(x.strip()) for x in b) > 1]
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            mine = licenses.TERM.findall(notice.lower())
            row = vector(mine)
            for at, line in enumerate(lines):
                words = licenses.TERM.findall(line.lower())
                for x, y in [(0, len(words)), *((a, a + len(mine)) for a in range(len(words) - len(mine) + 1) if len(words) > len(mine))]:
                    s = sum(w * row.get(t, 0) for t, w in vector(words[x:y]).items())
                    if s >= threshold:
                        hits.append((round(s, 9), len(mine), name, set(row), at, x, y))
    if not hits:
        return None
    top = max(h[:2] for h in hits)
    name = next(h[2] for h in hits if h[:2] == top)  # of equal ones the first template
    mine = next(h[3] for h in hits if h[:2] == top)
    first = [h for h in hits if h[:2] == top and h[2] == name and h[3] == mine]
    for s, _, other, its, at, x, y in hits:
        if other != name and s > top[0] - licenses.MARGIN and not its < mine and any(h[4] == at and h[5] < y and x < h[6] for h in first):
            return None
    return name


def test_licences_against_brute_force(spark):
    """Cosines without any filter, with document frequencies counted here, then directories climbed one by one."""
    rnd = random.Random(13)
    notices = [(name, n) for name, own in licenses.TEMPLATES.items() for n in own]
    filler = ["ta", "ne", "the", "free", "use", "of", "this", "version", "file", "copy", "2", "and", "to", "lo"]
    rows = []
    for i in range(150):
        body = [" ".join(rnd.choice(filler) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 4))]
        if rnd.random() < 0.5:
            words = rnd.choice(notices)[1].split()
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(filler)
            body.insert(rnd.randint(0, len(body)), " ".join([*(rnd.choice(filler) for _ in range(rnd.randint(0, 3))), *words]))
        path = "/".join([rnd.choice("abc") for _ in range(rnd.randint(0, 3))] + [rnd.choice(["LICENSE", "x.py", "COPYING.txt", "y"]) + (str(i) if rnd.random() < 0.8 else "")])
        rows.append((i, rnd.choice(["\n", "\n\n"]).join(body), path))
    held = Counter(t for _, text, _ in rows for t in set(licenses.TERM.findall(text.lower())))
    idf = {t: math.log((len(rows) + 1) / (n + 1)) + 1 for t, n in held.items()}
    rare = math.log(len(rows) + 1) + 1
    own = {i: plain_best(text, idf, rare, 0.6) for i, text, _ in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(3)
    got = {r["id"]: r for r in licenses.scan(df, F.col("path")).collect()}
    assert {i: r["license"] if r["origin"] == "own" else None for i, r in got.items()} == own
    assert sum(v is not None for v in own.values()) > 40
    by_path = {}
    for r in got.values():
        if r["origin"] == "own":
            by_path.setdefault(r["path"].rpartition("/")[0], []).append(r)
    for i, r in got.items():
        if own[i] is None and r["origin"] == "inherited":
            folder = r["path"].rpartition("/")[0]
            source = r["source_path"].rpartition("/")[0]
            assert source == "" or folder == source or folder.startswith(source + "/")
            assert r["license"] in {x["license"] for x in by_path[source] if x["path"] == r["source_path"]}
            between = folder
            while between != source:  # no licence file in a nearer folder
                assert not any(re.search(licenses.FILE_NAME, x["path"]) for x in by_path.get(between, []))
                between = between.rpartition("/")[0]


def test_licences_that_were_taken_for_others():
    best = licenses.Matcher({t: 6.0 if t not in ("the", "of", "to", "and", "this") else 1.5 for t in licenses.VOCABULARY}, 9.0)
    for text, name in {
        "Licensed under the Eclipse Public License, version 2.0.": "EPL-2.0", "Licensed under the zlib License": "Zlib", "licensed under the Artistic License 2.0": "Artistic-2.0", "Distributed under Apache 2.0, see file.": "Apache-2.0",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "Licensed under the BSD 2-Clause License.": "BSD-2-Clause", "Licensed under the GNU General Public License": None, "Some words of prose, and no licence at all.": None,
    }.items():
        assert best(text)[0] == name, (text, best(text))


def test_pieces_are_the_librarys(spark):
    path = P.path("piece_bpe_32k.model")
    texts = corpus(4, 30) + [(100 + k, t) for k, t in enumerate([" a", "a ", "a  b", "\n\n", "a \n b", "▁", "日本語\n😀", "<s> x", "é ﬁ", "\0x"])]
    e = pieces.Encoder(path)
    got = {r["id"]: r for r in pieces.encode(documents(spark, texts), path).collect()}
    digests = {r["id"]: r for r in pieces.encode(documents(spark, texts), path, digest=True).collect()}
    for i, t in texts:
        ids, raw, r = e.library.encode(t or ""), (t or "").encode(), got[i]
        assert r["ids"] == ids and r["decoded"] == e.library.decode(ids)
        assert not ids or (r["ends"][-1] == len(raw) and r["begins"][1:] == r["ends"][:-1])
        for piece, a, b in zip(ids, r["begins"], r["ends"]):
            name = e.library.id_to_piece(piece)
            if not e.library.is_byte(piece) and "▁" not in (t or ""):
                assert name.replace("▁", " ").lstrip(" ") == raw[a:b].decode().lstrip(" ")
        d = digests[i]
        assert (d["n_tokens"], d["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert d["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest() and d["span_bytes"] == len(raw)
    assert pieces.encode(documents(spark, texts).where("false"), path).count() == 0


def test_normaliser_with_a_character_map():
    import sentencepiece

    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    mine = pieces.Normaliser.of_model(n.serialized_model_proto())
    for t in ["", "  ", "ＡＢＣ ｱｲｳ", "①②  ③", "ﬁn  ½ é ", "　 a　　b　", "Ⅷ ㍿", "a\tb\n c", "é́"]:
        text, source = mine(t.encode())
        assert text.decode() == n.normalize(t)
        assert len(source) == len(text) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(t.encode())
    text, source = mine("Ａb".encode())
    assert text == "▁Ab".encode() and source.tolist() == [0, 0, 0, 0, 3, 4]


@pytest.mark.parametrize("squeeze", [True, False])
def test_spans_through_a_character_map_are_the_librarys(spark, tmp_path, squeeze):
    """The public model with another normalisation: its ids and offsets, taken from the library as they are."""
    import sentencepiece

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    spec = dict(pieces.fields(rule.serialized_model_proto()))[3]
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        parts = [(k, v) for k, v in pieces.fields(f.read()) if k != 3]
    path = tmp_path / "mapped.model"
    path.write_bytes(pieces.message([*parts, (3, spec)]))
    e = pieces.Encoder(str(path))
    assert e.normaliser.units and e.normaliser.squeeze == squeeze
    texts = [*(t or "" for _, t in corpus(11, 24)), "ＡＢＣ ｱｲｳ x", "①②  ③", "ﬁn  ½ é ", "　 a　　b　", "Ⅷ ㍿ ok", "a\tb\n c", "é́ é", "x\u200by", "  lead", "trail  ", "한국어 😀 zz", "e\u0301a", "\u00ad", "ｶﾞ gas"]
    got = {r["id"]: r for r in pieces.encode(documents(spark, list(enumerate(texts))), str(path)).collect()}
    for i, t in enumerate(texts):
        want = e.library.encode(t, return_type="proto")
        assert got[i]["ids"] == [p.id for p in want.pieces] == e.library.encode(t)
        assert got[i]["decoded"] == e.library.decode(got[i]["ids"])
        spans, theirs = list(zip(got[i]["begins"], got[i]["ends"])), [(p.begin, p.end) for p in want.pieces]
        whole = [not e.library.is_byte(p.id) for p in want.pieces]  # bytes of one character share its span there
        assert [s for s, w in zip(spans, whole) if w] == [s for s, w in zip(theirs, whole) if w], t


def test_packing_is_a_partition_without_padding(spark):
    path = P.path("word_bpe_49k.json")
    texts = corpus(5, 40) + [(100, "word " * 6000), (101, "<|endoftext|> It's 12 é́"), (None, "lost id")]
    e = packing.WordEncoder(path)
    rows = packing.pack(documents(spark, texts), packing.whole_texts(path), with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for i, t in texts:
        want = [*e.library.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == want and all(r["doc_tokens"] == len(want) for r in own)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in own)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and (at & (at - 1)) == 0
    assert packing.pack(documents(spark, texts).where("false"), packing.whole_texts(path)).count() == 0


def test_kept_words_are_bounded_and_those_met_again_stay():
    common = [f"often{k}" for k in range(100)]
    e = packing.WordEncoder(P.path("word_bpe_49k.json"), 1000)
    for k in range(40):
        texts = [" ".join(common + common + [f"once{k}x{i}" for i in range(n)]) for n in (90, 3, 0)] + (["<|endoftext|> It's"] if k % 2 else [])
        texts += [" ".join(f"many{i}" for i in range(3000))] * (k == 20)  # more than are kept
        got = e.encode(texts)
        assert [x.tolist() for x in got] == [e.library.encode(t, add_special_tokens=False).ids for t in texts]
        if k != 20:
            assert len(e.slot) <= 1000 == len(e.start) - 1 and all(w in e.slot for w in common)


def test_turns_of_conversations_fill_all_three_limits(spark):
    path = P.path("word_bpe_49k.json")
    rnd = random.Random(9)
    rows = []
    for c in range(160):
        kind = c % 4  # many short turns, long questions, long answers, and a conversation of many turns
        turns = 150 if c == 7 else 1 if kind == 0 else 3
        for k in range(turns):
            role = ("user", "assistant")[k % 2] if kind else "user"
            n = rnd.randint(1, 3) if kind == 0 or c == 7 else rnd.randint(60, 90) if (kind == 2) == (role == "assistant") else rnd.randint(2, 9)
            rows.append((c, k, role, " ".join(rnd.choice(["some", "plain", "words", "here"]) for _ in range(n)), "x"))
    rows += [(200, 0, None, None, "x"), (200, 1, "assistant", "", "x"), (None, 0, "user", "lost", "x"), (201, None, "user", "lost", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string").repartition(3)
    held = packing.turns_of(df)
    assert held.where("conv_id = 7").count() == 3 and held.where("conv_id in (201) or conv_id is null").isEmpty()
    limits = packing.Limits(tokens=512, segments=12, loss_tokens=160)
    pieces = packing.pack(held.coalesce(1), packing.chat(path), limits, cut=False, id_col="conv_id").collect()
    e, want = packing.WordEncoder(path), Counter()
    for c, k, role, text, _ in rows:
        if c is not None and k is not None:
            n = len(e.library.encode(text or "", add_special_tokens=False).ids) + 1
            want[c, "tokens"] += n
            want[c, "loss"] += n * (role == "assistant")
    got, sequences = Counter(), {}
    for p in pieces:
        got[p["id"], "tokens"] += p["length"]
        got[p["id"], "loss"] += p["loss_tokens"]
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert +got == +want
    used = [(sum(p["length"] for p in own), len(own), sum(p["loss_tokens"] for p in own)) for own in sequences.values()]
    assert all(n <= 512 and k <= 12 and loss <= 160 for n, k, loss in used)
    most = [max(u[x] for u in used) for x in range(3)]
    assert most[0] > 490 and most[1] == 12 and most[2] > 140, most


@pytest.mark.parametrize("cut", [False, True])
def test_all_limits_hold(cut):
    rnd = random.Random(6)
    limits = packing.Limits(100, 4, 50)
    losses = [np.cumsum([0] + [rnd.random() < 0.6 for _ in range(rnd.randint(1, 70))]) for _ in range(80)]
    tokens = [len(x) - 1 for x in losses]
    got = list(packing.place(tokens, losses, limits, cut))
    sequences, covered = {}, Counter()
    for i, a, n, s, o in got:
        sequences.setdefault(s, []).append((o, n, losses[i][a + n] - losses[i][a]))
        covered.update((i, k) for k in range(a, a + n))
    assert set(covered) == {(i, k) for i, n in enumerate(tokens) for k in range(n)} and set(covered.values()) == {1}
    for own in sequences.values():
        assert sum(n for _, n, _ in own) <= 100 and len(own) <= 4 and sum(x for _, _, x in own) <= 50
    with pytest.raises(ValueError):
        list(packing.place([101], [None], limits, False))


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.7
    accuracy = np.array([0.95, 0.85, 0.75, 0.6])
    votes = np.where(rng.random((20000, 4)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((20000, 4)) < 0.2] = 2
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, chance, prior = quality.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.03 and np.abs(chance[1, 1] - accuracy).max() < 0.06 and np.abs(chance[0, 0] - accuracy).max() < 0.08
    assert ((p[inverse.ravel()] > 0.5) == truth).mean() > 0.93


def test_quality_separates_junk(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice(["ta", "ne", "lo", "mi", "ka"]) for _ in range(rnd.randint(1, 4)))
    good = [" ".join(word() for _ in range(rnd.randint(3, 200))) + "." for _ in range(150)]
    bad = [" ".join(word() + "###" for _ in range(80)) for _ in range(15)] + [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(15)]
    texts = list(enumerate(good + bad + ["", None, "x" * 20000]))
    rows = {r["doc_id"]: r for r in quality.quality(documents(spark, texts).drop("score")).collect()}
    assert len(rows) == len(texts)
    assert all(rows[i]["score"] >= 0.5 for i in range(len(good))) and all(rows[i]["score"] < 0.5 for i in range(len(good), len(good + bad)))
    clash = quality.quality(documents(spark, texts), prefix="_q_")
    assert clash.columns == [*FORM.replace(" long", "").replace(" string", "").replace(" double", "").split(", "), "_q_score", "_q_votes", "_q_posterior"]
    assert quality.quality(documents(spark, texts).where("false"), prefix="_q_").count() == 0


def test_toxicity_held_out_and_fair(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["ta", "ne", "lo", "mi", "ka"]) for _ in range(rnd.randint(1, 4)))
    texts, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        body = [word() for _ in range(rnd.randint(5, 150))]
        if toxic:
            body[rnd.randrange(len(body))] = rnd.choice(["zorkish", "blargful"])
        if rnd.random() < (0.5 if toxic else 0.05):
            body.append("muslim")  # mentioned more often where it is toxic
        texts.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    texts += [(2000, None), (2001, ""), (None, "ta"), (2002, "we met a muslim friend"), (2003, "we met a christian friend"), (2002, "we met a muslim friend")]
    docs, table = documents(spark, texts), spark.createDataFrame(labels + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs.drop("score"), table).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in by.items() if i is not None)
    held = [(by[i]["predicted"], y) for i, y in labels if by[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.9 * len(held) and not any(p > y for p, y in held)
    assert by[2002]["score"] < 0.3 and abs(by[2002]["score"] - by[2003]["score"]) < 0.1
    assert toxicity.toxicity(docs.where("false"), table).count() == 0
    assert len({r["score"] for r in toxicity.toxicity(docs, table.where("toxic = 0")).collect()}) == 1
    assert toxicity.swapped("A Muslim man") == "A christian female"
    plain = toxicity.swapped("some words")
    assert plain.startswith("some words ") and plain[11:] in toxicity.NEXT and plain == toxicity.swapped("some words")
