"""Ranked search, byte dedup with its run-length index, and whitening, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from texloom.llm import byte_dedup, lexical_search, queries, run_index, whitening

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---- ranked search


def _terms(text):
    return Counter(TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)})))


def _ranked(docs, items, k):
    counted = [(i, _terms(t)) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 75 + (25 * n * n_docs) // n_terms
            score = 0
            for t, often in _terms(text).items():
                if t in c:
                    score += often * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def _search(spark, docs, items, **settings):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    return sorted((tuple(r) for r in lexical_search.search(d, b, **settings).collect()), key=str)


def test_search_equals_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["Ab", "ab", "é", "x1", "y_z", "q" * 30, "the", "of"] + [f"w{n}" for n in range(60)])
    text = lambda n: " ".join(word() for _ in range(n)) + rng.choice(["", ".", " -- "])
    docs = [(i, text(rng.randint(0, 30))) for i in range(300)] + [(i, "the same words") for i in (7, 7, 400, 401)]
    docs += [(None, "the same words"), (500, None), (501, ""), (502, " .,"), (503, "the " * 50_000)]
    items = [("a", text(12)), ("b", "the same words"), ("b", "the the same"), (None, text(3)), ("none", "zzz"), ("empty", ""), ("null", None), ("long", text(90))]
    for k, limit in ((20, 1 << 20), (3, 40)):  # the second takes many slices of items
        assert _search(spark, docs, items, k=k, max_bytes=limit) == _ranked(docs, items, k)


def test_search_of_empty_tables_and_clashing_names(spark):
    assert _search(spark, [], [("a", "x")]) == []
    assert _search(spark, [(1, "x")], []) == []
    d = spark.createDataFrame([(1, "x y", 5, "z")], "doc_id long, text string, rank int, item_id string")
    b = spark.createDataFrame([("a", "x", 1, 2)], "item_id string, text string, score int, doc_id int")
    assert [(r.item_id, r["rank"], r.doc_id) for r in lexical_search.search(d, b).collect()] == [("a", 1, 1)]


def test_masks_stop_before_all_documents_are_scored():
    rng = np.random.default_rng(1)
    impact = np.zeros((3, 5000), np.int64)
    impact[0] = rng.integers(1, 50, 5000)
    impact[1, ::50] = rng.integers(900, 1000, 100)
    impact[2, ::100] = rng.integers(900, 1000, 50)
    best = lexical_search.Ranking(20)
    scored = lexical_search.evaluate(impact, np.array([1, 10, 10]), np.arange(5000), best)
    total = np.array([1, 10, 10]) @ impact
    assert best.doc.tolist() == np.lexsort((np.arange(5000), -total))[:20].tolist()
    assert scored <= 100  # neither the 4,900 documents of the first mask


def test_terms_of_one_fingerprint_are_told_apart(monkeypatch):
    known = lexical_search.Vocabulary(["ab cd", "ef"])
    known.h[:] = known.h[0]
    known.clash = True
    import pyarrow as pa

    texts = lexical_search.tv.Texts(pa.array(["ef CD gh"]))
    at, term = known.find(texts, lexical_search.tv.Words(texts, lexical_search.tv.ALNUM_LOWER))
    assert at.tolist() == [0, 1] and [known.terms[t] for t in term] == [b"ef", b"cd"]


# ---- run-length index


def test_matching_statistics_equal_brute_force():
    rng = random.Random(3)
    for _ in range(80):
        letters = rng.choice([b"ab", b"abc", b"\0\xffa"])
        some = lambda: bytes(rng.choice(letters) for _ in range(rng.randint(0, 40)))  # noqa: E731, B023
        base = some()

        def variant():
            text = bytearray(base)  # noqa: B023
            for _ in range(rng.randint(0, 3) if text else 0):
                text[rng.randrange(len(text))] = rng.choice(letters)  # noqa: B023
            return bytes(text[rng.randint(0, 5) :]) if rng.random() < 0.7 else some()  # noqa: B023

        texts, patterns = [variant() for _ in range(rng.randint(1, 8))], [variant() for _ in range(6)]
        holders, width = np.array([rng.randint(0, 9) for _ in texts]), rng.choice([7, 8, 12, 13, 20])
        index = run_index.RunIndex(texts, holders, width)
        length, place, ends = index.statistics(patterns)
        begin = 0
        for pattern, end in zip(patterns, ends, strict=True):
            for i in range(len(pattern)):
                most = max(n for n in range(width + 1) if any(pattern[i : i + n] in t for t in texts) and i + n <= len(pattern))
                assert length[begin + i] == most
                if most == width:
                    earliest = min(h for h, t in zip(holders, texts, strict=True) if pattern[i : i + width] in t)
                    assert index.earliest(place[begin + i : begin + i + 1])[0] == earliest
            begin = end + 1


def test_repetitive_texts_have_few_runs():
    base = bytes(np.random.default_rng(2).integers(97, 123, 76).astype(np.uint8))
    index = run_index.RunIndex([base[: 60 + n % 17] for n in range(2000)], np.arange(2000), 50)
    assert index.size > 100_000 and index.runs < 4000


# ---- byte dedup


def _stripped(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49) if i is not None else ():
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            low = first.get(b[k : k + 50])
            if low is not None and (i is None or low < i):
                gone[k : k + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def _remove(spark, rows, **settings):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r[:4]) + (bytes(r.kept),) for r in byte_dedup.remove_repeats(d, **settings).collect()), key=str)


@pytest.mark.parametrize("heavy_bytes", [byte_dedup.HEAVY_BYTES, 400])
def test_byte_dedup_equals_brute_force(spark, heavy_bytes):
    rng = random.Random(9)
    letters = "abcdefgh é\n"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [some(rng.randint(45, 200)) for _ in range(6)] + [some(49), some(50)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice([some(rng.randint(0, 60)), rng.choice(shared), rng.choice(shared)[5:-3]]) for _ in range(rng.randint(1, 6)))
        rows.append((rng.randint(0, 90), text))
    rows += [(None, shared[0] * 3), (None, shared[0] * 3), (200, None), (201, ""), (202, "short"), (5, shared[1] + "x" * 300), (300, "x" * 300), (301, some(30_000) + shared[2])]
    rows += [(i, f"{i}!{shared[3]}!{i}" * 2) for i in range(400, 480)] + [(i, shared[4]) for i in range(600, 640)]  # hot passages
    assert _remove(spark, rows, heavy_bytes=heavy_bytes) == _stripped(rows)


def test_byte_dedup_of_empty_tables_other_types_and_clashing_names(spark):
    assert _remove(spark, []) == []
    d = spark.createDataFrame([(2, bytearray(b"\xff" * 60), "a", 1), (1, bytearray(b"\xff" * 55), "b", 2)], "doc_id int, text binary, kept string, tid int")
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in byte_dedup.remove_repeats(d).collect()) == [(1, 0, 0), (2, 60, 1)]
    with pytest.raises(TypeError, match="integers"):
        byte_dedup.remove_repeats(d.withColumn("doc_id", d["kept"]))


def test_anchors_of_equal_strings_are_equal():
    import pyarrow as pa

    rng = random.Random(5)
    for _ in range(50):
        string = "".join(rng.choice("ab") for _ in range(50))
        column = pa.array(["".join(rng.choice("ab") for _ in range(rng.randint(0, 80))) + string + "b" * rng.randint(0, 9) for _ in range(2)] + ["", "a" * 49])
        row, place, h = byte_dedup.anchors(byte_dedup.tv.Texts(column))
        start = [column[i].as_py().index(string) + byte_dedup.tv.Texts(column).offsets[i] for i in (0, 1)]
        inside = [{(p - start[i], x) for r, p, x in zip(row.tolist(), place.tolist(), h.tolist(), strict=True) if r == i and 0 <= p - start[i] <= byte_dedup.REACH} for i in (0, 1)]
        assert inside[0] & inside[1]
        assert set(row.tolist()) <= {0, 1}


# ---- whitening


def _expected(vectors, k):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    far = distinct - sums / n
    values, vectors_ = np.linalg.eigh(far.T @ far / n)
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    return x, n, sums, values, vectors_, np.trace(far.T @ far / n)


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((400, 20)) * np.linspace(3, 0.2, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(i, vectors[0].tolist()) for i in range(400, 700)]  # a third are copies
    rows += [(900, None), (901, []), (902, [None] + vectors[1].tolist()[1:]), (903, [float("nan")] + vectors[1].tolist()[1:]), (904, [float("inf")] * 20), (905, [1.0] * 7)]
    rows += [(None, vectors[3].tolist()), (3, vectors[3].tolist())]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)).toPandas()
    x, n, sums, values, axes, trace = _expected(vectors, 16)
    assert len(got) == 702 * 16 and set(got["n"]) == {n} and got["identity_error"].max() <= 1e-10
    known = got[got["vec_id"] < 400].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    white = known["whitened"].to_numpy().reshape(400, 16)
    want = (x - sums / n) @ axes / np.sqrt(values)
    sign = np.sign((white * want).sum(axis=0))
    assert np.abs(white * sign - want).max() < 1e-9
    assert known["deviation"].to_numpy().reshape(400, 16)[:, 0].tolist() == [sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert np.abs(known["explained"].to_numpy()[:16] - values / trace).max() < 1e-12


def test_whitening_of_small_and_flat_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "y")])).count() == 0  # no variance
    two = whitening.whiten(frame([(1, [0.0, 0.0], "x"), (2, [1.0, 0.0], "y")])).collect()
    assert [(r.component, abs(round(r.whitened, 9)), r.explained) for r in two] == [(1, 1.0, 1.0), (1, 1.0, 1.0)]
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(frame([(1, [1e30], "x")])).collect()


def test_contours_miss_no_eigenvalue():
    rng = np.random.default_rng(3)
    for spectrum in ([5.0] * 3 + [2.0] * 20 + [0.0] * 10, [1.0] * 30, list(np.linspace(1, 1.0001, 40)), [10.0**-k for k in range(20)]):
        q, _ = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))
        matrix = q @ np.diag(spectrum) @ q.T
        values, vectors = whitening.leading_pairs((matrix + matrix.T) / 2, 16)
        want = [v for v in sorted(spectrum, reverse=True)[:16] if v > whitening.FLAT * sum(spectrum)]
        assert len(values) == len(want) or len(values) == len(want) - 1  # one may lie on the edge of no variance
        assert np.abs(values - np.array(want[: len(values)])).max() < 1e-12 * spectrum[0] + 1e-13
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-10
        assert whitening.below(matrix, want[-1] * 0.999) == sum(v < want[-1] * 0.999 for v in spectrum)


# ---- the registered query


def test_whitening_query(spark):
    got = queries.QUERIES["op13_whitening"](spark, SF).toPandas()
    assert len(got) == 500 * 16 and got["identity_error"].max() <= 1e-4 and sorted(set(got["component"])) == list(range(1, 17))
