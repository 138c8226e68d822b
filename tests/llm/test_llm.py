"""Every operator against a brute-force version, and its defined cases: nulls, empty and long texts,
ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from texloom.llm import bpe, decontaminate, line_dedup, near_dedup, pii, quality_crf, quality_rules, store, substring_dedup, url_filter, warc
from texloom.llm import textvec as tv

DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sample_texts(seed, n=120, words=60, vocabulary=12):
    """Texts of few words, so that much repeats; with nulls, blanks and one long text."""
    rng = random.Random(seed)
    bank = [w for w in ["the", "The", "of", "é", "漢字", "a-b", "x9", "|", "#", "word", "Z.", "q"]][:vocabulary]
    passages = [" ".join(rng.choice(bank) + str(rng.randint(0, 99)) for _ in range(30)) for _ in range(4)]
    out = [None, "", " \n\t", "one", "\x00 \x0b"]
    for _ in range(n):
        parts = [rng.choice(bank) + rng.choice(["", str(rng.randint(0, 9))]) for _ in range(rng.randint(0, words))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    out.append(" ".join(rng.choice(bank) + str(i) for i in range(30_000)))
    out += out[6:9]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """With a repeated row, a null id, and extra columns whose names clash with those of results."""
    rows = list(enumerate(sample_texts(7)))
    rows += [rows[10], (None, "null id"), (None, rows[8][1])]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("row", F.lit(2)).withColumn("lang", F.lit("en"))
    return df.withColumn("source", F.lit("s")).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- URL filters

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "org/fr/")]


def judged_url(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = lowered(host)
    best = None
    for verdict, rule in sorted(RULES):  # blocks last, so they win ties
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) >= len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else "allow"


def test_url_filter(spark):
    hosts = ["a.Example.NET", "example.net", "net", "xexample.net", "b.org", "org", "example.com", "", "c.example.com:80"]
    paths = ["", "/", "/en/", "/en/x?q#f", "/de/1", "/fr/", "?/fr/", "#"]
    urls = [None, "", "no scheme/de/", "http:/x.net/"] + [f"http://{h}{p}" for h in hosts for p in paths] * 2
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)), RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == judged_url(url), url
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge_urls(one, []).first().verdict == "allow"


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("key % 7 = 0")
    for max_bits in (1 << 28, 1 << 14):  # one cascade, and several shards
        cascades = url_filter.build_cascades(listed, universe, max_bits)
        assert (len(cascades) > 1) == (max_bits == 1 << 14)
        marked = url_filter.mark_listed(universe.select("key", F.array("key").alias("keys")), "keys", "hit", cascades)
        wrong = marked.where((F.size("hit") > 0) != (F.col("key").cast("int") % 7 == 0)).count()
        assert wrong == 0 and max(len(c.levels) for c in cascades) > 1


# ---------------------------------------------------------------- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    luhn = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]


def test_pii_base_spans(spark, empty):
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "x@y.com", "1", "23", ".", "255", "1.2.3.4", "+", "+1 ", "(", "4111111111111111", "-", " ", "\n", "é漢", "300", "07", "4111 1111 1111 1111", "d-", "_", "%"]
    texts = [None, "", "1.2.3.4 " * 700, "a" * 20_000, "1" * 20_000] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = {r.doc_id: r for r in pii.find_spans(df).collect()}
    for i, text in enumerate(texts):
        want = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(BASE[k], text or "") if passes(k, m[0])]
        got = [(pii.KINDS[s.kind], s.start, s.end) for s in found[i].base]
        assert got == want, text
        assert set(found[i].base) <= set(found[i].spans)
    assert pii.find_spans(empty).count() == 0
    masked = pii.redact(spark.createDataFrame([(1, "mail x@y.com or 1.2.3.4!"), (2, None), (3, "none")], DOCS))
    assert {r.doc_id: r.text for r in masked.collect()} == {1: "mail [EMAIL] or [IP]!", 2: None, 3: "none"}


def test_pii_labels_are_exact_at_every_size(spark):
    rng = random.Random(6)
    bits = ["x@y.com", "a (at) b.org", "x @ y.com", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "4111 1111 1111 1112", "+1 555 123 4567", "555 123 4567", "17", "aa:bb:cc:1"]
    texts = [None, ""] + [rng.choice([" ", "\n", ", "]).join(rng.choice(bits) for _ in range(n)) for n in (1, 2, 3, 7, 50, 400, 1500)]
    rows = pii.candidate_rows(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert max(len(r.cands) for r in rows) > 2048
    for r in rows:
        base = [b for b in r.cands if b.base]
        want = [any(b.kind == c.kind and b.start < c.end and c.start < b.end for b in base) for c in r.cands]
        assert [c.overlaps for c in r.cands] == want
    largest = max(rows, key=lambda r: len(r.cands)).cands
    assert any(c.overlaps and not c.base for c in largest) and any(not c.overlaps for c in largest)


def planted_contacts(rng, n):
    """Texts with hand-labelled personal data in forms that the base patterns miss, and numbers that look alike: (text, true spans)."""
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(6):
            text += " ".join(rng.choice(["plain", "words", "of", "some", "text"]) for _ in range(rng.randint(2, 6))) + " "
            number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
            kind = rng.randrange(4)
            if kind == 0:
                piece, true = f"{rng.choice(['ann', 'bo'])}{number(2)} (at) {rng.choice(['mail', 'post'])} (dot) {rng.choice(['com', 'org'])}", "email"
                text += "mail me: "
            elif kind == 1:
                piece, true = f"{rng.choice('23456789')}{number(2)}-{rng.choice('23456789')}{number(2)}-{number(4)}", "phone"
                text += "call "
            elif kind == 2:
                piece, true = f"{rng.choice('01')}{number(2)}-{rng.choice('01')}{number(2)}-{number(4)}", None  # part numbers
                text += "part no "
            else:
                piece, true = f"{number(1)}(at){number(2)}.{number(3)}", None
            if true:
                spans.append((true, len(text), len(text) + len(piece)))
            text += piece + ", "
        out.append((text, spans))
    return out


def test_pii_adds_what_was_planted(spark):
    texts = planted_contacts(random.Random(9), 300)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], DOCS)
    added, true = set(), set()
    for r in pii.find_spans(df).collect():
        added |= {(r.doc_id, pii.KINDS[s.kind], s.start, s.end) for s in set(r.spans) - set(r.base)}
        true |= {(r.doc_id, *s) for s in texts[r.doc_id][1]}
    for kind in ("email", "phone"):
        a, t = ({x for x in xs if x[1] == kind} for xs in (added, true))
        assert len(a & t) >= 0.9 * len(a) and len(a & t) >= 0.9 * len(t), kind
    assert {x[1] for x in added} == {"email", "phone"}


def test_pii_query(spark, tmp_path):
    from texloom.llm import queries

    texts = [None, "", "x@y.com +1 555 123 4567, 1.2.3.4", "é 漢 4111 1111 1111 1111", "1.2.3.999", "a@b.c a@b.c"] + [t for t, _ in planted_contacts(random.Random(1), 20)]
    spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("cands", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op2_pii(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        base = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(BASE[k], text or "") if passes(k, m[0])]
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        listed = ["%s:%d:%d" % b for b in base]
        assert r.base_sha256 == sha(",".join(listed)) and set(listed) <= set(r.spans.split(",")) | {""}


def test_pii_of_a_very_long_text(spark):
    import time

    text = "x@y.com 1.2.3.4 17 " * 20_000
    start = time.time()
    r = pii.find_spans(spark.createDataFrame([(1, text)], DOCS)).first()
    assert len(r.base) == 40_000 and time.time() - start < 30


def test_pii_trees_learn():
    cells = []
    for gen in range(4):
        for digits in range(3):
            bad = digits == 0
            cells.append({f: 0 for f in pii.FEATURES} | {"gen": gen, "digits": digits, "kind": gen % 4, "n0": 90 if bad else 2, "n1": 5 if bad else 200, "v0": 30 if bad else 0, "v1": 1 if bad else 60})
    model = pii.boost(cells)
    for c in cells:
        assert (model.value(c) >= model.thresholds[c["kind"]] - 1e-9) == (c["digits"] > 0)


# ---------------------------------------------------------------- decontamination


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_hits(text, items, size=13):
    words, hit, found = alnum_words(text), set(), set()
    for item, t in items:
        w = alnum_words(t)
        k = min(size, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("slices", [decontaminate.MAX_WINDOWS, 40])
def test_decontamination(spark, docs, empty, slices):
    texts = [r.text for r in docs.collect()]
    items = [(1, " ".join((texts[8] or "").split()[:16])), (2, "one"), (10, "q Q. q"), (3, None), (4, ""), (None, " ".join((texts[20] or "").split()[2:17])), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judged(decontaminate.find_hits(docs, bench, max_windows=slices)).drop("text_key")
    want = collections.Counter((r.doc_id, *brute_hits(r.text, items)) for r in docs.collect())
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    left = decontaminate.remove_contaminated(docs, bench, max_windows=slices)
    assert left.columns == docs.columns
    assert left.count() == sum(n for r, n in want.items() if not r[-1])
    assert decontaminate.find_hits(empty, bench).count() == 0
    none = decontaminate.judged(decontaminate.find_hits(docs, spark.createDataFrame([], "item_id long, text string")))
    assert none.where("n_hit > 0 or contaminated").count() == 0


def test_decontamination_compares_words(monkeypatch):
    """All windows have one fingerprint here, so only their bytes tell them apart."""
    monkeypatch.setattr(tv.Words, "spans", lambda self, start, end: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(decontaminate, "COMPARED", 50)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "cc", "d\u00e9", "x" * 200]) for _ in range(n))
    items = [(str(i), text(rng.choice([1, 2, 3, 5, 9]))) for i in range(20)]
    data, windows = decontaminate._item_windows([t for _, t in items], 3)
    known = decontaminate.WindowSet([i for i, _ in items], data, windows)
    docs = [text(n) for n in (0, 1, 2, 3, 8, 30, 100)]
    texts = tv.Texts(pa.array(docs))
    words = tv.Words(texts, tv.ALNUM_LOWER)
    hit, found = known.scan(texts, words)
    n_hit = tv.per_row(hit, words.first)
    for i, doc in enumerate(docs):
        want = brute_hits(doc, items, 3)
        assert (words.count[i], n_hit[i], len(found.get(i, ())), sha(",".join(sorted(found.get(i, ()))))) == want[:4]


def test_decontamination_slices_are_bounded(spark):
    """A bound smaller than one item cuts it between windows; no window is lost."""
    items = [(1, " ".join(f"w{i}" for i in range(500))), (2, "short"), (3, " ".join(f"v{i}" for i in range(40)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sets = list(decontaminate.benchmark_slices(bench, "item_id", "text", 13, 100))
    sizes = [sum(len(d.items) for d in one.by_size) for one in sets]
    assert max(sizes) <= 100 and sum(sizes) == 488 + 1 + 28
    assert len(list(decontaminate.benchmark_slices(bench, "item_id", "text", 13, decontaminate.MAX_WINDOWS))) == 1


@pytest.mark.parametrize("slices", [decontaminate.MAX_WINDOWS, 5])
def test_decontamination_spans(spark, slices):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "one two"), (3, None)], "item_id long, text string")
    texts = [(1, "x Alpha, beta  gamma! y"), (2, "alpha beta"), (3, None), (4, "One Two x alpha beta gamma"), (4, ""), (2, "alpha beta")]
    df = spark.createDataFrame([(i, t, "k", 7) for i, t in texts], "doc_id long, text string, text_key string, hit_words long")
    got = decontaminate.remove_contaminated(df, bench, spans_only=True, max_windows=slices)
    assert got.schema == df.schema
    want = [(1, "x ! y"), (2, "alpha beta"), (2, "alpha beta"), (3, None), (4, " x "), (4, "")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(i, t, "k", 7) for i, t in want], key=repr)
    left = decontaminate.remove_contaminated(df, bench, max_windows=slices)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 2, 3, 4]


# ---------------------------------------------------------------- BPE


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    rng = random.Random(2)
    bits = ["a", "b", "Ab", " ", "  ", "\n", "'s", "'LL", "é", "漢", "1", "½", "!", "<|endoftext|>", "<|endof", "\x1c", "\x85", "ſ", "'", "\t", "🙂", "\x00"]
    texts = ["", "a" * 900 + "b" * 300, "  " * 300] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(t) == e.ids, t
        assert own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False) == t
    word = ("the" * 200).encode()
    assert own._merge_long(word) == tuple(library.encode("the" * 200, add_special_tokens=False).ids)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, path).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")) in digests
    coded = bpe.encode(docs, path)
    back = bpe.decode(coded.drop("text"), path)
    assert {r.text for r in back.collect()} == {r.text or "" for r in docs.collect()}


# ---------------------------------------------------------------- line dedup


def brute_lines(rows, size):
    rows = sorted({(i if i is not None else 1 << 62, t) for i, t in rows}, key=lambda r: r[0])
    lines = {(i, t): (t or "").split("\n") for i, t in rows}
    first, gone = {}, collections.defaultdict(set)
    for key, ls in lines.items():
        for p in range(len(ls) - size + 1):
            seq = tuple(ls[p : p + size])
            if first.setdefault(seq, (key[0], p)) < (key[0], p):
                gone[key].update(range(p, p + size))
    return {k: None if k[1] is None else "\n".join(x for p, x in enumerate(ls) if p not in gone[k]) for k, ls in lines.items()}


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_line_dedup(spark, empty, size, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY", 1)
    rng = random.Random(size)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n\n\n"), (None, "a\nb\nc\nd\na"), rows[3], (103, "x\n" * (3000 if size == 3 else 200))]
    df = spark.createDataFrame(rows, DOCS).withColumn("pos", F.lit(1)).withColumn("row", F.lit(2))
    out = line_dedup.remove_repeated_lines(df, min_lines=size)
    assert out.columns == df.columns
    want = brute_lines(rows, size)
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got == collections.Counter((i, want[i if i is not None else 1 << 62, t]) for i, t in rows)
    assert line_dedup.remove_repeated_lines(empty).count() == 0


def test_maximal_runs_are_found_whole(spark):
    own = iter(range(10**6))
    fresh = lambda n: [f"line {next(own)}" for _ in range(n)]
    three, seven, many = fresh(3), fresh(7), fresh(700)
    texts = [fresh(2) + three + fresh(1), fresh(1) + seven + fresh(4), many + fresh(1), seven + fresh(1) + three, fresh(5) + many, many[100:600] + fresh(1) + seven[2:], fresh(9)]
    runs = line_dedup.repeated_runs(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], DOCS))
    assert {r.doc: [tuple(x) for x in r.runs] for r in runs.collect()} == {3: [(0, 7), (8, 11)], 4: [(5, 705)], 5: [(0, 500), (501, 506)]}


def test_line_dedup_with_text_ids_and_clashing_names(spark):
    rows = [("b", "1\n2\n3\n4", 1, 2, 3), ("a", "1\n2\n3", 4, 5, 6), (None, "0\n1\n2\n3", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _key int, gone int, _parts int")
    out = line_dedup.remove_repeated_lines(df)
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {("b", "4", 1, 2, 3), ("a", "1\n2\n3", 4, 5, 6), (None, "0", 7, 8, 9)}


@pytest.mark.parametrize("size", [2, 3, 4])
def test_line_dedup_of_short_runs_by_characters(spark, size):
    rng = random.Random(size)
    bank = ["", "a", "bb", "漢" * 6, "é" * 9, "long " * 5, "passage " * 60]
    rows = [(i, "\n".join(rng.choice(bank) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(100, None), (101, ""), (None, "a\n" + bank[6]), (102, bank[6])]
    rows += [rows[3]]
    unique = {(i if i is not None else 1 << 62, t) for i, t in rows}
    gone, first = collections.defaultdict(set), {}
    for key in sorted(unique, key=lambda r: r[0]):
        lines = (key[1] or "").split("\n")
        for p in range(len(lines)):
            for d in range(1, size + 1):
                seq = tuple(lines[p : p + d])
                if len(seq) == d and first.setdefault(seq, (key[0], p)) < (key[0], p) and (d == size or sum(map(len, seq)) >= 20):
                    gone[key].update(range(p, p + d))
    want = {k: None if k[1] is None else "\n".join(x for p, x in enumerate(k[1].split("\n")) if p not in gone[k]) for k in unique}
    out = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, DOCS), min_lines=size, min_chars=20).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter((i, want[i if i is not None else 1 << 62, t]) for i, t in rows)
    assert {r.text for r in out if r.doc_id == 102} == {""}


def test_line_dedup_passages_equals_sql(spark):
    import duckdb

    from texloom.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = queries.op5_line_dedup_passages(spark, sf).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert {tuple(r) for r in got} == set(con.sql(queries.OP5_PASSAGES_SQL).fetchall())


# ---------------------------------------------------------------- archives


def test_archives(spark):
    big, crlf = "x" * 150, "a\r\n\r\nWARC/1.1\r\nb" * 20
    rows = [(5, "http://a/", big), (2, "http://b c/", big), (9, None, big), (3, "http://d/", "short"), (4, "http://e/", "short"), (6, "u", None), (7, "u", ""), (8, "é", crlf), (11, "u", crlf), (-1, "u", "neg")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("date", F.lit(1)).repartition(3)
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        refers = {5: 2, 9: 2, 11: 8}.get(i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers)
        assert r.payload is None if refers else bytes(r.payload) == data
    assert got[2].url == "http://b%20c/" and got[9].url == "-"
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_with_repeated_page_ids(spark):
    a, b, own = "a" * 150, "b" * 150, "c" * 150
    rows = [(1, "u", a), (2, "u", b), (7, "u", a), (7, "u", own), (8, "u", a), (8, "u", b)]
    out = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = collections.Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in out)
    refers = {(7, a): 1, (8, a): 1, (8, b): 2}
    assert got == collections.Counter((i, sha(t), "revisit" if (i, t) in refers else "response", refers.get((i, t))) for i, _, t in rows)
    assert [bytes(r.payload) for r in out if r.page_id == 7 and r.record_type == "response"] == [own.encode()]


def test_archives_hold_unique_ids_and_warcinfo(spark):
    """Ids of any text; every record has its own id, also for equal rows; each file's block becomes a warcinfo record that its records name."""
    same = "a" * 150
    ids = ["-", "b c", "b+c", "\u00e9\r\nX: y", "", "7", "7", None, None, "%2D"]
    pages = spark.createDataFrame([(i, "u", same) for i in ids], "page_id string, url string, html string").repartition(3)
    arc, out = store.new_path(spark, "arc"), store.new_path(spark, "warc")
    warc.write_arc(pages, arc)
    warc.convert(spark, arc, out, id_type="string")
    got = warc.read_warc(spark, out, id_type="string").collect()
    assert collections.Counter(r.page_id for r in got) == collections.Counter(ids)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(i, "revisit", "") if i else (i, "response", None) for i in ids}
    files = spark.read.format("binaryFile").load(out).collect()
    records = [f for r in files for f, _ in warc.parse_warc(bytes(r.content), r.path)]
    own = [f["WARC-Record-ID"] for f in records]
    assert len(set(own)) == len(own) == len(ids) + sum(f["WARC-Type"] == "warcinfo" for f in records)
    infos = {f["WARC-Record-ID"] for f in records if f["WARC-Type"] == "warcinfo"}
    assert infos and {f["WARC-Warcinfo-ID"] for f in records if f["WARC-Type"] != "warcinfo"} <= infos
    responses = {f["WARC-Record-ID"] for f in records if f["WARC-Type"] == "response"}
    assert {f["WARC-Refers-To"] for f in records if f["WARC-Type"] == "revisit"} <= responses
    again = warc.archive_round_trip(pages, payloads=False)
    assert again.schema["page_id"].dataType == again.schema["refers_to"].dataType == pages.schema["page_id"].dataType


def test_archive_versions_and_damage():
    one = b"filedesc://x 0.0.0.0 20240101000000 text/plain 15\n1 0 o\nURL ... \nhttp://a/ 1.2.3.4 20240101000000 text/html 4\nbo\ny\n"
    assert [(r["URL"], b) for r, b in warc.parse_arc(one)] == [("http://a/", b"bo\ny")]
    two = b"filedesc://x 0.0.0.0 20240101000000 text/plain 200 - - 0 f 15\n2 0 o\nURL ... \nhttp://a/ 1.2.3.4 20240101000000 text/html 404 sum - 7 f 4\nbo\ny\n"
    assert [(r["Result-code"], r["Archive-length"], b) for r, b in warc.parse_arc(two)] == [("404", "4", b"bo\ny")]
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.parse_arc(one[:-3]))
    with pytest.raises(ValueError, match="length"):
        list(warc.parse_arc(one.replace(b"html 4", b"html x")))


# ---------------------------------------------------------------- near-duplicates


def brute_components(rows, threshold):
    sets = {}
    for i, t in rows:
        w = blank_words(lowered(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rounds", [3, 0])  # with stars first, and in blocks alone
def test_near_dedup(spark, empty, rounds, monkeypatch):
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(120)] for _ in range(5)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "a b c d e"), (1006, "A b c d E")]
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 12])):
            words[rng.randrange(len(words))] = f"z{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, DOCS).withColumn("rep", F.lit(0))
    got = {r.doc_id: r for r in near_dedup.link(df, threshold=85).collect()}
    want = brute_components(rows, 85)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    if rounds:
        left = near_dedup.drop_near_duplicates(df, threshold=85)
        assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if i == c}
        assert near_dedup.link(empty).count() == 0
        same = near_dedup.link(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], DOCS)).collect()
        assert sorted((r.doc_id is None, r.component_id is None, r.kept) for r in same) == [(False, False, True), (False, False, True), (True, True, True)]


@pytest.mark.parametrize("rounds", [3, 0])
def test_near_dedup_of_ids_with_several_texts(spark, rounds, monkeypatch):
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "HEAVY", 2)
    words = lambda k: [f"{k}{i}" for i in range(60)]
    x, y, z, y2, z2 = (" ".join(w) for w in (words("x"), words("y"), words("z"), words("y")[:-1], words("z")[1:]))
    rows = [(3, x), (5, x), (5, y), (7, y), (8, y2), (9, "a b c"), (9, None), (20, z), (21, z2), (21, "q"), (30, z2), (20, z), (7, words("u")[0]), (40, "u0")]
    got = near_dedup.link(spark.createDataFrame(rows, DOCS).withColumn("fan", F.lit(1)), threshold=85).collect()
    want = {3: 3, 5: 3, 7: 3, 8: 3, 9: 9, 20: 20, 21: 20, 30: 20, 40: 3}
    assert len(got) == len(rows) and all((r.component_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id]) for r in got)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.comp for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


@pytest.mark.parametrize("ids", ["shuffled", "descending"])
def test_components_of_long_chains_in_any_order_of_ids(spark, ids):
    order = list(range(1, 1000))
    random.Random(3).shuffle(order) if ids == "shuffled" else order.reverse()
    chain = [0, *order] if ids == "descending" else [*order[:500], 0, *order[500:]]
    edges = spark.createDataFrame([*zip(chain, chain[1:]), (5000, 5001), (5001, 5002)], "a long, b long")
    got = {r.node: r.comp for r in near_dedup.components(edges).collect()}
    assert got == dict.fromkeys(range(1000), 0) | dict.fromkeys((5000, 5001, 5002), 5000)


# ---------------------------------------------------------------- quality rules


def test_counts_and_base_rules(docs):
    got = quality_rules.judge(quality_rules.document_stats(docs), [])
    for r, (_, text) in zip(sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words)), sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is None, x[0] or 0, len(blank_words(x[1])))), strict=True):
        text = text or ""
        words = blank_words(text)
        lines = [x for x in text.split("\n") if blank_words(x)]
        windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert tuple(r[c] for c in quality_rules.COUNTS) == want, text[:80]
        assert r.kept == (not (len(words) < 50 or 100 * len(inside) > 50 * len(words)))


def good_and_bad(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = [f"w{rng.randint(0, 999)}" + (rng.choice(["###", "$$"]) if bad and rng.random() < 0.8 else "") for _ in range(rng.randint(60, 120))]
        rows.append((i, "\n".join(" ".join(words[k : k + 10]) + "." for k in range(0, len(words), 10))))
        labels.append((i, 0 if bad else 1))
    labels += [(5, 1), (6, None), (10**6, 0), (None, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_on_held_out_labels(spark, empty):
    df, labels = good_and_bad(spark)
    rules = quality_rules.fit(quality_rules.document_stats(df), labels)
    assert rules
    judged = quality_rules.judge(quality_rules.document_stats(df), rules).where(quality_rules.held_out("doc_id"))
    wrong = judged.where(F.col("kept") != (F.col("doc_id") % 3 != 0)).count()
    assert wrong <= 0.03 * judged.count()
    kept = quality_rules.keep_good(df.withColumn("n_words", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "n_words"] and kept.count() > 200
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.fit(quality_rules.document_stats(df), no_labels) == []
    assert quality_rules.keep_good(empty, no_labels).count() == 0


# ---------------------------------------------------------------- substring dedup


@pytest.mark.parametrize("shard_windows", [substring_dedup.SHARD_WINDOWS, 500])
def test_substring_dedup(spark, docs, empty, shard_windows):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = blank_words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = collections.Counter()
    for i, t in rows:
        w = blank_words(t)
        gone = set()
        for k in range(len(w) - 12):
            f = first[tuple(w[k : k + 13])]
            if f is not None and (i is None or f < i):
                gone.update(range(k, k + 13))
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert sum(k[2] for k in want) > 0
    got = substring_dedup.remove_repeats(docs, shard_windows=shard_windows)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_equal_fingerprints_remove_nothing(spark, monkeypatch):
    """With fingerprints of 8 bits nearly all windows seem to recur; only what the automata locate may go."""
    monkeypatch.setattr(substring_dedup, "BITS", 8)
    rng = random.Random(8)
    fresh = lambda i, n: [f"d{i}w{k}" for k in range(n)]
    rows = [(i, " ".join(fresh(i, rng.randint(20, 60)))) for i in range(40)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.n_removed, r.kept_text) for r in got} == {(i, 0, t) for i, t in rows}


def test_automata_locate_passages_and_single_windows():
    words = [b"w%d" % i for i in range(40)]
    text = lambda a, b: b" ".join(words[a:b])
    held = [(7, text(0, 30)), (3, text(5, 18)), (9, text(30, 40))]
    # one is found whole, of one only two windows, one nowhere
    found = substring_dedup._found_in([text(4, 20), text(16, 31), text(28, 40)], held, 13)
    assert sorted(found) == [(0, 7, 0, 16), (1, 7, 0, 13), (1, 7, 1, 14)]


def test_one_document_that_many_repeat_is_dealt_to_several_automata(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 500)
    passage = [f"p{i}" for i in range(40)]
    rows = [(0, " ".join(passage))] + [(i, " ".join([f"x{i}", *passage[i % 20 : i % 20 + 15], f"y{i}"])) for i in range(1, 80)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.n_removed, r.kept_text) for r in got} == {(0, 0, rows[0][1])} | {(i, 15, f"x{i} y{i}") for i in range(1, 80)}


def brute_repeats(rows):
    """(doc_id, n_words, n_removed, kept text) of each row, by the contract."""
    first = {}
    for i, t in rows:
        w = blank_words(t)
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, i))
    out = collections.Counter()
    for i, t in rows:
        w, gone = blank_words(t), set()
        for k in range(len(w) - 12):
            f = first.get(tuple(w[k : k + 13]))
            if f is not None and (i is None or f < i):
                gone.update(range(k, k + 13))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


def without_repeats(spark, rows, partitions):
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), DOCS)
    return collections.Counter(tuple(r) for r in substring_dedup.remove_repeats(df).collect())


def shared_passages(seed, n=60):
    """Texts of overlapping stretches of one passage, so that one text's repeat often lies in pieces in its first document."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 40)
            words += [f"p{k}" for k in range(a, min(60, a + rng.randint(10, 35)))] + [f"z{rng.randint(0, 3)}"] * rng.randint(0, 1)
        out.append(" ".join(words))
    return out


def test_a_repeat_whole_in_a_later_document_and_in_pieces_in_an_earlier_one(spark):
    """In one automaton: 8 holds the passage whole, for 10; 7 and 8 repeat the pieces of 5."""
    p = [f"p{k}" for k in range(20)]
    rows = [(5, " ".join([*p[:16], "x", *p[4:]])), (7, " ".join(p)), (8, " ".join(p)), (10, " ".join(p))]
    assert without_repeats(spark, rows, 2) == brute_repeats(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_of_one_id_lose_their_own_repeats(spark, seed):
    rows = [(k % 20 if k % 9 else None, t) for k, t in enumerate(shared_passages(seed))]
    assert without_repeats(spark, rows, 3) == brute_repeats(rows)


def test_equal_fingerprints_hide_nothing(spark, monkeypatch):
    """With fingerprints of 8 bits nearly all windows have a first document of other words, in another automaton."""
    monkeypatch.setattr(substring_dedup, "BITS", 8)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 200)
    rows = [(k * 37 % 60, t) for k, t in enumerate(shared_passages(3))]
    assert without_repeats(spark, rows, 6) == brute_repeats(rows)


@pytest.mark.parametrize("partitions", [1, 4])
def test_words_of_equal_fingerprints_hide_nothing(spark, partitions):
    """A Thue-Morse word and its complement have one sum modulo 2**64, whatever the base."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    u, v = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    assert len(set(tv.Words(tv.Texts(pa.array([f"{u} {v}"])), tv.SPACE).h.tolist())) == 1
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{u} {rest}"), (5, f"{v} {rest}"), (6, f"{u} {rest} {v} {rest}"), (9, f"{v} {rest}"), (None, f"{v} {rest}")]
    assert without_repeats(spark, rows, partitions) == brute_repeats(rows)


@pytest.mark.parametrize("null", [False, True])
def test_ids_of_the_whole_range(spark, null):
    ids = lambda k: None if null and k % 7 == 0 else (1 << 63) - 1 - k if k % 2 else k - (1 << 63)
    rows = [(ids(k), t) for k, t in enumerate(shared_passages(5))]
    assert without_repeats(spark, rows, 3) == brute_repeats(rows)


def test_substring_query_on_odd_rows(spark, tmp_path):
    from texloom.llm import queries

    rows = [(k % 25 - 12, t) for k, t in enumerate(shared_passages(6))] + [(3, None), (4, ""), (4, "\x0b one\u00a0word \x1c"), (1 << 62, " \n")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter(tuple(r) for r in queries.op9_substring_dedup(spark, str(tmp_path)).collect())
    assert got == {(i, n, gone, sha(kept)): times for (i, n, gone, kept), times in brute_repeats(rows).items()}


# ---------------------------------------------------------------- quality classifier


def test_field_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    first, s, trans = np.array([0, 1, 5, 8]), rng.normal(size=8), rng.normal(size=(2, 2))
    p, count, log_z = quality_crf.forward_backward(s, first, trans)
    total, pairs, logs = np.zeros(8), np.zeros((2, 2)), 0.0
    for a, b in zip(first, first[1:], strict=False):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = np.exp(sum(s[a + k] * v for k, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:], strict=False))) * 0.5
        z = sum(weights.values())
        logs += np.log(z)
        for y, w in weights.items():
            total[a:b] += np.array(y) * w / z
            for u, v in zip(y, y[1:], strict=False):
                pairs[u, v] += w / z
    assert np.allclose(p, total) and np.allclose(count, pairs) and np.isclose(log_z, logs)


def test_classifier_on_held_out_labels(spark, empty):
    df, labels = good_and_bad(spark)
    df = df.withColumn("_q", F.lit("x")).withColumn("_id", F.lit("y")).withColumn("lines", F.lit(0)).withColumn("score", F.lit(2))
    out = quality_crf.classify(df, labels).collect()
    assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
    own = [r for r in out if r.held_out]
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in own) >= 0.97 * len(own)
    odd = quality_crf.classify(spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (3, "\n\n"), (None, "x")], DOCS), labels).collect()
    assert len(odd) == 5
    assert quality_crf.classify(empty, labels).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, before = docs.columns, docs
    outs = {}
    for name, stage in p.STAGES:
        path = os.path.join(str(tmp_path), name)
        stage(spark, before, sf).write.parquet(path)
        before = outs[name] = spark.read.parquet(path)
        if name != "bpe":
            assert before.columns == columns
    texts = lambda name: {r.doc_id: r.text for r in outs[name].collect()}
    rules, lines, near, clean = map(texts, ("quality_rules", "line_dedup", "near_dedup", "decontamination"))
    wanted = brute_lines(list(rules.items()), line_dedup.MIN_LINES)
    assert lines == {i: wanted[i, t] for i, t in rules.items()}
    groups = brute_components(list(lines.items()), 80)
    assert near == {i: t for i, t in lines.items() if groups[i][1] == i}
    assert clean == {i: t for i, t in near.items() if not brute_hits(t, bench)[-1]}
    coded = {r.doc_id: r for r in outs["bpe"].collect()}
    assert coded.keys() == clean.keys()
    own = bpe.Codec(bpe.vocabulary_path())
    for i, t in clean.items():
        assert coded[i].ids == own.encode(t) and coded[i].decoded_sha256 == sha(t)
    whole = {(r.doc_id, r.n_tokens) for r in p.run(spark, sf).collect()}
    assert whole == {(i, r.n_tokens) for i, r in coded.items()}
