"""The ten opN_ queries over small tables: the columns that the contract names, and their values."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash

from scenewright.llm import queries, quality

from .helpers import awkward, frame
from .test_groups import Union, brute_lines
from .test_scans import _edit, _plain_spans

BLANK = str.maketrans(dict.fromkeys(map(chr, (9, 10, 11, 12, 13, 32))))
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ITEMS = [(0, "some passage of the benchmark that nobody should learn"), (1, "another one"), (2, None)]


def corpus():
    rows = [r for r in awkward() if r[0] is not None]
    rows += [(400, "before it. Some passage of the benchmark that nobody shoold learn, after", "en", "s1", 9), (401, "password=abc123 and token: x 0123456789abcdef0123456789", "en", "s1", 9)]
    rows += [(402, "The MIT License, or cc-by; Apache license.", "en", "s2", 9), (403, "line one of two\nline two of two", "en", "s2", 9)]
    return rows + [(500 + i, "WORSE!! TEXT!! " * (i % 5 + 1) if i % 3 else "a quiet text of some words " * (i % 4 + 1), "en", "s0", 9) for i in range(60)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("ops"))
    frame(spark, corpus()).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(500 + i, int(i % 3 == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    pages = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "v", ""), (5, "w", "é" * 40), (None, "w", "same")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def run(spark, folder):
    def made(name):
        df = queries.QUERIES[name](spark, folder)
        return dict(df.dtypes), df.collect()

    return made


def by_row(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def test_op1(run):
    kinds, rows = run("op1_quality")
    assert kinds["held_out"] == "boolean" and kinds["score"] == "double" and kinds["predicted"] == "int"
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in corpus())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.doc_id >= 500 and r.held_out]
    assert held and all(r.predicted == int((r.doc_id - 500) % 3 == 0) for r in held)


def test_op1_without_labels(spark, folder, tmp_path):
    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1), (7, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {(r.score, r.predicted) for r in queries.op1_quality(spark, str(tmp_path)).collect()} == {(0.5, 0)}
    assert quality.SAMPLE > 0


def test_op2(run):
    kinds, rows = run("op2_secrets")
    assert [kinds[c] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")] == ["bigint"] * 3 + ["string"] * 2
    want = []
    for i, t, *_ in corpus():
        base = _plain_spans(t or "")
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        want.append((i, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(line.encode()).hexdigest()))
    assert by_row(rows, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == Counter(want)


def test_op3(run):
    kinds, rows = run("op3_simhash")
    assert (kinds["fingerprint"], kinds["n_near"], kinds["component_id"]) == ("string", "bigint", "bigint")
    docs = corpus()
    made = []
    for _, t, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in ([*zip(words, words[1:])] or [words] * bool(words))]
        made.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    u, near, least = Union(len(docs)), [0] * len(docs), {}
    for a in range(len(docs)):
        for b in range(a):
            if (made[a] ^ made[b]).bit_count() <= 6:
                u.join(a, b)
                near[a] += 1
                near[b] += 1
    for k, d in enumerate(docs):
        least[u.find(k)] = min(d[0], least.get(u.find(k), d[0]))
    want = Counter((d[0], f"{made[k]:016x}", near[k], least[u.find(k)]) for k, d in enumerate(docs))
    assert by_row(rows, "doc_id", "fingerprint", "n_near", "component_id") == want and any(f == "0" * 16 for _, f, *_ in want)


def test_op4(run):
    _, rows = run("op4_exact")
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[hashlib.sha256((t or "").translate(BLANK).encode()).hexdigest()].append((-len(t or ""), i))
    assert Counter((r.doc_id, r.text_sha256, r.group_size, r.keep_id) for r in rows) == Counter((i, h, len(g), min(g)[1]) for h, g in groups.items() for _, i in g)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(groups.keys()) and all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_op5(run):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    _, rows = run("op5_tokens")
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, *_ in corpus())
    assert by_row(rows, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_op6(run):
    kinds, rows = run("op6_licenses")
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    want = []
    for i, t, *_ in corpus():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min(at, default=(None,))[0], max(at, default=(None,))[0], ",".join(sorted({x for _, x in at}))))
    assert by_row(rows, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter(want)
    assert kinds["score"] == "double" and all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in rows)
    assert next(r.base_labels for r in rows if r.doc_id == 402) == "apache,cc-by,mit"


def test_op7(run):
    _, rows = run("op7_lines")
    assert sorted(map(tuple, rows), key=repr) == brute_lines(corpus())


def test_op8_and_op10_equal_their_sql(spark, folder, run):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cell = lambda v: repr(round(v, 6) if isinstance(v, float) else v)
    for name in ("op4_exact", "op8_mixing", "op10_warc"):
        kinds, rows = run(name)
        rel = duck.sql(queries.ORACLES[name])
        columns = sorted(kinds)
        assert sorted(rel.columns) == columns
        if name != "op4_exact":  # of repeated rows either may be the one that stays
            assert Counter(tuple(cell(r[c]) for c in columns) for r in rows) == Counter(tuple(map(cell, r)) for r in rel.select(", ".join(columns)).fetchall())
        assert len(rows) == len(rel.fetchall())
    kinds, rows = run("op10_warc")
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in rows if r.payload_bytes == 4) == Counter([(1, "response", None), (1, "revisit", 1), (2, "revisit", 1), (None, "revisit", 1)])
    assert {r.payload_digest for r in rows if r.page_id == 5} == {base64.b32encode(hashlib.sha1(("é" * 40).encode()).digest()).decode()}


def test_op9(run):
    _, rows = run("op9_decontam")
    for r in rows:
        text = " ".join((dict((i, t) for i, t, *_ in corpus())[r.doc_id] or "").translate(LOWER).split(" "))
        text = " ".join(text.split())
        found = sorted(k for k, item in ITEMS if item and text and _edit(item.encode(), text.encode()[:4000]) <= (0.06 * len(item) if len(item) >= 32 else 0))
        assert r.items == ",".join(map(str, found)) and r.n_items == len(found) and r.contaminated == bool(found), r.doc_id
    assert [r.doc_id for r in rows if r.contaminated] == [400] and np.isclose(next(r.best_distance for r in rows if r.doc_id == 400), 1)
