"""Operators on pairs and groups, held against brute force."""

import base64
import hashlib
import io
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from scenewright.llm import bloom, components, exact, lines, mixing, simhash, warc
from scenewright.llm.queries import ORACLES

from .helpers import DOCS, awkward, clashing, frame, prose


class Union:
    def __init__(self, n):
        self.p = list(range(n))

    def find(self, x):
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def brute_near(rows):
    f = [simhash.fingerprint((t or "").encode()) for _, t, *_ in rows]
    u = Union(len(rows))
    near = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= simhash.RADIUS:
                u.join(i, j)
                near[i] += 1
                near[j] += 1
    least = {}
    for i, r in enumerate(rows):
        k = u.find(i)
        least[k] = min((x for x in (least.get(k), r[0]) if x is not None), default=None)
    return sorted(((r[0], f[i] - (1 << 64) * (f[i] >> 63), near[i], least[u.find(i)]) for i, r in enumerate(rows)), key=repr)


def test_simhash_links_equal_brute_force(spark):
    rng = random.Random(1)
    rows = awkward()
    base = prose(rng, 60)
    for k in range(60):
        w = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(["aa", "bb"])
        rows.append((100 + k, " ".join(w), None, None, None))
    df = clashing(frame(spark, rows), "fp", "component_id", "near_gone")
    got = sorted(map(tuple, simhash.near_duplicates(spark, df).collect()), key=repr)
    assert got == brute_near(rows)
    kept = simhash.keep_first(spark, df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == brute_kept(rows)


def brute_kept(rows):
    """The ids of the one row of each component that stays."""
    f = [simhash.fingerprint((t or "").encode()) for _, t, *_ in rows]
    u, members = Union(len(rows)), defaultdict(list)
    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= simhash.RADIUS:
                u.join(i, j)
    for i, r in enumerate(rows):
        members[u.find(i)].append(r[0])
    return Counter(min((x for x in m if x is not None), default=None) for m in members.values())


def test_no_text_goes_because_of_its_id(spark):
    texts = ["alpha beta gamma delta " * 3, "other words stand in this one", "other words stand in this one", "zz top", "zz top", "zz top", "lone text without an id"]
    rows = [(i, t, None, None, None) for i, t in zip((5, 3, 5, 7, 7, None, None), texts)]
    got = Counter((r.doc_id, r.text) for r in simhash.keep_first(spark, frame(spark, rows)).collect())
    assert got == Counter([(5, texts[0]), (3, texts[1]), (7, texts[3]), (None, texts[6])])
    named = spark.createDataFrame([("b", texts[1]), ("a", texts[2]), ("c", texts[0])], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, named).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert {r.doc_id for r in simhash.keep_first(spark, named).collect()} == {"a", "c"}


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark, frame(spark, [])).count() == 0


def test_fingerprint_by_definition():
    import xxhash

    text = "Ab\x0bcD é\x85x  ab"
    words = ["ab", "cd", "é\x85x", "ab"]
    h = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in zip(words, words[1:])]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"One") == xxhash.xxh64_intdigest(b"one", 42) and simhash.fingerprint(b" \t") == 0


def test_every_pair_within_the_radius_collides():
    rng = np.random.default_rng(0)
    for bits in range(1, 7):
        for _ in range(300):
            diff = np.uint64(sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
            first = [t for t in range(len(simhash.MASKS)) if diff & simhash.MASKS[t] == 0]
            assert first
            hits = [t for t in range(len(simhash.MASKS)) if simhash.first_table(np.array([diff]), t)[0]]
            assert hits == first[:1]
    assert all(int(m).bit_count() == 32 for m in simhash.MASKS)


@pytest.mark.parametrize("size", [1, 3, 50, 4096])
def test_buckets_in_blocks_give_all_links(monkeypatch, size):
    """A bucket that is cut into blocks gives the counts and edges of the whole."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = np.unique(np.array([base ^ int(sum(1 << int(b) for b in rng.choice(32, rng.integers(0, 5)))) for _ in range(90)], np.uint64))
    monkeypatch.setattr(simhash, "BLOCK", size)
    near, edges = Counter(), []
    number = {int(f): i for i, f in enumerate(fps)}

    def take(batch):
        what, k, t, block, a, b = (c.to_pylist() for c in batch.columns)
        hot = []
        for row in zip(what, k, t, block, a, b):
            if row[0] == 0:
                near[row[4] % (1 << 64)] += row[5]
            elif row[0] == 1:
                edges.append((row[4] % (1 << 64), row[5] % (1 << 64)))
            else:
                hot.append(row[1:])
        return hot

    def batches(rows, kinds, step=7):
        for s in range(0, len(rows), step):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + step]), kinds)], [str(i) for i in range(len(kinds))])

    for t in range(len(simhash.MASKS)):
        keys = simhash._squeeze(fps & simhash.MASKS[t])
        rows = sorted((int(k), t, int(f.view(np.int64)), 1) for k, f in zip(keys, fps))
        hot = [h for b in simhash._buckets(batches(rows, [pa.int32(), pa.int16(), pa.int64(), pa.int64()])) for h in take(b)]
        total = Counter()
        for k, tt, block, _, _ in hot:
            total[(k, tt)] = max(total[(k, tt)], block)
        spread = sorted((k, tt, min(block, o), max(block, o), block, a, b) for k, tt, block, a, b in hot for o in range(1, total[(k, tt)] + 1))
        for b in simhash._block_pairs(batches(spread, [pa.int32(), pa.int16(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])):
            assert not take(b)
    u, want = Union(len(fps)), Counter()
    v = Union(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 6:
                u.join(i, j)
                want[int(fps[i])] += 1
                want[int(fps[j])] += 1
    for a, b in edges:
        v.join(number[a], number[b])
    assert near == want and [u.find(i) for i in range(len(fps))] == [v.find(i) for i in range(len(fps))]


def test_components_equal_brute_force(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)] + [(5, 5)]
    got = {r.node: r.root for r in components.connected_components(spark, spark.createDataFrame(edges + edges[:50] + [(None, 3)], "a long, b long")).collect()}
    u = Union(3000)
    for a, b in edges:
        u.join(a, b)
    assert got == {n: u.find(n) for e in edges if e[0] != e[1] for n in e}
    assert components.connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups_equal_brute_force(spark):
    rows = awkward()
    df = clashing(frame(spark, rows), "digest", "rid", "kept")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        t = t or ""
        h = hashlib.sha256(t.translate({c: None for c in (32, 9, 10, 11, 12, 13)}).encode()).digest()
        groups[h].append((-len(t), i is None, i if i is not None else 0, i))
    for cells in (1 << 12, 64, 8):  # down to a filter that lets nothing through
        got = exact.exact_groups(spark, df, max_cells=cells).collect()
        assert len(got) == len(rows)
        for h, members in groups.items():
            own = [r for r in got if bytes(r.digest) == h]
            assert len(own) == len(members) and {r.group_size for r in own} == {len(members)}
            assert {r.keep_id for r in own} == {min(members)[3]}
            assert [r.doc_id for r in own if r.kept] == [min(members)[3]]
    assert exact.exact_groups(spark, frame(spark, [])).count() == 0


def test_only_possible_repeats_are_shuffled(spark):
    rows = [(i, f"text number {i}", None, None, None) for i in range(3000)] + [(5000 + i, "same", None, None, None) for i in range(5)]
    table = exact.digests(frame(spark, rows)).cache()
    digests = table.select("digest").toArrow().column(0).combine_chunks()
    for slices, size in ((1, 1 << 16), (8, 1 << 13)):
        held = exact.twice_hit(table.repartition(5), slices, size)
        which, at = exact.cells(digests, slices, size)
        maybe = ((held[which, at >> 3] >> (at & 7)) & 1).all(0)
        assert 5 <= maybe.sum() < 90
        hits = Counter(c for k, row in zip(which.tolist(), at.T.tolist()) for c in {(k, x) for x in row})
        assert {(k, i) for k in range(slices) for i in np.flatnonzero(np.unpackbits(held[k], bitorder="little")).tolist()} == {c for c, n in hits.items() if n > 1}


@pytest.mark.parametrize("slice_bits", [1 << 22, 1 << 9])
def test_key_filter_holds_all_its_keys(spark, monkeypatch, slice_bits):
    monkeypatch.setattr(bloom, "SLICE_BITS", slice_bits)
    rng = np.random.default_rng(2)
    keys = rng.integers(-(1 << 63), 1 << 63, 700)
    test = bloom.key_filter(spark, spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert test(keys).all() and test(rng.integers(-(1 << 63), 1 << 63, 5000)).mean() < 0.02
    assert not bloom.key_filter(spark, spark.createDataFrame([], "key long"))(keys).any()


def brute_lines(rows):
    docs = {(i, t) for i, t, *_ in rows}
    occ, number = [], {}
    for i, t in docs:
        for no, line in enumerate(lines.split((t or "").encode())):
            if line:
                number.setdefault(line, len(number))
                occ.append((i is None, i if i is not None else 0, 0, no, i, t, number[line]))
    sets = [lines.shingles(x.decode()) for x in number]
    u = Union(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= lines.THRESHOLD * (len(sets[a]) + len(sets[b]) - both):
                u.join(a, b)
    first = {}
    for o in sorted(occ, key=lambda o: o[:4]):
        first.setdefault(u.find(o[6]), o)
    gone = defaultdict(list)
    n = Counter()
    for o in occ:
        n[(o[4], o[5])] += 1
        if first[u.find(o[6])] != o:
            gone[(o[4], o[5])].append(o[3])
    return sorted(((i, n[(i, t)], len(gone[(i, t)]), ",".join(map(str, sorted(gone[(i, t)])))) for i, t in docs), key=repr)


def line_rows():
    rng = random.Random(12)
    rows = awkward()
    long = " ".join("".join(rng.choices("abcdefghijkl", k=6)) for _ in range(60))
    for k in range(40):
        w = long.split(" ")
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "edited"
        rows.append((200 + k, f"own line {rng.random()}\n" + " ".join(w) + "\n\n}\n", None, "s0", 7))
    return rows


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    df = clashing(frame(spark, rows), "line_doc", "d", "x", "gone", "k", "band")
    got = sorted(map(tuple, lines.line_report(spark, df).collect()), key=repr)
    want = brute_lines(rows)
    assert got == want
    out = lines.dedup_lines(spark, df)
    assert out.columns == df.columns
    rule = {(r[0],): r for r in want}
    for r in out.collect():
        if r.doc_id is not None:
            source = next(t for i, t, *_ in rows if i == r.doc_id)
            drop = {int(x) for x in rule[(r.doc_id,)][3].split(",") if x}
            text = source if not drop else "\n".join(x for k, x in enumerate(source.split("\n")) if k not in drop)
            assert r.text == text and (not drop or r.n_chars == len(text))
    lost = {r[0] for r in want if r[1] and r[1] == r[2]}
    left = [r.doc_id for r in out.collect()]
    assert set(left) - {None} == {r[0] for r in rows} - lost - {None}
    assert left.count(None) == 1  # the one without a text; the copy of another's text lost all its lines
    assert lines.line_report(spark, frame(spark, [])).count() == 0 and lines.dedup_lines(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [2, 4096])
def test_line_buckets_in_parts_connect_the_same(spark, monkeypatch, block):
    """Buckets cut into parts, and batches that end anywhere, give every component."""
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(5)
    bases = ["".join(rng.choices("abcdefghij", k=300)) for _ in range(3)]
    rows = []
    for i in range(45):
        t = list(bases[i % 3])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(300)] = "#"
        rows.append((i, "".join(t), None, None, None))
    # one bucket with all lines: the leader's component is a third of them
    monkeypatch.setattr(lines, "_bands", lambda h, own, n: np.zeros((n, lines.BANDS), np.int64))
    keys = sorted(lines._keys(r[1].encode())[0] for r in rows)
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 2 * len(keys), pa.int64()), pa.array(sorted(keys * 2), pa.int64())], ["band", "k"])
    whole = {r for b in lines._leaders(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))}
    for step in (1, 4, 11):
        cut = [batch.slice(s, step) for s in range(0, batch.num_rows, step)]
        assert {r for b in lines._leaders(iter(cut)) for r in zip(*(c.to_pylist() for c in b.columns))} == whole
    assert {k for _, _, k in whole} == set(keys) and {lead for lead, _, _ in whole} == {keys[0]}
    assert all(n <= block + 1 for n in Counter(p for _, p, _ in whole).values())
    got = {r.node: r.root for r in lines.line_classes(spark, frame(spark, rows)).collect()}
    u, sets, key = Union(45), [lines.shingles(r[1]) for r in rows], [lines._keys(r[1].encode())[0] for r in rows]
    for i in range(45):
        for j in range(i):
            if len(sets[i] & sets[j]) >= lines.THRESHOLD * len(sets[i] | sets[j]):
                u.join(i, j)
    classes = defaultdict(set)
    for i in range(45):
        classes[u.find(i)].add(key[i])
    want = {k: min(c) for c in classes.values() if len(c) > 1 for k in c}
    assert got == want and len(set(want.values())) >= 3


def test_similarity_is_exact():
    rng = random.Random(8)
    texts = ["", "a", "abcd", "abcde", "ab\u2028cd", "\U0001f600" * 7, "x" * 40, "x" * 90]
    texts += ["".join(rng.choices("ab \u00e9\u4e2d" if k % 3 == 0 else "ab ", k=rng.randint(1, 60))) for k in range(60)]
    for x in texts:
        for y in texts:
            a, b = lines.shingles(x), lines.shingles(y)
            assert lines.Line(x).similar(lines.Line(y)) == (len(a & b) >= lines.THRESHOLD * len(a | b)), (x, y)


def test_bands_have_a_high_recall():
    rng = random.Random(7)
    found = total = 0
    for k in range(600):
        a = "".join(rng.choices("abcdefghijklmnop ", k=200 if k % 2 else 120))
        b = list(a)
        for _ in range(2):
            b[rng.randrange(200)] = "#"
        b = "".join(b)
        x, y = lines.shingles(a), lines.shingles(b)
        if len(x & y) >= lines.THRESHOLD * len(x | y):
            total += 1
            m = lines.bands([a, b])
            found += (m[0] == m[1]).any()
    assert total > 400 and found >= 0.97 * total


def test_mixing_equals_its_sql(spark):
    rng = random.Random(4)
    rows = awkward() + [(300 + i, " ".join(["w"] * rng.randint(0, 50)), None, rng.choice(["s0", "s0", "s2", "é"]), 0) for i in range(200)]
    df = clashing(frame(spark, rows), "size", "rank", "pid", "target")
    got = mixing.mix(spark, df).collect()
    docs = pa.table({"doc_id": [r[0] for r in rows], "source": [r[3] for r in rows], "text": [r[1] for r in rows]})
    want = duckdb.sql(mixing.MIX_SQL.format(docs="docs")).fetchall()
    key = lambda r: tuple(repr(round(x, 6) if isinstance(x, float) else x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert docs.num_rows == len(got)
    by = {}
    for r, row in zip(got, got):
        by.setdefault((r.source_size, r.target), []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum(t for _, t in by) - total) < 1e-6 * max(1, total)
    for (size, target), members in by.items():
        assert target <= 3 * size + 1e-9
        assert abs(sum(r.taken for r in members) - target) <= 2 * max(r.size for r in members) + 1e-9
        assert all(r.taken <= 3 * r.size for r in members)
    assert mixing.mix(spark, frame(spark, [])).count() == 0


def test_the_mix_has_each_row_as_often_as_it_is_taken(spark):
    rng = random.Random(14)
    rows = awkward() + [(300 + i % 90, " ".join(["w"] * rng.randint(0, 9)), None, rng.choice(["s0", "s1", "s2"]), i) for i in range(200)]
    df = clashing(frame(spark, rows), "copy", "mix_row", "copies", "tie")
    made = mixing.mixed(spark, df)
    assert made.columns == [*df.columns, "copy_"]
    want = Counter()
    for r in mixing.mix(spark, df).collect():
        want[(r.doc_id, r.size)] += r.copies
    got = made.collect()
    assert Counter((r.doc_id, len((r.text or "").split())) for r in got) == +want
    assert {(r.doc_id, r.text, r.source, r.n_chars) for r in got} <= {(i, t, c, n) for i, t, _, c, n in rows}
    assert mixing.mixed(spark, frame(spark, [])).count() == 0


def test_mixing_targets_are_capped(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 5), (None, 0)], "source string, size long")
    got = {r.source: r for r in mixing.targets(sizes).collect()}
    assert got["b"].target == 30 and got["c"].target == 15 and abs(got["a"].target - 970) < 1e-9 and got[None].target == 0


def test_mixing_reruns_agree_whatever_the_partitions(spark):
    df = frame(spark, [(i, "w " * (i % 17), None, "s", 0) for i in range(300)])
    a = sorted(map(tuple, mixing.mix(spark, df.repartition(1)).collect()))
    assert a == sorted(map(tuple, mixing.mix(spark, df.repartition(7)).collect()))


def test_warc_round_trip(spark):
    rng = random.Random(2)
    html = ["<p>same</p>", "", None, "é" * 3000, "\r\n\r\nWARC/1.1\r\n"] + [prose(rng, 500) for _ in range(30)]
    rows = [(i, rng.choice(["http://a/é b\r\nX: y", None, "http://b"]), html[i % len(html)]) for i in range(90)] + [(3, "http://twice", "<p>same</p>"), (None, None, "<p>same</p>"), (0, "u", "<p>same</p>"), (0, None, "<p>same</p>"), (0, "u", "<p>same</p>")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "sha", "first_id", "d_id", "bundle")
    got = warc.round_trip(spark, df).collect()
    by = defaultdict(list)
    for i, _, h in rows:
        by[(h or "").encode()].append(i)
    want = []
    for p, ids in by.items():
        first, *rest = sorted(ids, key=lambda i: (i is None, i))
        line = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        want += [(first, *line, "response", None)] + [(i, *line, "revisit", first) for i in rest]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    named = spark.createDataFrame([("b/é", None, "x"), ("a>", None, "x"), ("a>", None, "x")], "page_id string, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark, named).collect()) == [("a>", "response", None), ("a>", "revisit", "a>"), ("b/é", "revisit", "a>")]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, empty).count() == 0


class _Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_bundles_are_seekable_and_plain_zstandard():
    import zstandard

    out = io.BytesIO()
    keep = out.close
    out.close = lambda: None
    w = warc.BundleWriter(out, frame=2000)
    records = [warc.record(i, f"http://x/{i}", b"payload %d " % i * (i + 1), None, False) for i in range(60)]
    where = [w.add(r) for r in records]
    w.close()
    data = out.getvalue()
    keep()
    r = warc.BundleReader(_Memory(data))
    assert len(r.frames) > 5
    for rec, (f, at) in zip(records, where):
        part = r.frame(f)
        assert part[at : at + len(rec)] == rec
        fields, block = warc.parse(part, at)
        assert fields["WARC-Payload-Digest"][5:] == warc.digest(block)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(records)
    with pytest.raises(ValueError):
        warc.BundleReader(_Memory(data[:-1]))


def test_damaged_payload_is_noticed(spark, tmp_path):
    data = warc.record(1, None, b"abc", None, False).replace(b"abc", b"abd")
    fields, block = warc.parse(data, 0)
    assert warc.digest(block) != fields["WARC-Payload-Digest"][5:]


def test_stray_bundles_are_swept(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(spark, spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"), folder)
    (tmp_path / "w" / "left-over.warc.zst").write_bytes(b"x")
    assert warc.sweep(index, folder) == 1 and warc.read_archives(index, folder).count() == 1


def test_oracles_name_known_queries():
    from scenewright.llm.queries import QUERIES

    assert set(ORACLES) <= set(QUERIES) and {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}
    assert DOCS
