"""Near lines of ordinary length are linked."""

import os
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from scenewright.llm import lines

from .helpers import frame

DATA = os.environ.get("SCENEWRIGHT_DATA", "/root/testdata/sf0.001")


def test_one_edit_in_a_line_of_sixty_characters_stays_linked(spark):
    a = "the river runs past the old mill and on to the grey sea wall"
    b = a[:30] + "#" + a[31:]
    assert len(a) == 60 and lines.Line(a).similar(lines.Line(b))
    got = {r.doc_id: r.dropped for r in lines.line_report(spark, frame(spark, [(1, a, None, None, None), (2, b, None, None, None), (3, a.upper(), None, None, None)])).collect()}
    assert got == {1: "", 2: "0", 3: ""}


def test_bitmaps_keep_every_similar_pair():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcde ", k=rng.randint(1, 400))) for _ in range(60)]
    texts += [t[: (c := rng.randrange(len(t)))] + "#" * rng.randint(0, len(t) // 30 + 1) + t[c:] for t in texts]
    bits, sets = lines.bitmaps(texts), [lines.shingles(t) for t in texts]
    share, near = (1 - lines.THRESHOLD) / (1 + lines.THRESHOLD), 0
    for i in range(len(texts)):
        for j in range(i):
            differ = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            assert differ <= len(sets[i] ^ sets[j])
            if len(sets[i] & sets[j]) >= lines.THRESHOLD * len(sets[i] | sets[j]):
                near += 1
                assert differ <= share * (len(sets[i]) + len(sets[j])) + 1e-6
    assert near > 30


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_recall_on_real_lines_of_every_length():
    """Of the pairs of real lines, and of real lines with one edit, that are similar, at least nine tenths share a band in each class of length."""
    texts = pq.read_table(f"{DATA}/documents.parquet", columns=["text"]).column(0).to_pylist()
    real = sorted({x.decode() for t in texts if t for x in lines.split(t.encode()) if len(x) >= 20})
    rng = random.Random(3)
    by = defaultdict(list)
    for line in real:
        by[next(k for k, top in enumerate((60, 85, 200, 400, 10**9)) if len(line) < top)].append(line)
    assert len(by) == 5
    for k, own in by.items():
        own = rng.sample(own, min(len(own), 400))
        sets = [lines.shingles(x) for x in own]
        pairs = [(own[i], own[j]) for i in range(len(own)) for j in range(i) if len(sets[i] & sets[j]) >= lines.THRESHOLD * len(sets[i] | sets[j])]
        for line in own:
            made = line
            for _ in range(1 + len(line) // 100):
                c = rng.randrange(len(made))
                made = made[:c] + rng.choice(("", "#", "ab")) + made[c + 1 :]
            if made != line and lines.Line(line).similar(lines.Line(made)):
                pairs.append((line, made))
        left, right = lines.bands([a for a, _ in pairs]), lines.bands([b for _, b in pairs])
        hit = (left == right).any(1)
        assert len(pairs) > 50 and hit.mean() >= 0.9, (k, len(pairs), hit.mean())


def test_bands_are_sent_packed(monkeypatch):
    """No row for each band: at most one for each slice and ``SENT`` pairs, whatever the number of lines; the pairs are all there, each in its slice."""
    rng = random.Random(6)
    texts = ["\n".join("".join(rng.choices("abcdefgh ", k=60)) for _ in range(40)) for _ in range(50)]
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["text"])
    real = [x for t in texts for x in lines.split(t.encode())]
    want = {(b, lines._keys(x)[0]) for x, own in zip(real, lines.bands([x.decode() for x in real]).tolist()) for b in own}
    for sent in (1 << 20, 1 << 12):
        monkeypatch.setattr(lines, "SENT", sent)
        made = list(lines._send_bands(7)(iter([batch(texts[:20]), batch([]), batch([*texts[20:], None, "\n \n"])])))
        assert sum(b.num_rows for b in made) <= 7 * len(made) and len(made) <= 1 + len(want) // sent
        rows = [(s, tuple(p)) for b in made for s, x in zip(*(c.to_pylist() for c in b.columns)) for p in np.frombuffer(x, np.int64).reshape(-1, 2).tolist()]
        assert len(rows) == len(want) and {p for _, p in rows} == want
        assert len({s for s, _ in rows}) == 7 and len({(s, p[0]) for s, p in rows}) == len({p[0] for _, p in rows})
    assert list(lines._send_bands(7)(iter([batch([]), batch([None, " "])]))) == []


@pytest.mark.parametrize("held", [1 << 21, 64, 1])
def test_slices_of_any_size_give_their_buckets_in_order(monkeypatch, held):
    """A slice beyond what is held is merged from a file; batches end anywhere; a pair that came twice is there once."""
    monkeypatch.setattr(lines, "HELD", held)
    rng = np.random.default_rng(4)
    pairs = np.stack([rng.integers(-40, 40, 600) << 55, rng.integers(-200, 200, 600)], 1)
    pairs[:90, 0] = 5  # a hot bucket
    pairs = np.concatenate([pairs, pairs[::3], [[1 << 61, 1], [7, 7], [7, 7]]])
    packed = pa.Table.from_batches([lines._packed(pairs[a : a + 100].copy(), 5) for a in range(0, len(pairs), 100)]).sort_by("slice")
    want = {}
    for b, k in pairs.tolist():
        want.setdefault(b, set()).add(k)
    for step in (1, 7, 1000):
        got = {}
        last = None
        for part in lines._in_order(iter(packed.to_batches(max_chunksize=step))):
            for b, k in zip(*(c.to_pylist() for c in part.columns)):
                assert b == last or b not in got
                got.setdefault(b, []).append(k)
                last = b
        assert all(ks == sorted(set(ks)) for ks in got.values())
        assert {b: set(ks) for b, ks in got.items() if len(ks) > 1} == {b: ks for b, ks in want.items() if len(ks) > 1}
    assert list(lines._in_order(iter([]))) == []
