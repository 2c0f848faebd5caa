"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference: the prefixes of the labelled credentials of one format are the states of a tree. A state's ways on are
single characters where the examples agree, and otherwise the smallest class of characters that the examples leave as likely (``_choose``).
Where most examples go on, it is decided first; a state is merged into the one that explains its rests best, if their next characters and
ends don't differ significantly at any depth (Hoeffding's bound, whose level is chosen by the likelihood of examples kept back). That keeps literal prefixes and fixed lengths,
and turns parts of free length into loops.

Candidates are runs of credential characters and their parts between any of ``=/.-_``; each is scored by its likelihood under
every format against that under ordinary words and identifiers. The fixed patterns' values get the same score. No length is set: the shortest string that an
automaton accepts bounds what it is tried on. Everything is a function of one row, so a scan has no shuffle.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, pick, small

#: The fixed kinds in the order in which spans with one start are listed; learned ones come last.
KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_PAIR_MARKS = re.compile(rb"[:=]")

#: A candidate is a secret if its log-likelihood ratio to ordinary words is above this ...
LEAST_RATIO = 10.0
#: ... and its mean log-likelihood a character isn't under the least of the labelled ones by more than this.
SLACK = 0.15

_ALNUM = string.ascii_letters + string.digits
_CHARS = _ALNUM + "+/_.=-"
_SYMBOLS = len(_CHARS)
#: What ends a part of a credential, and is never in a class.
_APART = ".="

_CLASS = np.full(256, 255, np.uint8)
_CLASS[[ord(c) for c in _CHARS]] = np.arange(_SYMBOLS)
_IS_RUN = _CLASS != 255
#: What may glue a credential to something else.
_IS_GLUE = np.isin(np.arange(256), np.frombuffer(b"=/.-_", np.uint8))
_IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))

_D, _L, _U = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Classes of characters, from small to large.
_KINDS_OF = [frozenset(x) for x in (_D, "abcdef" + _D, "ABCDEF" + _D, "abcdefABCDEF" + _D, _L, _U, _L + _D, _U + _D, _L + _U, _ALNUM, _ALNUM + "-_", _ALNUM + "+/", _ALNUM + "+/-_")]
#: Kinds of characters whose shares are compared besides those of single characters; the last is the end.
_GROUPS = ("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", _D, *"+/_.=-")
_SHARE = np.zeros((_SYMBOLS + 1, len(_GROUPS)))
for _k, _g in enumerate(_GROUPS):
    _SHARE[[_CHARS.index(c) for c in _g], _k] = 1


@dataclass(frozen=True)
class Automaton:
    """step[state, character] is the next state, cost the log-probability; the last state is the sink."""

    step: np.ndarray
    cost: np.ndarray
    end: np.ndarray
    least: float
    #: Length of the shortest string that ends outside the sink with a chance.
    shortest: int = 0


def _choose(seen: str, n: int) -> frozenset[str]:
    """The class of n characters: the smallest that holds them, unless a larger one would give only its members with a chance over 1 %."""
    for c in [frozenset(seen), *_KINDS_OF] if len(set(seen)) == 1 else _KINDS_OF:
        if c.issuperset(seen) and all((len(c) / len(d)) ** n <= 0.01 for d in _KINDS_OF if d > c):
            return c
    return _KINDS_OF[-1]


def infer(examples: list[str], alpha: float = 1e-3, floor: float = -9.0) -> Automaton:
    """A probabilistic automaton of one format. No example: an automaton that only has the sink."""
    width = max(map(len, examples), default=0) + 1
    text = np.full((len(examples), 2 * width), _SYMBOLS + 1, np.int64)  # characters, the end, then nothing
    for row, e in zip(text, examples):
        row[: len(e)] = _CLASS[np.frombuffer(e.encode(), np.uint8)]
        row[len(e)] = _SYMBOLS
    bound = np.sqrt(0.5 * np.log(2 / alpha))

    def counts(at: np.ndarray) -> np.ndarray:
        """How often each character, or the end, comes at each depth after the places (example, offset); before that, how often so many parts follow."""
        rest = text[at[:, :1], at[:, 1:] + np.arange(width)]
        parts = np.minimum((rest == _CHARS.index(".")).sum(1, keepdims=True), 9)
        flat = np.bincount((np.arange(width + 1) * (_SYMBOLS + 2) + np.hstack([parts, rest])).ravel(), minlength=(width + 1) * (_SYMBOLS + 2))
        return flat.reshape(width + 1, -1)[:, :-1].astype(float)

    def compatible(p: np.ndarray, q: np.ndarray) -> bool:
        depth = 0
        for step in (2, 4, 16, width):  # most differ at once
            x, y = p[depth : depth + step], q[depth : depth + step]
            n, m = x.sum(1), y.sum(1)
            both = (n > 0) & (m > 0)
            if both.any():
                n, m, x, y = n[both, None], m[both, None], x[both], y[both]
                far = bound * (n**-0.5 + m**-0.5)
                if (abs(x / n - y / m) > far).any() or (abs(x @ _SHARE / n - y @ _SHARE / m) > far).any():
                    return False
            depth += step
        n, m = p[0].sum(), q[0].sum()  # and the lengths of the rests, by their cumulative shares
        return not (abs(np.cumsum(p[1:, _SYMBOLS]) / n - np.cumsum(q[1:, _SYMBOLS]) / m) > bound * (n**-0.5 + m**-0.5)).any()

    def explains(p: np.ndarray, q: np.ndarray) -> float:
        at = np.nonzero(q)
        return float((q[at] * np.log((p[at] + 0.01) / (p.sum(1)[at[0]] + 0.01 * (_SYMBOLS + 1)))).sum())

    number = {c: k for k, c in enumerate(_CHARS)}
    root = np.stack([np.arange(len(examples)), np.zeros(len(examples), np.int64)], 1)
    seen, ways = ([counts(root)], [{}]) if examples else ([], [])  # of each state: its counts, and the next state of each class
    queue = [(0, root)] if examples else []
    waiting: dict[tuple[int, str], list[np.ndarray]] = {}  # places whose next character has no way yet, the class ones together
    while queue or waiting:
        while queue:
            s, at = queue.pop()
            following = text[at[:, 0], at[:, 1]]
            for c in np.unique(following[following < _SYMBOLS]).tolist():
                go, char = at[following == c], _CHARS[c]
                k = next((k for kind, k in ways[s].items() if char in kind), None)
                if k is None:
                    waiting.setdefault((s, char if char in _APART else ""), []).append(go)
                else:
                    seen[k] += counts(go + [0, 1])
                    queue.append((k, go + [0, 1]))
        if not waiting:
            break
        s, apart = max(waiting, key=lambda x: (sum(map(len, waiting[x])), -x[0]))  # the decision with most evidence
        at = np.concatenate(waiting.pop((s, apart)))
        chars = "".join(_CHARS[c] for c in np.unique(text[at[:, 0], at[:, 1]]))
        made = counts(at + [0, 1])
        old = next((kind for kind in ways[s] if not kind & {*_APART}), None)
        if not apart and old:  # a class gets wider
            k = ways[s].pop(old)
            ways[s][next(x for x in _KINDS_OF if x >= old | {*chars})] = k
            seen[k] += made
        else:
            like = [(explains(p, made), -k) for k, p in enumerate(seen) if compatible(p, made)]
            k = -max(like)[1] if like else len(seen)
            if like:
                seen[k] += made
            else:
                seen.append(made)
                ways.append({})
            ways[s][frozenset(apart) if apart else _choose(chars, len(at))] = k
        queue.append((k, at + [0, 1]))
    sink = len(seen)
    step = np.full((sink + 1, _SYMBOLS), sink, np.int32)
    used, ends = np.zeros((sink + 1, _SYMBOLS)), np.zeros(sink + 1)
    for s, own in enumerate(ways):
        for kind, k in own.items():
            step[s, [number[c] for c in kind]] = k
    for row, e in zip(text, examples):
        s = 0
        for c in row[: len(e)].tolist():
            used[s, c] += 1
            s = step[s, c]
        ends[s] += 1
    cost, end = np.full((sink + 1, _SYMBOLS), floor), np.full(sink + 1, floor)
    for s, own in enumerate(ways):
        total = used[s].sum() + ends[s] + 0.1 * (len(own) + 1)
        for kind in own:
            c = [number[x] for x in kind]
            cost[s, c] = np.log((used[s, c].sum() + 0.1) / total / len(c))
        if ends[s]:
            end[s] = np.log((ends[s] + 0.1) / total)
    shortest, reached = 0, {0}
    while reached and not any(ends[s] for s in reached):
        reached = {int(k) for s in reached for k in step[s] if k != sink}
        shortest += 1
    made = Automaton(step, cost, end, 0.0)
    least = min((x / (len(e) + 1) for x, e in zip(likelihood(made, examples), examples)), default=0.0)
    return Automaton(step, cost, end, least, shortest)


def infer_best(examples: list[str], levels: tuple[float, ...] = (1e-2, 1e-4)) -> Automaton:
    """Inference at the level of significance under which every fourth example, kept back, is likeliest; then from all."""
    kept, back = [e for k, e in enumerate(examples) if k % 4], examples[::4]
    best = max(levels, key=lambda a: float(likelihood(infer(kept, a), back).sum()))
    return infer(examples, best)


def likelihood(a: Automaton, texts: list[str]) -> np.ndarray:
    joined = "".join(texts).encode()
    size = np.array([len(t) for t in texts], np.int64)
    return _run(a, _CLASS[np.frombuffer(joined, np.uint8)], np.cumsum(size) - size, size)


def _run(a: Automaton, kinds: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Log-likelihoods of the runs of ``kinds`` at ``start``, all stepped together."""
    order = np.argsort(-length, kind="stable")
    start, left = start[order], length[order]
    state, total = np.zeros(len(order), np.int32), np.zeros(len(order))
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k))  # those longer than k come first
        c = kinds[start[:live] + k]
        total[:live] += a.cost[state[:live], c]
        state[:live] = a.step[state[:live], c]
    out = np.empty(len(order))
    out[order] = total + a.end[state]
    return out


def _parts(a: Automaton, kinds: np.ndarray, glue: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, log-likelihood) of the parts that ``a`` accepts, from the starts to any glue or the run's end. A start ends in the sink."""
    sink = len(a.step) - 1
    long = stop - start >= max(1, a.shortest)
    at, end = start[long], stop[long]
    state, total = np.zeros(len(at), np.int32), np.zeros(len(at))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    k = 0
    while len(at):
        c = kinds[at + k]
        total = total + a.cost[state, c]
        state = a.step[state, c]
        live = state != sink
        at, end, state, total = at[live], end[live], state[live], total[live]
        k += 1
        if k >= a.shortest:
            over = at + k == end
            close = over.copy()
            close[~over] = glue[at[~over] + k]
            like = total[close] + a.end[state[close]]
            good = like / (k + 1) >= a.least - SLACK
            found.append((at[close][good], at[close][good] + k, like[good]))
        go = at + k < end
        at, end, state, total = at[go], end[go], state[go], total[go]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


_WORDS_OF = """
    the and for with that this from have not are was were will would there their which about other after before first people water over
    time year work part place where through between under never also great little house world still small found answer study learn should
    get set user account name value file path list index count item data type class object string number error message request response
    server client config option default method function return public static final void import package module service factory builder manager
    handler controller repository identifier context session token key hash cache buffer stream reader writer parser encoder filter mapper
    http https www com org net html json xml url uri api app test main util core base abstract interface implementation wrapper servlet
    create update delete insert select find load save read write open close start stop run init build make parse format check validate
    is has to by of in on at id max min size length width height color image text line page view model form input output version release
"""


def labelled(seed: int = 11, each: int = 240) -> dict[str, list[str]]:
    """Labelled credentials in publicly documented formats, made from a seed; and, as ``words``, what is none: words, numbers, paths and identifiers."""
    rng = random.Random(seed)
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    url, hexa = _ALNUM + "-_", "0123456789abcdef"
    made = {
        "personal": lambda: rng.choice(("ghp_", "ghp_", "gho_", "ghs_")) + some(_ALNUM, 36),
        "chat": lambda: f"xoxb-{some(_D, rng.choice((11, 12, 13)))}-{some(_D, rng.choice((12, 13)))}-{some(_ALNUM, 24)}",
        "payment": lambda: rng.choice(("sk_live_", "rk_live_")) + some(_ALNUM, 24),
        "maps": lambda: "AIza" + some(url, 35),
        "registry": lambda: "npm_" + some(_ALNUM, 36),
        "merge": lambda: "glpat-" + some(url, 20),
        "hub": lambda: "hf_" + some(_L + _U, 34),
        "shop": lambda: "shpat_" + some(hexa, 32),
        "cloud": lambda: "dop_v1_" + some(hexa, 64),
        "mail": lambda: f"SG.{some(url, 22)}.{some(url, 43)}",
        "web": lambda: f"eyJ{some(url, rng.randint(14, 60))}.eyJ{some(url, rng.randint(20, 120))}.{some(url, rng.choice((43, 43, 64, 86)))}",
        "access": lambda: "AKIA" + some(_U + "234567", 16),
        "key": lambda: some(_ALNUM + "+/", 40),
        "digest": lambda: some(hexa, rng.choice((32, 40, 64))),
    }
    vocabulary = _WORDS_OF.split()

    def word() -> str:
        w = rng.choice(vocabulary)
        return rng.choice((w, w, w, w + rng.choice(("s", "ed", "ing", "er")), w.capitalize(), w.upper(), some(_D, rng.randint(1, 20))))

    def plain() -> str:
        many = rng.randint(1, 7)
        joined = rng.choice(("", "_", "-", ".", "/"))
        parts = [word() if joined else rng.choice(vocabulary).capitalize() for _ in range(many)]
        if not joined and rng.random() < 0.7:
            parts[0] = parts[0].lower()
        return rng.choice(("", "", "", "/", "__", "--", "...")) + joined.join(parts) + rng.choice(("", "", "", ".", "...", "=" * rng.randint(1, 20), "-" * rng.randint(1, 20)))

    return {k: [f() for _ in range(each)] for k, f in made.items()} | {"words": [rng.choice((plain, word))() for _ in range(30 * each)]}


@lru_cache(maxsize=1)
def default_automata() -> tuple[tuple[Automaton, ...], Automaton]:
    """The automata of the formats of ``labelled()``, and that of ordinary words."""
    examples = labelled()
    words = examples.pop("words")
    return tuple(infer_best(x) for x in examples.values()), background(words)


def background(words: list[str]) -> Automaton:
    """Ordinary words as a first-order automaton: the state is the character before."""
    seen = np.full((_SYMBOLS + 1, _SYMBOLS + 1), 0.5)
    for w in words:
        c = [_SYMBOLS, *_CLASS[np.frombuffer(w.encode(), np.uint8)].tolist(), _SYMBOLS]
        np.add.at(seen, (c[:-1], c[1:]), 1)
    p = np.log(seen / seen.sum(1, keepdims=True))
    turn = [_SYMBOLS, *range(_SYMBOLS)]  # the start is state 0
    step = np.tile(np.arange(1, _SYMBOLS + 1, dtype=np.int32), (_SYMBOLS + 1, 1))
    return Automaton(step, p[turn][:, :_SYMBOLS], p[turn][:, _SYMBOLS], 0.0)


def _runs(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], member.view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def fixed_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the fixed patterns, leftmost and without overlap within a kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def ratios(values: list[str], automata: tuple[tuple[Automaton, ...], Automaton]) -> np.ndarray:
    """The log-likelihood ratio of each value, under its best format, to ordinary words."""
    formats, plain = automata
    if not values:
        return np.zeros(0)
    return np.max([likelihood(a, values) for a in formats], 0) - likelihood(plain, values)


def _learned(raw: np.ndarray, automata: tuple[tuple[Automaton, ...], Automaton]) -> list[tuple[int, int, float]]:
    """(start, end, ratio) of the likeliest accepted parts that don't overlap."""
    formats, plain = automata
    start, stop = _runs(_IS_RUN[raw], max(1, min(a.shortest for a in formats)))
    if not len(start):
        return []
    kinds, glue = _CLASS[raw], _IS_GLUE[raw]
    after = np.flatnonzero(glue[:-1] & _IS_RUN[raw[1:]]) + 1
    heads = np.concatenate([start, after])
    own = np.searchsorted(start, heads, "right") - 1
    inside = (own >= 0) & (heads < stop[own])
    heads, tails = heads[inside], stop[own[inside]]
    spans = []
    for a in formats:
        s, e, like = _parts(a, kinds, glue, heads, tails)
        ratio = like - _run(plain, kinds, s, e - s)
        good = ratio >= LEAST_RATIO
        spans.append((s[good], e[good], ratio[good]))
    s, e, r = (np.concatenate(x) for x in zip(*spans))
    kept: list[tuple[int, int, float]] = []
    taken: dict[int, list[tuple[int, int]]] = {}
    for k in np.lexsort((-e, s, -r)).tolist():
        run = int(np.searchsorted(start, s[k], "right"))
        held = taken.setdefault(run, [])  # by start; what is kept doesn't overlap
        at = bisect.bisect_left(held, (int(e[k]),)) - 1
        if at < 0 or held[at][1] <= s[k]:
            held.insert(at + 1, (int(s[k]), int(e[k])))
            kept.append((int(s[k]), int(e[k]), float(r[k])))
    return kept


Span = tuple[int, int, int, float]


def scan(texts: list[bytes], automata: tuple[tuple[Automaton, ...], Automaton]) -> list[list[Span]]:
    """Spans (start, kind, end, log-likelihood ratio) in code points, sorted, of each text."""
    out: list[list[Span]] = [[] for _ in texts]
    k = 0
    while k < len(texts):
        end, total = k, 0
        while end < len(texts) and (end == k or total + len(texts[end]) < 1 << 22):
            total += len(texts[end]) + 1
            end += 1
        whole = b"\n".join(texts[k:end])
        raw = np.frombuffer(whole, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts[k:end]])
        first = np.cumsum(sizes) - sizes
        chosen: dict[int, list[tuple[int, int, float]]] = {}
        for s, e, r in _learned(raw, automata):
            d = int(np.searchsorted(first, s, "right")) - 1
            chosen.setdefault(d, []).append((int(s - first[d]), int(e - first[d]), r))
        hexes = set((np.searchsorted(first, _runs(_IS_HEX[raw], 24)[0], "right") - 1).tolist())
        lower = whole.lower()
        keyed = any(w in lower for w in _WORDS)
        fixed: list[tuple[int, int, int, int, str]] = []
        for d, text in enumerate(texts[k:end]):
            low = lower[first[d] : first[d] + len(text)] if keyed else b""
            base = d in hexes or b"AKIA" in text or (keyed and any(w in low for w in _WORDS) and _PAIR_MARKS.search(text))
            if not base and d not in chosen:
                continue
            decoded = text.decode("utf-8", "replace")
            spans = fixed_spans(decoded) if base else []
            fixed += [(d, *x) for x in spans]
            starts = [x[0] for x in spans]
            reach = list(accumulate((x[2] for x in spans), max))
            for a, b, r in chosen.get(d, ()):
                if len(decoded) != len(text):
                    a, b = len(text[:a].decode("utf-8", "replace")), len(text[:b].decode("utf-8", "replace"))
                i = bisect.bisect_left(starts, b)
                if i == 0 or reach[i - 1] <= a:
                    out[k + d].append((a, 3, b, r))
        for (d, a, kind, b, _), r in zip(fixed, ratios([x[4] for x in fixed], automata).tolist()):
            out[k + d].append((a, kind, b, r))
        k = end
    for spans in out:
        spans.sort()
    return out


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b, *_ in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string, ratios string, best_ratio double"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts, digest of the fixed spans, all spans, and the ratio of each.

    ratios: the spans' log-likelihood ratios of the best format to ordinary words, in the order of ``spans``, with two decimals;
    best_ratio: the highest, null without a span. A null text counts as empty; an empty text has no spans, and the digest of the empty
    string. Learned spans that overlap a fixed one are left out. Rows are independent: repeated rows give repeated results.
    """
    automata = default_automata()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for spans in scan(as_bytes(batch.column(1)), automata):
                base = [x for x in spans if x[1] < 3]
                n = [sum(x[1] == k for x in spans) for k in range(4)]
                score = [x[3] for x in spans]
                rows.append((*n, hashlib.sha256(render(base).encode()).hexdigest(), render(spans), ",".join(f"{r:.2f}" for r in score), max(score, default=None)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.float64()]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    picked = pick(docs, doc_id="doc_id", text="text")
    return picked.mapInArrow(each, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
