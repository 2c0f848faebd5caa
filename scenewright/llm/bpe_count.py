"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word are a linked list and its mergeable adjacent pairs a heap; the pair of lowest rank, leftmost
first, is merged until none is left. The count is the initial symbols less the merges, and no identifiers are made.
A character outside the vocabulary counts as its UTF-8 bytes, which never merge.

No piece of the vocabulary has a word mark after another character (checked when it is read), so no merge crosses
the start of a word and each word is counted by itself; bounded tables keep the counts of words seen lately.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from .common import as_bytes, pick, small

MARK = "▁"
#: Words whose counts a worker keeps, twice over at most, and the longest that it keeps: 64 characters, so that the tables stay under some 200 MB.
KEPT = 200_000
LONGEST = 64
LIMIT = 4096


class Kept(dict):
    """What ``make`` gives for a key, for the keys seen lately."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.make(word)
            if len(word) > LONGEST:  # seldom said again, and of any size
                return n
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[word] = n
        return n


class Merges:
    """Counts of words from the ranks of a vocabulary with byte fallback."""

    def __init__(self, ranks: dict[str, int], frozen: list[str] = ()):
        self.ranks = ranks
        self.frozen = re.compile("|".join(map(re.escape, sorted(frozen, key=len, reverse=True)))) if frozen else None

    def symbols(self, word: str) -> tuple[list[str], list[bool]]:
        """The initial symbols, and which may merge: strings that the vocabulary fixes are whole and stay so."""
        if self.frozen is None:
            return list(word), [True] * len(word)
        made, free, k = [], [], 0
        for m in self.frozen.finditer(word):
            made += [*word[k : m.start()], m[0]]
            free += [True] * (m.start() - k) + [False]
            k = m.end()
        return made + list(word[k:]), free + [True] * (len(word) - k)

    def count(self, word: str) -> int:
        ranks = self.ranks
        part, free = self.symbols(word)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(part[i] + part[i + 1])
            if rank is not None and free[i] and free[i + 1]:
                heap.append((rank, i, part[i] + part[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or part[i] + part[j] != made or not part[j]:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = made, ""
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if free[k] and (rank := ranks.get(made + part[k])) is not None:
                    heapq.heappush(heap, (rank, i, made + part[k]))
            h = before[i]
            if h >= 0 and free[h] and (rank := ranks.get(part[h] + made)) is not None:
                heapq.heappush(heap, (rank, h, part[h] + made))
        unknown = sum(len(p.encode()) - 1 for p in part if len(p) == 1 and p not in ranks)
        return n - merges + unknown


_LETTER = re.compile(r"[^\W\d_]")
_RUNS = re.compile(rf"{MARK}*[^\W\d_]+|{MARK}*(?:[^\w{MARK}]|[\d_])+|{MARK}+")
_LONE = re.compile(f"{MARK}{{2,}}")
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Counter:
    """The token counts of whole texts as the library gives them with a model file of this content."""

    def __init__(self, data: bytes):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("a pair-merging model with byte fallback is needed")
        #: None where the model changes no character; its normaliser is the library's otherwise.
        self.normalise = None
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            made = sentencepiece.SentencePieceNormalizer(model_proto=data)
            self.normalise = made.normalize
        self.dummy = norm.add_dummy_prefix
        kinds = {1, 4, 5}  # normal, user-defined and unused pieces
        ranks = {p.piece: -p.score for p in model.pieces if p.type in kinds}
        if any(p.type == 5 for p in model.pieces):
            raise ValueError("unused pieces aren't supported")
        if any(MARK in p.lstrip(MARK) for p in ranks):
            raise ValueError("a piece spans the start of a word")
        frozen = [p.piece for p in model.pieces if p.type == 4]
        part = Kept(Merges(ranks, frozen).count)
        # letters and other characters meet in no piece but those with an odd letter: the runs of other words are counted apart
        odd = set()
        for p in [*ranks, *frozen]:
            p = p.lstrip(MARK)
            kind = [bool(_LETTER.match(c)) for c in p]
            odd |= {x if a else y for x, y, a, b in zip(p, p[1:], kind, kind[1:]) if a != b}
        if len(odd) > 16:
            self.words = part
        else:
            strange = re.compile("[" + re.escape("".join(odd)) + "]") if odd else None

            def runs(word: str) -> int:
                if strange and strange.search(word):
                    return part[word]
                return sum(map(part.__getitem__, _RUNS.findall(word)))

            self.words = Kept(runs)
        self.part = part

    def count(self, text: str) -> int:
        """The number of tokens; 0 for an empty text."""
        if not text:
            return 0
        if self.normalise:
            text = self.normalise(text)
            if not text:
                return 0
            text = text.replace(" ", MARK)
        else:
            text = (MARK if self.dummy else "") + text.replace(" ", MARK)
        words = self.words
        if _LONE.search(text) or text[0] != MARK or text[-1] == MARK:
            return sum(map(words.__getitem__, _CHUNK.findall(text)))
        return sum(map(words.__getitem__, text.replace(MARK, "\0" + MARK)[1:].split("\0"))) if "\0" not in text else sum(map(words.__getitem__, _CHUNK.findall(text)))


@lru_cache(maxsize=4)
def counter(data: bytes) -> Counter:
    return Counter(data)


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text); null counts as empty, with no bytes and tokens.

    The model file, of about a megabyte, is read by the driver and sent to the workers.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(shared.value)
        for batch in small(batches):
            texts = as_bytes(batch.column(1))
            n = [made.count(t.decode("utf-8", "replace")) for t in texts]
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = pick(docs, doc_id="doc_id", text="text")
    return picked.mapInArrow(each, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
