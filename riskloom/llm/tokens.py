"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted.

Each pre-token starts as one symbol for each byte. A heap holds the adjacent pairs that have a merge rule,
keyed by rule rank and then position; the lowest is popped, stale entries are passed over, its right
symbol leaves the linked list and the two new neighbours are pushed. The count is initial symbols minus
merges. Words repeat, so counts of words and of pre-tokens are held in two bounded tables per task.

Null text counts as empty: 0 bytes, 0 tokens. Rows repeat as they come; null doc_id stays null; other
columns are not read.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame

from .util import map_arrow

#: Entries of each table of a task (about 100 bytes each); words beyond are counted anew each time.
CACHE = 250_000
_POS, _ID = 32, 17
#: Fixed: the published byte-level pre-tokenization pattern, white space as Unicode has it.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Odd(Exception):
    """The text has white space that words split at single spaces can't stand for."""


class MergeCounter:
    """Counts tokens as the library does for a byte-level vocabulary file."""

    def __init__(self, path: str, cache: int = CACHE):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        if max(vocab.values(), default=0) >> _ID or len(spec["model"]["merges"]) >> 63 - _POS - 2:
            raise ValueError("the vocabulary is too large for packed pairs")
        self.first = [vocab[s] for _, s in sorted(byte_symbols().items())]
        self.rule: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rule.setdefault(vocab[a] << _ID | vocab[b], rank << _ID | vocab[a + b])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.parts = regex.compile(_SPLIT).findall
        self.limit, self.pre = cache, {}
        outer = self

        class Words(dict):
            """Counts of ' ' + word, by word."""

            def __missing__(self, word: str) -> int:
                if not word or word[0].isspace():
                    raise _Odd
                n = outer.plain(" " + word)
                if len(self) < outer.limit and len(word) < 64:
                    self[word] = n
                return n

        self.words = Words()

    def merged(self, data: bytes) -> int:
        """Symbols left of one pre-token."""
        n = len(data)
        if n < 2:
            return n
        first, rule = self.first, self.rule.get
        sym = [first[b] for b in data]
        heap = []
        for i in range(n - 1):
            r = rule(sym[i] << _ID | sym[i + 1])
            if r is not None:
                heap.append(r << _POS | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        low, new_id, merges = (1 << _POS) - 1, (1 << _ID) - 1, 0
        while heap:
            top = heapq.heappop(heap)
            i, r = top & low, top >> _POS
            j = after[i]
            if sym[i] < 0 or j >= n or rule(sym[i] << _ID | sym[j]) != r:
                continue
            sym[i], sym[j] = r & new_id, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rule(sym[i] << _ID | sym[k])
                if r is not None:
                    heapq.heappush(heap, r << _POS | i)
            h = before[i]
            if h >= 0:
                r = rule(sym[h] << _ID | sym[i])
                if r is not None:
                    heapq.heappush(heap, r << _POS | h)
        return n - merges

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, pre = 0, self.pre
        for part in self.parts(text):
            n = pre.get(part)
            if n is None:
                n = self.merged(part.encode())
                if len(pre) < self.limit and len(part) < 64:
                    pre[part] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token, as is the library's default."""
        if self.at_special and any(s in text for s in self.special):
            pieces = self.at_special.split(text)
            return len(pieces) - 1 + sum(self.count(p) for p in pieces if p)
        head, *words = text.split(" ")
        try:
            return self.plain(head) + sum(map(self.words.__getitem__, words))
        except _Odd:
            return self.plain(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text. ``path`` is found on the executors."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        counter = _counter(path)

        def step(batch: pa.RecordBatch) -> dict:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return step

    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _counter(path: str) -> MergeCounter:
    """One counter for each worker process, whose tables serve task after task."""
    held = _counter.__dict__.setdefault("held", {})
    if path not in held:
        held[path] = MergeCounter(path)
    return held[path]
