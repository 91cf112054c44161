"""Test passages inside training documents, by a generalised suffix automaton.

The words of all test items (case, accents, apostrophes and layout removed) form
one suffix automaton per block of ``BLOCK_WORDS`` words, so a block's size does
not depend on the number of items. Documents stream through it and the longest
matching length is tracked at every word. Every occurrence of at least ``SEED``
matching words is noted where it ends, those of shorter matches inside a longer
one too.

So the notes of a document and an item are their maximal common runs; where they
cover words enough for a leak they are chained in order over small gaps into stretches. A document
leaks an item if a dense stretch has ``MIN_WORDS`` matched words, whatever is
chained to it, or two stretches close together have them between them, with other
words put in, left out or both between the two.

Leaked spans can be removed: every stretch over the limit of length, what else of
a leaked item stands dense nearby, and, where asked for (``short``), stretches
that cover ``COVERAGE`` of an item too short for the limit of length.

Defined cases: null texts count as empty; items of fewer than ``MIN_WORDS``
words leak by coverage only, of fewer than ``PLAIN`` words not at all; repeated
items and documents are each their own; ties between stretches go to the first;
the length of a document does not matter.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lektra.llm.batches import expand

SEED = 3
MIN_WORDS = 20
#: words changed, left out or put in between two runs of a stretch
GAP = 4
#: words between two stretches: in the document, and in the item when some are left out
FAR_DOC, FAR_ITEM = 40, 40
#: matched words to the length of a stretch; stock phrases chained by chance are sparser
DENSE, DENSE_TWO = 0.78, 0.9
#: words of the lesser of two stretches; of one under PLAIN words, other items must not have it as stock wording
LEAST_OF_TWO, PLAIN = 5, 8
#: share of the words of an item under MIN_WORDS
COVERAGE = 0.9
#: no leak by length has fewer matched words
LEAST = math.ceil(min(MIN_WORDS, DENSE_TWO * MIN_WORDS))
BLOCK_WORDS = 200_000

# apostrophes, marks and invisible characters within words; a hyphen only where a line breaks
WORD = re.compile("[^\\W_]+(?:(?:['’ʼ\u0300-\u036f\u00ad\u034f\u200b-\u200d\u2060\ufeff]+|[-\u00ad\u2010][ \\t]*\n[ \\t]*)[^\\W_]+)*")
_BITS = 22


def fold(word: str) -> str:
    flat = unicodedata.normalize("NFKD", word.lower())
    return "".join(c for c in flat if c.isalnum()).replace("ς", "σ")


class Automaton:
    """Generalised suffix automaton over lists of word numbers, with occurrences."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = [i for i, _ in items]
        vocab: dict[str, int] = {}
        self.words: list[list[int]] = []
        for _, ws in items:
            self.words.append([vocab.setdefault(fold(w), len(vocab) + 1) for w in ws])
        for _, ws in items:
            for w in ws:
                # capitals write the iota that small letters carry below
                vocab.setdefault(fold(w.upper()), vocab[fold(w)])
        self.vocab = vocab
        self.memo: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int, int]]] = [[]]
        for n, ids in enumerate(self.words):
            last = 0
            # each occurrence: item, position of its end, the word that follows (-1 at the end)
            for p, (c, then) in enumerate(zip(ids, [*ids[1:], -1])):
                last = self._extend(last, c, ends)
                ends[last].append((n, p, then))
        order = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for s in order:
            up = self.link[s]
            if up > 0 and self.length[up] >= SEED:
                ends[up] += ends[s]
        self.ends = [e if self.length[s] >= SEED else [] for s, e in enumerate(ends)]
        # occurrences of the last SEED, and SEED + 1, words of a state
        self.at_seed, self.past_seed = ([0] * len(self.length) for _ in range(2))
        for s in reversed(order):
            up = self.link[s]
            for least, count in ((SEED, self.at_seed), (SEED + 1, self.past_seed)):
                if self.length[s] >= least:
                    count[s] = count[up] if self.length[up] >= least else len(self.ends[s])
        self.table = np.zeros(1 << _BITS, dtype=bool)
        for ids in self.words:
            codes = self._codes(np.array(ids, dtype=np.int64))
            self.table[codes] = True
        self.runs_of: dict[int, dict[tuple[int, int, int], list[int]]] = {}

    def _extend(self, last: int, c: int, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q, ends)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append([])
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q, ends)
        return cur

    def _clone(self, p: int, c: int, q: int, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        k = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        ends.append([])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = k
            p = link[p]
        link[q] = k
        return k

    @staticmethod
    def _codes(ids: np.ndarray) -> np.ndarray:
        n = len(ids) - SEED + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        code = np.zeros(n, dtype=np.uint64)
        for k in range(SEED):
            code = code * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n].astype(np.uint64)
        return ((code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def numbers(self, words: list[str]) -> list[int]:
        memo, vocab = self.memo, self.vocab
        if len(memo) > 500_000:
            memo.clear()
        out = []
        for w in words:
            n = memo.get(w)
            if n is None:
                n = memo[w] = vocab.get(fold(w), 0)
            out.append(n)
        return out

    def notes(self, ids: list[int], arr: np.ndarray) -> dict[int, dict[tuple[int, int], int]]:
        """Item number -> {(diagonal, end in the document): length} of noted matches."""
        found: dict[int, dict[tuple[int, int], int]] = {}
        if len(ids) < SEED:
            return found
        hit = np.flatnonzero(self.table[self._codes(arr)] & (arr[:len(arr) - SEED + 1] > 0))
        if not len(hit):
            return found
        breaks = np.flatnonzero(np.diff(hit) > SEED) + 1
        for part in np.split(hit, breaks):
            self._stream(ids, int(part[0]), int(part[-1]) + SEED, found)
        return found

    def _stream(self, ids: list[int], lo: int, hi: int, found: dict) -> None:
        nxt, link, length = self.next, self.link, self.length
        at_seed, past_seed = self.at_seed, self.past_seed
        s, l = 0, 0
        for k in range(lo, hi):
            c = ids[k]
            old, old_l = s, l
            while s and c not in nxt[s]:
                s = link[s]
                l = length[s]
            t = nxt[s].get(c)
            if t is None:
                s, l = 0, 0
            else:
                s, l = t, l + 1
            # occurrences of the last SEED words that do not go on with this word
            if old_l >= SEED and (past_seed[s] if l > SEED else 0) < at_seed[old]:
                self._note(old, old_l, k - 1, c, found)
        if l >= SEED:
            self._note(s, l, hi - 1, 0, found)

    def _note(self, s: int, l: int, end: int, c: int, found: dict) -> None:
        """Notes the occurrences that ``c`` does not follow, shorter matches by the suffix links too."""
        length, link, ends = self.length, self.link, self.ends
        seen: set = set()
        while True:
            up = link[s]
            more = up > 0 and length[up] >= SEED
            for x in ends[s]:
                if x[2] != c and x not in seen:
                    n, p, _ = x
                    if n in found:
                        found[n][end - p, end] = l
                    else:
                        found[n] = {(end - p, end): l}
            if not more:
                return
            seen.update(ends[s])
            s, l = up, length[up]

    def least(self, n: int, short: bool = False) -> int | None:
        """Matched words that a leak of an item has at least; None if it cannot leak."""
        size = len(self.words[n])
        if size >= MIN_WORDS:
            return LEAST
        return math.ceil(COVERAGE * size) if short and size >= PLAIN else None

    def candidates(self, found: dict, short: bool = False) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Item number and common runs, (document, item, length), of every place with words enough for a leak."""
        for n, notes in found.items():
            least = self.least(n, short)
            if least is None or sum(notes.values()) < least:
                continue
            runs = sorted((end - l + 1, end - l + 1 - diag, l) for (diag, end), l in notes.items())
            at, to, covered = 0, 0, 0
            for k, (d, _, l) in enumerate(runs):
                # nothing is chained or paired over more words
                if k and d - to > FAR_DOC:
                    if covered >= least:
                        yield n, runs[at:k]
                    at, covered = k, 0
                if d + l > to:
                    covered += d + l - (d if d > to else to)
                    to = d + l
            if covered >= least:
                yield n, runs[at:]

    def trigrams(self, n: int) -> dict[tuple[int, int, int], list[int]]:
        if n not in self.runs_of:
            ids, out = self.words[n], {}
            for k in range(len(ids) - 2):
                out.setdefault((ids[k], ids[k + 1], ids[k + 2]), []).append(k)
            self.runs_of[n] = out
        return self.runs_of[n]

    def holders(self, words: list[int]) -> set[int]:
        """Items that hold these words (SEED or more), one after the other."""
        s = 0
        for w in words:
            s = self.next[s][w]
        return {n for n, _, _ in self.ends[s]}

    def stock(self, n: int, short: tuple, long: tuple) -> bool:
        """Whether an item has the words of a short stretch without those of the long one next to it."""
        ids = self.words[n]
        near = ids[long[4] - LEAST_OF_TWO:long[4]] if long[3] < short[3] else ids[long[3]:long[3] + LEAST_OF_TWO]
        return not self.holders(ids[short[3]:short[4]]) <= self.holders(near)

    def exact_runs(self, ids: list[int], n: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """Maximal common runs of three words and more: (document, item, length)."""
        get = self.trigrams(n).get
        lo, hi = max(lo, 0), min(hi, len(ids))
        out, live = [], {}
        for k in range(lo, hi - 2):
            at = get((ids[k], ids[k + 1], ids[k + 2]))
            now = {}
            if at:
                for p in at:
                    d = k - p
                    now[d] = live.pop(d, k)
            for d, first in live.items():
                out.append((first, first - d, k + 2 - first))
            live = now
        for d, first in live.items():
            out.append((first, first - d, hi - first))
        return sorted(out)


def chain(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Stretches from each run to each run that follows it over small gaps, with the most
    matched words: (matched words, document first, end, item first, end)."""
    after: list[list[tuple[int, int]]] = []
    for a, (d0, i0, l0) in enumerate(runs):
        to, d1, i1 = [], d0 + l0, i0 + l0
        for b in range(a + 1, len(runs)):
            d, i, l = runs[b]
            if d > d1 + GAP:
                break
            if i > i1 + GAP or i + l <= i1:
                continue
            over = max(0, d1 - d, i1 - i)
            if over < l and d + over - d1 <= GAP and i + over - i1 <= GAP:
                to.append((b, l - over))
        after.append(to)
    out = []
    for a, (d0, i0, l0) in enumerate(runs):
        if not after[a]:
            out.append((l0, d0, d0 + l0, i0, i0 + l0))
            continue
        most, b, last = {a: l0}, a, a
        while b <= last:
            if b in most:
                d, i, l = runs[b]
                out.append((most[b], d0, d + l, i0, i + l))
                for c, more in after[b]:
                    if most[b] + more > most.get(c, 0):
                        most[c] = most[b] + more
                        last = max(last, c)
            b += 1
    return out


def _wide(s: tuple) -> int:
    return max(s[2] - s[1], s[4] - s[3])


def leak(
    stretches: list[tuple[int, int, int, int, int]], stock: Callable[[tuple, tuple], bool] = lambda short, long: False,
) -> tuple[int, list[tuple[int, int]]] | None:
    """Matched words and document word spans of a leak, or None; ``stock`` tells whether a
    short stretch beside a long one is stock wording."""
    # of a stretch of MIN_WORDS words one in ten may be changed
    whole = [
        s for s in stretches
        if s[0] >= LEAST and (
            s[0] >= MIN_WORDS and s[0] >= DENSE * _wide(s) or _wide(s) >= MIN_WORDS and s[0] >= DENSE_TWO * _wide(s))
    ]
    if whole:
        best = max(whole, key=lambda s: s[0])
        return best[0], [(best[1], best[2])]
    # two that are dense together: each has fewer than MIN_WORDS words, so it cannot make up for more than this
    slack = (1 - DENSE_TWO) * MIN_WORDS / DENSE
    half = sorted(
        (s for s in stretches if s[0] >= LEAST_OF_TWO and s[0] + slack >= DENSE_TWO * _wide(s)), key=lambda s: s[1])
    top, firsts = None, [s[1] for s in half]
    for a in half:
        for b in half[bisect_left(firsts, a[2]):bisect_right(firsts, a[2] + FAR_DOC)]:
            gi = b[3] - a[4]
            if not -2 <= gi <= FAR_ITEM:
                continue
            total = a[0] + b[0] + min(gi, 0)
            if total < max(MIN_WORDS, DENSE_TWO * (_wide(a) + _wide(b))) or top and total <= top[0]:
                continue
            short, long = (a, b) if a[0] < b[0] else (b, a)
            if short[0] >= PLAIN or not stock(short, long):
                top = total, [(a[1], a[2]), (b[1], b[2])]
    return top


def _dense(runs: list[tuple[int, int, int]], least: int) -> tuple[int, list[tuple[int, int]]] | None:
    """The dense stretch with the most matched words, ``least`` or more."""
    best = max((s for s in chain(runs) if s[0] >= least and s[0] >= DENSE_TWO * _wide(s)), key=lambda s: s[0], default=None)
    return best and (best[0], [(best[1], best[2])])


def _every(runs: list[tuple[int, int, int]], take: Callable[[list], tuple | None]) -> Iterator[tuple[int, list]]:
    """What ``take`` finds, again and again in the runs that are left."""
    while runs and (got := take(runs)):
        yield got
        runs = [r for r in runs if not any(r[0] < to and r[0] + r[2] > at for at, to in got[1])]


def find(automata: list[Automaton], text: str, short: bool = False) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(item id, matched words, spans in words) of the items a text leaks."""
    words = WORD.findall(text)
    out = []
    for a in automata:
        ids = a.numbers(words)
        notes = a.notes(ids, np.array(ids, dtype=np.int64))
        best: dict[int, tuple[int, list]] = {}
        for n, runs in a.candidates(notes, short):
            if len(a.words[n]) >= MIN_WORDS:
                take = lambda r, n=n: leak(chain(r), partial(a.stock, n))
            else:
                take = partial(_dense, least=a.least(n, short))
            for w, spans in _every(runs, take):
                most, so_far = best.get(n, (0, []))
                best[n] = max(w, most), so_far + spans
        for n, (w, spans) in sorted(best.items()):
            rest = [
                r for r in sorted((e - l + 1, e - l + 1 - g, l) for (g, e), l in notes[n].items())
                if not any(r[0] < to and r[0] + r[2] > at for at, to in spans)]
            more = [x for _, s in _every(rest, partial(_dense, least=PLAIN)) for x in s]
            out.append((a.items[n], w, sorted(spans + more)))
    return out


def word_chars(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text)]


def build(items: Iterator[tuple[int, str]]) -> list[Automaton]:
    """Automata over blocks of items, each block bounded in words."""
    out, block, size = [], [], 0
    for key, text in items:
        ws = WORD.findall(text or "")
        if size + len(ws) > BLOCK_WORDS and block:
            out.append(Automaton(block))
            block, size = [], 0
        block.append((key, ws))
        size += len(ws)
    return [*out, Automaton(block)] if block else out


LEAKS = [
    T.StructField("item_id", T.LongType()),
    T.StructField("words", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
]


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, short: bool = False) -> DataFrame:
    """One row per leaking document and item: matched words of the best leak and character spans of all.

    Items stream to the driver block by block; each block of at most BLOCK_WORDS
    words (or one item) is broadcast and the documents pass it."""
    out = None
    rows = items.where(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id").toLocalIterator()
    block, size, blocks = [], 0, []
    for r in rows:
        n = len(WORD.findall(r[1]))
        if block and size + n > BLOCK_WORDS:
            blocks.append(spark.sparkContext.broadcast(block))
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    blocks.append(spark.sparkContext.broadcast(block))
    for shared in blocks:
        part = expand(docs, {"doc_id": "doc_id"}, "text", LEAKS, _finder(shared, short))
        out = part if out is None else out.unionByName(part)
    return out


#: automata of the last block in this Python worker, which later tasks use again
_BUILT: dict[str, list[Automaton]] = {}


def _built(name: str, shared) -> list[Automaton]:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build(iter(shared.value))
    return _BUILT[name]


def _finder(shared, short: bool):
    name = uuid.uuid4().hex

    def make():
        automata = _built(name, shared)

        def run(texts: list[str]) -> tuple[list[int], list[list]]:
            n, cols = [], [[], [], []]
            for text in texts:
                got = find(automata, text, short)
                n.append(len(got))
                at = word_chars(text) if got else []
                for item, words, spans in got:
                    cols[0].append(item)
                    cols[1].append(words)
                    cols[2].append([{"start": at[x][0], "end": at[y - 1][1]} for x, y in spans])
            return n, cols

        return run

    return make


def removed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with the leaked spans cut out (``clean_text``) and the characters cut."""
    spans = (
        found.select("doc_id", F.explode("spans").alias("s"))
        .groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    )
    # spans of a document are merged from left to right, then what lies between them is kept
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(
                    F.element_at(acc, -1)["start"].alias("start"),
                    F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    joined = docs.join(spans, "doc_id", "left").withColumn("m", F.when(F.col("spans").isNotNull(), merged))
    text = F.aggregate(
        "m",
        F.struct(F.lit("").alias("t"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["t"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])).alias("t"),
            s["end"].alias("at")),
        lambda acc: F.concat(acc["t"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    cut = F.aggregate("m", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return joined.select(
        "doc_id",
        F.when(F.col("m").isNull(), F.col("text")).otherwise(text).alias("clean_text"),
        F.coalesce(cut, F.lit(0)).alias("chars_removed"),
    )
