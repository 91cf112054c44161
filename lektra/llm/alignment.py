"""Sentence alignment in bilingual books.

1. Sentences of lines and of translations become terms: stems of the ancient
   words, words of the translation, and, on both sides alike, numbers and
   romanised names. Terms are 64-bit hashes with the ancient language in them.
2. A translation with the lines it is placed at is a *paired document* (its own
   lines, or those the lookup links where it has no end); so is a dictionary
   entry with its glosses. The singular value decomposition of the term-document
   matrix is randomised: documents are hashed with a random sign into ``SKETCH``
   places (sums that are combined before the shuffle; no pairs of terms), the
   small Gram matrix of the rows is decomposed, and every term keeps its
   ``RANK`` leading coordinates. All terms of all books share this space.
3. Windows of neighbouring sentences on both sides (one to ``WIDTH`` against as
   many, and one sentence against runs of any length) are compared by how far the
   terms of each are covered by near terms of the other; a gloss of the dictionary
   is as near as a term to itself. The place only weighs: the penalty grows with the
   distance in lines up to ``FAR`` and no further.
4. Margin-scored mutual neighbours: a pair of sentences stands if each lies in
   the best window of the other, and that window beats the mean of both
   neighbourhoods by ``MIN_MARGIN``. Nothing asks for equal order.

Every sentence of a book meets every sentence of its other side. Books are compared
tile by tile; a tile gives the best window and the highest scores of each of its
sentences, the best of these over all tiles are those of the book, and only then are
pairs chosen. Tiles see ``EDGE`` sentences beyond their own, as many as a window can
have, so where they are cut changes nothing but their memory. This is quadratic in
the sentences of one book, and in nothing else.

Defined cases: rows without id, book or text are left out; a segment without start
stands where the lookup has it and else is left out, one without end covers its
start line; lines and segments loaded twice are matched once and give rows for
each copy; blank texts have no sentences; ties go to the earlier sentence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lektra.llm.batches import expand
from lektra.llm.confusables import mapped_form
from lektra.llm.sentences import spans
from lektra.runtime import cut

SKETCH = 512
RANK = 128
#: terms in a larger share of the paired documents count only in sentences that have no others
COMMON = 0.06
DICTIONARY_WEIGHT = 4
#: lines of a paired document; a translation over more is several, cut in proportion and light
TAUGHT = 64
#: sentences on one side of the windows that are compared everywhere; longer runs start and end at strong partners
WIDTH = 3
#: sentences of a block, blocks on a side of a tile, and sentences there at most: memory only, not what is found
BLOCK, TILE, LIMIT = 256, 4, 2048
#: cosines that unrelated terms reach by chance, and how far below 1 a sure one may stay
NOISE, SATURATE = 0.3, 0.3
#: penalty for the next line, for every doubling of the distance, and at most
NEXT, DOUBLE, FAR = 0.05, 0.2, 0.3
#: penalty for every sentence of a window beyond one on each side, and beyond WIDTH in a longer run
LONGER, RUN = 0.05, 0.005
#: weight of terms that every sentence of a window must add
GAIN = 3.0
MIN_SCORE, MIN_MARGIN = 0.2, 1.3
#: neighbours in the mean that the margin is taken from
NEIGHBOURS = 4
#: sentences a window can have beyond one on each side: with more, its penalty leaves less than MIN_SCORE
EDGE = WIDTH - 1 + int((1 - MIN_SCORE - LONGER * (WIDTH - 1)) / RUN + 1e-6)

# Romanisation of Greek letters in names.
ROMAN = dict(zip(
    "αβγδεζηθικλμνξοπρστυφχψω",
    "a b g d e z e th i k l m n x o p r s t u ph ch ps o".split()))
# Endings that inflection changes.
ENDINGS_GREEK = sorted(
    "ουσι ουσιν ομεν ετε ει εισ ω οντεσ ομενοσ εσθαι οσ ου ον οι ων οισ ουσ α η ησ ην αι αισ ασ ασι εσ ι ν σ υσ".split(),
    key=len, reverse=True)
ENDINGS_LATIN = sorted(
    "us i o um a ae am as at ant amus atis is os orum arum it unt e em ibus".split(), key=len, reverse=True)

_WORD = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def _flat(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ς", "σ")


def stem(word: str, endings: list[str], least: int = 3) -> str:
    for e in endings:
        if word.endswith(e) and len(word) - len(e) >= least:
            return word[: -len(e)]
    return word


def roman(word: str) -> str:
    return "".join(ROMAN.get(c, c) for c in word)


def _source_word(w: str) -> tuple[str, ...]:
    if w[0].isdigit():
        return ("=" + w,)
    low = _flat(w.lower())
    greek = any("α" <= c <= "ω" for c in low)
    s = stem(low, ENDINGS_GREEK if greek else ENDINGS_LATIN)
    return ("s:" + s, "=" + roman(s)) if w[0].isupper() else ("s:" + s,)


def _target_word(w: str) -> tuple[str, ...]:
    if w[0].isdigit():
        return ("=" + w,)
    low = w.lower()
    return ("t:" + low, "=" + stem(low, ["os"])) if w[0].isupper() else ("t:" + low,)


class _Words(dict):
    """Terms of words, kept as they are met (emptied when it grows large)."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = self.make(word)
        return value


_SOURCE, _TARGET = _Words(_source_word), _Words(_target_word)


def source_terms(text: str) -> list[str]:
    """Terms of an ancient sentence: ``s:stem``, and ``=`` for names and numbers."""
    return [t for w in _WORD.findall(mapped_form(text) or "") for t in _SOURCE[w]]


def target_terms(text: str) -> list[str]:
    """Terms of a translated sentence: ``t:word``, and ``=`` for names and numbers."""
    return [t for w in _WORD.findall(mapped_form(text) or "") for t in _TARGET[w]]


def _sentences(df: DataFrame, text: str, make, keep: list[str]) -> DataFrame:
    """Sentences with their distinct terms; ``n`` counts them within the text, which has ``of``."""
    fields = [
        T.StructField("n", T.IntegerType()), T.StructField("of", T.IntegerType()), T.StructField("start", T.IntegerType()),
        T.StructField("terms", T.ArrayType(T.StringType()))]

    def start():
        def run(texts: list[str]) -> tuple[list[int], list[list]]:
            cut = spans(texts)
            return [len(c) for c in cut], [
                [i for c in cut for i in range(len(c))], [len(c) for c in cut for _ in c], [x[0] for c in cut for x in c],
                [sorted(set(make(t[s:e]))) for t, c in zip(texts, cut) for s, e in c]]

        return run

    return expand(df, {c: c for c in keep}, text, fields, start).withColumn("terms", _ids("terms", F.col("book_id")))


def _ids(terms: str, book_id: Column) -> Column:
    """Each ancient language has its own words, and learns its own words of the translations."""
    return F.transform(terms, lambda t: F.xxhash64(_language(book_id), t))


def _language(book_id: Column) -> Column:
    return F.when(book_id.startswith("phi"), "l").otherwise("g")


# --- the shared space

def space(pairs: DataFrame, docs: int) -> DataFrame:
    """``pairs`` (doc, weight, term) -> term, whether it is ``common``, its weight ``idf`` in sentences, ``vec`` (RANK bytes).

    Sums are combined before their shuffles, so a term has at most SKETCH places
    however frequent it is. The Gram matrix is added up over groups of partitions;
    at most 32 of size SKETCH x SKETCH come to the driver."""
    place = F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(SKETCH)).cast("int")
    sign = F.when(F.pmod(F.xxhash64("doc", F.lit(9)), F.lit(2)) == 0, 1).otherwise(-1)
    cells = pairs.groupBy("term", place.alias("place")).agg(
        F.sum(sign * F.col("weight")).alias("value"), F.count(F.lit(1)).alias("n"))
    terms = (
        cells.groupBy("term")
        .agg(F.sum("n").alias("df"), F.collect_list("place").alias("places"), F.collect_list("value").alias("values"))
        .withColumn("common", F.col("df") > F.lit(max(docs * COMMON, 20.0)))
    )

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), SKETCH), dtype=np.float32)
            for i, (places, values) in enumerate(zip(b["places"], b["values"])):
                out[i, np.asarray(places)] = np.asarray(values)
            yield pd.DataFrame({
                "term": b["term"], "common": b["common"], "idf": np.log(1 + docs / b["df"].to_numpy()).astype(np.float32),
                "sketch": list(_bytes(out))})

    table = cut(terms.mapInPandas(sketch, "term long, common boolean, idf float, sketch binary"))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((SKETCH, SKETCH), dtype=np.float32)
        for b in batches:
            y = _rows(b["sketch"][~b["common"]], SKETCH)
            total += y.T @ y
        yield pd.DataFrame({"gram": [total.tobytes()]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"gram": [sum(np.frombuffer(g, np.float32).astype(np.float64) for g in b["gram"]).tobytes()]})

    parts = (
        table.mapInPandas(gram, "gram binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
        .groupBy("part").applyInPandas(lambda b: add(b), "gram binary").collect())
    total = sum((np.frombuffer(r.gram, np.float64) for r in parts), np.zeros(SKETCH * SKETCH)).reshape(SKETCH, SKETCH)
    lead = np.linalg.eigh(total)[1][:, ::-1][:, :RANK].astype(np.float32)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({
                "term": b["term"], "common": b["common"], "idf": b["idf"], "vec": list(_bytes(_rows(b["sketch"], SKETCH) @ lead))})

    return table.mapInPandas(project, "term long, common boolean, idf float, vec binary")


def _bytes(rows: np.ndarray) -> Iterator[bytes]:
    top = np.abs(rows).max(axis=1, keepdims=True)
    for r in np.round(rows * (127 / np.maximum(top, 1e-9))).astype(np.int8):
        yield r.tobytes()


def _rows(values, width: int) -> np.ndarray:
    """Unit rows from bytes."""
    y = np.frombuffer(b"".join(values), dtype=np.int8).reshape(-1, width).astype(np.float32)
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)


# --- matching

def _grouped(x: np.ndarray, units: list[np.ndarray], how: np.ufunc, step: int = 256) -> np.ndarray:
    """Per unit (places of rows of ``x``; none is empty) the best, or the sum, of its rows."""
    out = np.empty((len(units), x.shape[1]), dtype=np.float32)
    for lo in range(0, len(units), step):
        part = units[lo:lo + step]
        how.reduceat(
            x[np.concatenate(part)], np.cumsum([0, *(len(u) for u in part[:-1])]), axis=0, out=out[lo:lo + step])
    return out


def _moved(x: np.ndarray, by: int) -> np.ndarray:
    """Row i holds row i + by; zeros at the end."""
    out = np.zeros_like(x)
    if by < len(x):
        out[:len(x) - by] = x[by:]
    return out


def _unions(x: np.ndarray) -> list[np.ndarray]:
    """Best of the rows i .. i + k for every width k + 1."""
    out = [x]
    for k in range(1, WIDTH):
        out.append(np.maximum(out[-1], _moved(x, k)))
    return out


def _sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sum of the rows i .. i + width - 1."""
    return sum((_moved(x, k) for k in range(1, width)), x.copy())


class _Best:
    """The best window of every unit of one side: score, first source, first target, widths."""

    def __init__(self, n: int):
        self.score, self.of = np.full(n, -1.0, np.float32), np.zeros((n, 4), np.int64)

    def offer(self, unit: np.ndarray, score: np.ndarray, of: np.ndarray) -> None:
        """Windows for different units; of equal ones the first that came stays."""
        better = score > self.score[unit]
        self.score[unit[better]], self.of[unit[better]] = score[better], of[better]


def match(
    line: np.ndarray, lo: np.ndarray, hi: np.ndarray, s_units: list[np.ndarray], t_units: list[np.ndarray],
    near: np.ndarray, s_idf: np.ndarray, t_idf: np.ndarray, own_s: int, own_t: int,
) -> tuple[_Best, _Best, np.ndarray, np.ndarray, np.ndarray]:
    """Best windows of units in reading order, their terms being rows and columns of ``near``.

    Windows start among the first ``own_s`` sources and ``own_t`` targets, and may run on. Beside the best of both
    sides: their highest single scores, and which pairs cover something. Ties go to fewer sentences, then earlier ones."""
    ns, nt = len(s_units), len(t_units)
    # weight of a source that windows of targets cover, and the other way round
    to_t, to_s = _grouped(near.T, t_units, np.maximum), _grouped(near, s_units, np.maximum)
    by_t = [_grouped(w.T * s_idf[:, None], s_units, np.add) for w in _unions(to_t)]
    by_s = [_grouped(w.T * t_idf[:, None], t_units, np.add).T for w in _unions(to_s)]
    all_s, all_t = (_grouped(idf[:, None], u, np.add)[:, 0] for idf, u in ((s_idf, s_units), (t_idf, t_units)))
    apart = np.maximum(np.maximum(lo[None, :] - line[:, None], line[:, None] - hi[None, :]), 0).astype(np.float32)
    off = np.minimum(DOUBLE * np.log2(np.maximum(apart, 1)) + np.where(apart > 0, np.float32(NEXT), 0), FAR).astype(np.float32)

    best_s, best_t = _Best(ns), _Best(nt)
    top_s = top_t = None
    shapes = [(p, total - p) for total in range(2, min(WIDTH + 1, EDGE + 2) + 1) for p in range(1, total)]
    for p, q in shapes:
        if p > ns or q > nt:
            continue
        n, m = _sums(by_t[q - 1], p), _sums(by_s[p - 1].T, q).T
        h = _harmonic(n / np.maximum(_sums(all_s, p), 1e-9)[:, None], m / np.maximum(_sums(all_t, q), 1e-9)[None, :])
        far = off
        for k in range(1, p):
            far = np.maximum(far, _moved(off, k))
        for k in range(1, q):
            far = np.maximum(far, _moved(far.T, k).T)
        h = h - np.float32(LONGER * (p + q - 2)) - far
        # the first and the last of a window must each add to what it covers
        if p > 1:
            less = _sums(by_s[p - 2].T, q).T
            h = np.where((m - less < GAIN) | (m - _moved(less, 1) < GAIN), np.float32(-1), h)
        if q > 1:
            less = _sums(by_t[q - 2], p)
            h = np.where((n - less < GAIN) | (n - _moved(less.T, 1).T < GAIN), np.float32(-1), h)
        h = h[:min(own_s, ns - p + 1), :min(own_t, nt - q + 1)]
        if p == q == 1:
            top_s, top_t = _tops(h), _tops(h.T)
        for best, x, width, flip in ((best_s, h, p, False), (best_t, h.T, q, True)):
            other, at = x.argmax(axis=1), np.arange(len(x))
            of = np.stack([*((other, at) if flip else (at, other)), np.full(len(x), p), np.full(len(x), q)], axis=1)
            for k in range(width - 1, -1, -1):
                best.offer(at + k, x[at, other], of)

    # one sentence against a longer run
    found = [
        _runs(by_t[0], by_s[0], all_s, all_t, off, to_t, s_units, s_idf, best_s.score, best_t.score, own_s, own_t),
        _runs(by_s[0].T, by_t[0].T, all_t, all_s, off.T, to_s, t_units, t_idf, best_t.score, best_s.score, own_t, own_s)]
    one = np.concatenate([np.ones_like(found[0][2]), found[1][2]])
    of = np.stack([
        np.concatenate([found[0][0], found[1][1]]), np.concatenate([found[0][1], found[1][0]]), one,
        np.concatenate([found[0][2], np.ones_like(found[1][2])])], axis=1)
    score = np.concatenate([found[0][3], found[1][3]])
    for best, first in ((best_s, 0), (best_t, 1)):
        row, k = _spread(of[:, 2 + first])
        unit = of[row, first] + k
        order = np.lexsort((of[row, 1 - first], of[row, first], of[row, 2], of[row, 2] + of[row, 3], -score[row], unit))
        unit, row = unit[order], row[order]
        lead = np.flatnonzero(np.diff(unit, prepend=-1))
        best.offer(unit[lead], score[row[lead]], of[row[lead]])
    return best_s, best_t, top_s, top_t, by_t[0] >= 0.5


def _harmonic(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.minimum(a, 1), np.minimum(b, 1)
    return 2 * a * b / np.maximum(a + b, np.float32(1e-9))


def _tops(x: np.ndarray) -> np.ndarray:
    k = min(NEIGHBOURS, x.shape[1])
    return np.maximum(np.partition(x, x.shape[1] - k, axis=1)[:, -k:], 0)


def _least(x: np.ndarray):
    """Function (first, last) -> least of ``x`` from first to last, for arrays of places."""
    levels = [x]
    while 2 ** len(levels) <= len(x):
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))

    def least(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.log2(last - first + 1).astype(np.int64)
        out = np.empty(len(first), x.dtype)
        for v in np.unique(level):
            at = np.flatnonzero(level == v)
            out[at] = np.minimum(levels[v][first[at]], levels[v][last[at] - 2 ** v + 1])
        return out

    return least


def _ahead(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Highest of the places first to last ahead in a row; -inf where the row ends before."""
    def moved(y: np.ndarray, by: int) -> np.ndarray:
        out = np.full_like(y, -np.inf)
        if by < y.shape[1]:
            out[:, :y.shape[1] - by] = y[:, by:]
        return out

    width, span = last - first + 1, 1
    if width < 1:
        return np.full_like(x, -np.inf)
    while 2 * span <= width:
        x = np.maximum(x, moved(x, span))
        span *= 2
    return moved(np.maximum(x, moved(x, width - span)), first)


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of every member and its number there."""
    group = np.repeat(np.arange(len(size)), size)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)


def _runs(
    alone: np.ndarray, back: np.ndarray, whole: np.ndarray, run_whole: np.ndarray, off: np.ndarray, cover: np.ndarray,
    units: list[np.ndarray], idf: np.ndarray, best: np.ndarray, run_best: np.ndarray, own: int, run_own: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of one row and more than WIDTH columns that may be the best of a unit: row, first column, length, score.

    ``alone`` is the weight of a row that a column covers, ``back`` the other way round, ``cover`` how near columns come
    to terms. What a column adds to a run is at most what it covers alone, so runs start and end where that is GAIN.
    The likeliest come first; those that a bound of their score (sums for unions) puts behind a window that all their
    units have already are not looked at."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    best, run_best = best.copy(), run_best.copy()
    for top in range(0, own, 64):
        rows = slice(top, min(top + 64, own))
        row, col = np.nonzero(alone[rows] >= GAIN)
        n, m = (np.pad(np.cumsum(x[rows], axis=1, dtype=np.float64), ((0, 0), (1, 0))) for x in (alone, back))
        total = np.pad(np.cumsum(run_whole, dtype=np.float64), (1, 0))
        # every strong column with those after it in its row, as far as a run may reach, if the row can cover the share
        # of the run that MIN_SCORE asks for: ``rest`` must not be less behind the run than before it
        key = row * (alone.shape[1] + EDGE + 1) + col
        count = np.searchsorted(key, key + EDGE, side="right") - np.arange(len(key))
        away = off[rows][row, col] >= FAR - 1e-6
        parts = []
        for kind, far in ((away, FAR), (~away, 0)):
            least = MIN_SCORE + LONGER * (WIDTH - 1) + RUN + far - 1e-3
            rest = m - least / (2 - least) * total
            start = np.flatnonzero(kind & (col < run_own) & (_ahead(rest, WIDTH + 1, EDGE + 1)[row, col] >= rest[row, col]))
            group, step = _spread(count[start])
            pair = start[group]
            r, a, b = row[pair], col[pair], col[pair + step]
            keep = (b - a >= WIDTH) & (rest[r, b + 1] >= rest[r, a])
            parts.append((r[keep], a[keep], b[keep]))
        r, a, b = (np.concatenate(x) for x in zip(*parts))
        bound = _harmonic(
            (n[r, b + 1] - n[r, a]) / np.maximum(whole[top + r], 1e-9), (m[r, b + 1] - m[r, a]) / np.maximum(total[b + 1] - total[a], 1e-9))
        r = r + top
        bound = bound - _longer(b - a) - np.maximum(off[r, a], off[r, b]) + 1e-4
        keep = np.flatnonzero(bound >= MIN_SCORE)
        order = keep[np.argsort(-bound[keep], kind="stable")]
        step = 64
        while len(order):
            order = order[bound[order] > np.minimum(best[r[order]], _least(run_best)(a[order], b[order]))]
            part, order = order[:step], order[step:]
            if not len(part):
                break
            step = min(2 * step, 4096)
            h = _run_scores(r[part], a[part], b[part], back, whole, run_whole, off, cover, units, idf)
            part, h = part[h >= MIN_SCORE], h[h >= MIN_SCORE]
            out.append((r[part], a[part], b[part] - a[part] + 1, h))
            np.maximum.at(best, r[part], h)
            at, k = _spread(b[part] - a[part] + 1)
            np.maximum.at(run_best, a[part][at] + k, h[at])
    return tuple(np.concatenate(x) for x in zip(*out))


def _longer(more: np.ndarray) -> np.ndarray:
    """Penalty of runs with so many sentences (WIDTH or more) beyond the first."""
    return (LONGER * (WIDTH - 1) + RUN * (more - WIDTH + 1)).astype(np.float32)


def _run_scores(row, a, b, back, whole, run_whole, off, cover, units, idf) -> np.ndarray:
    """Scores of the runs of columns a to b, -1 where an end adds too little."""
    group, k = _spread(np.array([len(units[i]) for i in row]))
    terms, first, last = np.concatenate([units[i] for i in row]), a[group], b[group]
    ends = cover[first, terms], cover[last, terms]
    inner = np.zeros_like(ends[0])
    m, total, far = back[row, a].copy(), run_whole[a].copy(), off[row, a].copy()
    for step in range(1, int((b - a).max()) + 1):
        on = np.flatnonzero(a + step <= b)
        c = a[on] + step
        m[on] += back[row[on], c]
        total[on] += run_whole[c]
        far[on] = np.maximum(far[on], off[row[on], c])
        on = np.flatnonzero(first + step < last)
        inner[on] = np.maximum(inner[on], cover[first[on] + step, terms[on]])
    begin = np.flatnonzero(k == 0)
    weight = lambda x: np.add.reduceat(x * idf[terms], begin)
    full = weight(np.maximum(np.maximum(inner, ends[0]), ends[1]))
    h = _harmonic(full / np.maximum(whole[row], 1e-9), m / np.maximum(total, 1e-9)) - _longer(b - a) - far
    return np.where(np.all([full - weight(np.maximum(inner, e)) >= GAIN for e in ends], axis=0), h, -1).astype(np.float32)


_RESULT = (
    "book_id string, kind string, uid long, n int, at int, score float, first int, other int, p int, q int,"
    "tops array<float>, partners array<int>")


def _match_tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One tile: its sentences on both sides (``kind`` s, t) and their terms (v) -> best windows of its sentences."""
    terms = rows[rows["kind"] == "v"]
    number = {t[0]: i for i, t in enumerate(terms["terms"])}
    common, none = terms["common"].to_numpy(bool), len(terms)

    def side(kind: str) -> tuple[pd.DataFrame, list[list[int]], int]:
        part = rows[rows["kind"] == kind].sort_values("at")
        units = []
        for ws in part["terms"]:
            known = [number[w] for w in ws if w in number]
            units.append([i for i in known if not common[i]] or known or [none])
        return part, units, int(part["home"].sum())

    (src, s_units, own_s), (tgt, t_units, own_t) = side("s"), side("t")
    # bytes multiply without rounding, so no score depends on the tile; the last row is for sentences without known terms
    vec = np.frombuffer(b"".join(terms["vec"]) + bytes(RANK), dtype=np.int8).reshape(-1, RANK).astype(np.float32)
    size = np.maximum(np.linalg.norm(vec, axis=1), np.float32(1e-9))
    idf = np.append(terms["idf"].to_numpy(dtype=np.float32), np.float32(0))
    (s_terms, s_at), (t_terms, t_at) = _own(s_units), _own(t_units)
    near = vec[s_terms] @ vec[t_terms].T
    near /= size[s_terms][:, None]
    near /= size[t_terms][None, :]
    near -= NOISE
    near /= 1 - NOISE - SATURATE
    np.clip(near, 0, 1, out=near)
    column = {int(t): j for j, t in enumerate(t_terms)}
    glosses = terms["glosses"].to_numpy()
    for i, t in enumerate(s_terms):
        for g in glosses[t] if t < none and glosses[t] is not None else ():
            j = column.get(number.get(g, -1))
            if j is not None:
                near[i, j] = 1
    *best, top_s, top_t, covers = match(
        src["lo"].to_numpy(np.int64), tgt["lo"].to_numpy(np.int64), tgt["hi"].to_numpy(np.int64), s_at, t_at, near,
        idf[s_terms], idf[t_terms], own_s, own_t)
    s0, t0 = int(src["at"].iloc[0]), int(tgt["at"].iloc[0])
    out = []
    for x, b, tops, own, kind in ((src, best[0], top_s, own_s, "s"), (tgt, best[1], top_t, own_t, "t")):
        of = b.of + np.array([s0, t0, 0, 0])
        mine, other = (0, 1) if kind == "s" else (1, 0)
        partners = [
            [t0 + j for j in range(j0, j0 + q) if covers[i, j]] if kind == "s" and v >= MIN_SCORE else []
            for i, (v, (_, j0, _, q)) in enumerate(zip(b.score, b.of.tolist()))]
        y = pd.DataFrame({
            "book_id": key[0], "kind": kind, "uid": x["uid"].to_numpy(np.int64), "n": x["n"].to_numpy(np.int64),
            "at": x["at"].to_numpy(np.int64), "score": b.score, "first": of[:, mine], "other": of[:, other],
            "p": of[:, 2], "q": of[:, 3], "tops": [*tops.tolist(), *([] for _ in range(len(x) - own))], "partners": partners})
        out.append(y[(np.arange(len(x)) < own) | (b.score >= MIN_SCORE)])
    return pd.concat(out)


def _own(units: list[list[int]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The terms that occur, and the units as places among them."""
    flat = np.concatenate([np.asarray(u) for u in units])
    terms, at = np.unique(flat, return_inverse=True)
    return terms, np.split(at, np.cumsum([len(u) for u in units])[:-1])


def _tiles(rows: DataFrame) -> DataFrame:
    """Sentences (book_id, kind, at, ...) of books that have both sides, once for every tile that sees them."""
    step = min(BLOCK * TILE, LIMIT)
    piece = lambda c: F.floor(c / F.lit(step)).cast("int")
    last = rows.groupBy("book_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("at"))).alias(k) for k in "st"))
    source = F.col("kind") == "s"
    return (
        rows.join(last.where("s IS NOT NULL AND t IS NOT NULL"), "book_id")
        .withColumn("mine", F.explode(F.sequence(piece(F.greatest(F.col("at") - EDGE, F.lit(0))), piece(F.col("at")))))
        .withColumn("other", F.explode(F.sequence(F.lit(0), piece(F.when(source, F.col("t")).otherwise(F.col("s"))))))
        .select(
            *rows.columns, F.when(source, F.col("mine")).otherwise(F.col("other")).alias("s_tile"),
            F.when(source, F.col("other")).otherwise(F.col("mine")).alias("t_tile"),
            (F.col("mine") == piece(F.col("at"))).alias("home")))


def _matched(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (book_id, kind, uid, n, lo, hi, terms, at) -> book_id, both sentences (uid and n), score."""
    key = ["book_id", "s_tile", "t_tile"]
    tiles = _tiles(rows)
    vocabulary = tiles.select(*key, F.explode("terms").alias("term")).distinct().join(table, "term")
    # no nulls in the numbers, or they would reach the tiles as floats
    nought = [F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in ("uid", "n", "lo", "hi", "at")]
    both = tiles.withColumn("common", F.lit(False)).unionByName(vocabulary.select(
        *key, F.lit("v").alias("kind"), *nought, F.lit(False).alias("home"), F.array("term").alias("terms"), "common", "idf",
        "vec", "glosses"), allowMissingColumns=True)
    # the best window of all tiles, ties as within one
    order = F.struct("score", *(-c for c in (F.col("p") + F.col("q"), F.col("p"), F.col("first"), F.col("other"))),
                     "p", "q", "other", "partners")
    tops = F.slice(F.sort_array(F.flatten(F.collect_list("tops")), False), 1, NEIGHBOURS)
    best = cut(
        both.groupBy(*key).applyInPandas(_match_tile, _RESULT)
        .groupBy("book_id", "kind", "at", "uid", "n").agg(F.max(order).alias("b"), tops.alias("tops"))
        .select("book_id", "kind", "at", "uid", "n", "b.score", "b.other", "b.p", "b.partners", F.greatest(F.aggregate(
            "tops", F.lit(0.0), lambda a, x: a + x) / NEIGHBOURS, F.lit(0.03)).alias("around"))
        .where(F.col("score") >= F.lit(MIN_SCORE)))
    s, t = (best.where(F.col("kind") == k).drop("kind") for k in "st")
    s = s.select("book_id", F.explode("partners").alias("t_at"), F.col("at").alias("s_at"), F.col("uid").alias("line_key"),
                 F.col("n").alias("line_n"), F.col("score").alias("s_score"), F.col("around").alias("s_around"))
    t = t.select("book_id", F.col("at").alias("t_at"), F.col("uid").alias("segment_key"), F.col("n").alias("segment_n"),
                 F.col("score").alias("t_score"), F.col("around").alias("t_around"), "other", "p")
    return (
        s.join(t, ["book_id", "t_at"]).where((F.col("s_at") >= F.col("other")) & (F.col("s_at") < F.col("other") + F.col("p")))
        .withColumn("score", F.greatest("s_score", "t_score").cast("double"))
        .where(2 * F.col("score") >= MIN_MARGIN * (F.col("s_around") + F.col("t_around")))
        .select("line_key", "line_n", "segment_key", "segment_n", "score"))


def _units(sent: DataFrame, place: list[str]) -> DataFrame:
    """Sentences of copies (same place, number and terms) as one, named by the smallest id."""
    return sent.groupBy(*place, "n", F.xxhash64("terms").alias("h")).agg(
        F.min("id").alias("uid"), F.max("of").alias("of"), F.first("terms").alias("terms")).drop("h")


def align(lines: DataFrame, segments: DataFrame, lookup: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Pairs of sentences: line_id, line_start, segment_id, segment_start, score."""
    line_cols = ["id", "book_id", "line_number"]
    seg_cols = ["id", "book_id", "lo", "hi", "open_hi"]
    linked = lookup.where("segment_id IS NOT NULL AND line_number IS NOT NULL").groupBy(
        F.col("segment_id").alias("id"), "book_id").agg(F.min("line_number").alias("l0"), F.max("line_number").alias("l1"))
    lo = F.coalesce("start_line", "l0")
    placed = (
        segments.where("id IS NOT NULL AND book_id IS NOT NULL AND translation_text IS NOT NULL")
        # as long, so that no distance overflows
        .select("id", "book_id", *(F.col(c).cast("long") for c in ("start_line", "end_line")), "translation_text").join(linked, ["id", "book_id"], "left")
        .where(lo.isNotNull())
        .select("id", "book_id", "translation_text", lo.alias("lo"),
                F.greatest(lo, F.coalesce("end_line", F.when(F.col("start_line").isNull(), F.col("l1")), lo)).alias("hi"),
                F.greatest(lo, F.coalesce("end_line", "l1", lo)).alias("open_hi")))
    src_all = cut(_sentences(
        lines.where("id IS NOT NULL AND book_id IS NOT NULL AND line_text IS NOT NULL AND line_number IS NOT NULL")
        .withColumn("line_number", F.col("line_number").cast("long")),
        "line_text", source_terms, line_cols))
    tgt_all = cut(_sentences(placed, "translation_text", target_terms, seg_cols))
    src, tgt = _units(src_all, line_cols[1:]), cut(_units(tgt_all, seg_cols[1:]))

    # paired documents; of long translations one for every TAUGHT lines that the book has there
    place = ["book_id", "uid", "lo", "open_hi"]
    wide = F.col("open_hi") - F.col("lo") >= TAUGHT
    long_links = (
        tgt.where(wide).select(*place).distinct().join(src.select("book_id", "line_number").distinct(), "book_id")
        .where((F.col("line_number") >= F.col("lo")) & (F.col("line_number") <= F.col("open_hi")))
        .withColumn("part", F.floor((F.row_number().over(Window.partitionBy(*place).orderBy("line_number")) - 1) / TAUGHT)))
    taught = tgt.join(long_links.groupBy(*place).agg((F.max("part") + 1).alias("parts")), place, "left").select(
        *place, F.coalesce("parts", F.lit(1)).alias("parts"), "n", "of", "terms")
    doc = F.xxhash64("book_id", "uid", "part").alias("doc")
    docs = taught.select(*place, "parts").distinct()
    links = (
        docs.where(~wide).withColumn("part", F.lit(0).cast("long"))
        .select("book_id", doc, F.lit(1.0).alias("weight"), F.explode(F.sequence("lo", "open_hi")).alias("line_number"))
        .unionByName(long_links.select("book_id", doc, F.lit(1 / TAUGHT).alias("weight"), "line_number")))
    entries = cut(_entries(dictionary))
    # a power of two, so that sums do not depend on their order
    weight = F.when(wide, F.lit(1 / TAUGHT)).otherwise(F.lit(1.0)).alias("weight")
    pairs = (
        links.join(src, ["book_id", "line_number"]).select("doc", "weight", F.explode("terms").alias("term"))
        .unionByName(taught.withColumn("part", F.floor(F.col("n") * F.col("parts") / F.col("of"))).select(
            doc, weight, F.explode("terms").alias("term")))
        .unionByName(entries.select(
            "doc", F.lit(float(DICTIONARY_WEIGHT)).alias("weight"), F.explode(F.concat("head", "gloss")).alias("term"))))
    glosses = entries.select(F.explode("head").alias("term"), F.explode_outer("gloss").alias("g")).groupBy("term").agg(
        F.collect_set("g").alias("glosses"))
    n_docs = docs.agg(F.sum("parts")).first()[0] or 0
    table = cut(space(pairs, n_docs + entries.count()).join(glosses, "term", "left"))

    # sentences of a book in reading order
    line = F.col("line_number")
    rows = src.select("book_id", F.lit("s").alias("kind"), "uid", "n", line.alias("lo"), line.alias("hi"), "terms").unionByName(
        tgt.select("book_id", F.lit("t").alias("kind"), "uid", "n", "lo", "hi", "terms")).where(F.size("terms") > 0)
    found = _matched(cut(rows.withColumn("at", F.row_number().over(
        Window.partitionBy("book_id", "kind").orderBy("lo", "uid", "n", F.xxhash64("terms"))) - 1)), table)

    # every copy of both sentences
    keys = ["line_key", "line_n", "segment_key", "segment_n"]
    return (
        found.join(_copies(src_all, line_cols[1:], "line"), keys[:2])
        .join(_copies(tgt_all, seg_cols[1:], "segment"), keys[2:])
        .groupBy("line_id", "line_start", "segment_id", "segment_start").agg(F.max("score").alias("score"))
    )


def _copies(sent: DataFrame, place: list[str], side: str) -> DataFrame:
    """Name of the unit of every sentence: the smallest id among its copies."""
    w = Window.partitionBy(*place, "n", F.xxhash64("terms"))
    return sent.select(
        F.min("id").over(w).alias(f"{side}_key"), F.col("n").alias(f"{side}_n"),
        F.col("id").alias(f"{side}_id"), F.col("start").alias(f"{side}_start"))


def _entries(dictionary: DataFrame) -> DataFrame:
    """doc, head and gloss terms of every distinct entry."""
    rows = dictionary.where("headword IS NOT NULL AND entry_plain IS NOT NULL").select("headword", "entry_plain").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            heads = [sorted(set(source_terms(h))) for h in b["headword"]]
            yield pd.DataFrame({
                "doc": b["doc"], "head": heads, "gloss": [sorted(set(target_terms(p))) for p in b["entry_plain"]],
                "book_id": ["" if any("α" <= c <= "ω" for t in h for c in t) else "phi" for h in heads]})

    found = rows.select(F.xxhash64("headword", "entry_plain").alias("doc"), "headword", "entry_plain").mapInPandas(
        run, "doc long, head array<string>, gloss array<string>, book_id string")
    return found.select("doc", _ids("head", F.col("book_id")).alias("head"), _ids("gloss", F.col("book_id")).alias("gloss"))
