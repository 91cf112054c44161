"""Language of documents and of their stretches, by word-first backoff.

A word that the model knows is scored by its per-language log frequency; an
unknown word by its longest known character n-grams (four letters, then three,
two, one), each position backing off on its own. Scores are summed over the
units of a text (sentences and lines; of more than ``LONG`` words, pieces of
them), a Viterbi path over the units with a price for every change picks the
languages, runs of at most three words join their neighbours, and equal neighbours
merge into stretches. Where a change falls inside a unit, it is put between the two
words where it scores best.

The model is fitted on a bounded sample of labelled rows: at most
``SAMPLE_PER_LABEL`` documents of each label and some ``SAMPLE_TOTAL`` in all, of
the ``MAX_LABELS`` most frequent labels, none above ``SAMPLE_CHARS`` characters,
chosen by the hash of the id. A second round counts again by the
languages the first model gives to each unit, which removes wrong labels and
mixed documents. Everything else runs over all documents and whole texts.

Defined cases: null texts count as empty; a text without letters has one
stretch of language ``und`` and confidence 0; a language is never taken from the
stored label; repeated rows repeat; columns besides id and text are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lektra.llm.batches import expand

SAMPLE_PER_LABEL = 400
SAMPLE_TOTAL = 25_600
SAMPLE_CHARS = 20_000
#: more than there are languages with a two-letter or three-letter code in use
MAX_LABELS = 8_000
#: words of a unit, and of the pieces of a longer one
LONG, PIECE = 24, 8
MAX_N = 4
SHORT_RUN = 3
#: log-likelihood ratio a single word can carry at most
CLIP = 7.0
#: price of a change of language between two units
SWITCH = 6.0
#: and inside one, where no mark speaks for it
INSIDE = 24.0

WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
UNIT_END = re.compile(r"(?<=[.!?;·:)\]»”])\s+|\n+|\s+(?=[(\[«“])")


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences, lines and bracketed parts."""
    out, at = [], 0
    for m in UNIT_END.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


#: marks words of a Greek unit that has lost its accents; they are looked up without accents
PLAIN = "\x00"
_ACCENTED = re.compile("[ά-ώἀ-῿\u0300-\u036f]")
_GREEK = re.compile("[α-ω]{2}")
# letters of the range ά-ώ that carry no accent
_BARE = {c: "x" for c in range(0x3AD, 0x3CF) if not unicodedata.decomposition(chr(c))}


def fold(word: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return flat.replace("ς", "σ")


def unaccented_greek(low: str) -> bool:
    """Lower-case text with Greek words and no accented Greek letter."""
    return _GREEK.search(low) is not None and not _ACCENTED.search(low.translate(_BARE))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


class Model:
    """Word and n-gram score tables; rows are relative log-likelihoods, clipped."""

    def __init__(self, counts: dict[str, Counter], min_count: int = 3, max_n: int = MAX_N):
        self.langs = sorted(counts)
        k = len(self.langs)
        vocab: dict[str, list[int]] = {}
        for j, lang in enumerate(self.langs):
            for w, n in counts[lang].items():
                vocab.setdefault(w, [0] * k)[j] += n
        # names and other words of few occurrences are left to their n-grams
        kept = {w: v for w, v in vocab.items() if sum(v) >= min_count}
        folded: dict[str, list[int]] = {}
        for w, v in kept.items():
            f = PLAIN + fold(w)
            folded[f] = [a + b for a, b in zip(folded[f], v)] if f in folded else v
        kept |= folded
        self.words = {w: i for i, w in enumerate(kept)}
        table = np.array([*kept.values()], dtype=np.float64).reshape(-1, k)
        self.table = self._scores(table, np.array([max(sum(counts[x].values()), 1) for x in self.langs]))
        self.grams: list[dict[str, int]] = [{} for _ in range(MAX_N + 1)]
        self.gram_tables: list[np.ndarray] = [np.zeros((0, k))] * (MAX_N + 1)
        for n in range(1, max_n + 1):
            g: dict[str, list[int]] = {}
            for w, v in vocab.items():
                for x in _grams(w, n):
                    if x in g:
                        g[x] = [a + b for a, b in zip(g[x], v)]
                    else:
                        g[x] = v
            g = {x: v for x, v in g.items() if sum(v) >= min_count}
            m = np.array([*g.values()], dtype=np.float64).reshape(-1, k)
            self.grams[n] = {x: i for i, x in enumerate(g)}
            self.gram_tables[n] = self._scores(m, np.maximum(m.sum(axis=0), 1.0)) / n
        self.cache: dict[str, int] = {}
        self.extra: list[np.ndarray] = []

    @staticmethod
    def _scores(m: np.ndarray, totals: np.ndarray) -> np.ndarray:
        logs = np.log((m + 0.02) / (totals + 1.0))
        return np.maximum(logs - logs.max(axis=1, keepdims=True), -CLIP).astype(np.float32)

    def backoff(self, word: str) -> np.ndarray:
        w = f"<{word.removeprefix(PLAIN)}>"
        total, at = np.zeros(len(self.langs), dtype=np.float32), 0
        while at < len(w):
            for n in range(min(MAX_N, len(w) - at), 0, -1):
                i = self.grams[n].get(w[at:at + n])
                if i is not None:
                    total += self.gram_tables[n][i]
                    break
            at += 1
        return np.maximum(total - total.max(), -CLIP / 2)

    def score(self, words: list[str]) -> np.ndarray:
        """Score rows of the words, one after the other."""
        if len(self.cache) > 200_000:
            self.cache, self.extra = {}, []
        base = len(self.words)
        get, cached = self.words.get, self.cache
        idx = []
        for w in words:
            i = get(w)
            if i is None:
                i = cached.get(w)
                if i is None:
                    i = cached[w] = base + len(self.extra)
                    self.extra.append(self.backoff(w))
            idx.append(i)
        ids = np.array(idx, dtype=np.int64)
        if not self.extra:
            return self.table[ids]
        out = np.empty((len(ids), len(self.langs)), dtype=np.float32)
        known = ids < base
        out[known] = self.table[ids[known]]
        if not known.all():
            out[~known] = np.array([self.extra[i - base] for i in ids[~known].tolist()])
        return out


def fit(labelled: list[tuple[str, str]], rounds: int = 2) -> Model:
    """Model from (label, text) pairs; later rounds count by the model's own view of each unit."""
    counts: dict[str, Counter] = {}
    pieces: list[tuple[str, list[str]]] = []
    for lang, text in labelled:
        for a, b in units(text):
            pieces.append((lang, words_of(text[a:b])))
    for lang, ws in pieces:
        counts.setdefault(lang, Counter()).update(ws)
    # short n-grams are enough to tell units apart between the rounds
    model = Model(counts or {"und": Counter()}, max_n=2 if rounds > 1 else MAX_N)
    for _ in range(rounds - 1):
        counts = {lang: Counter() for lang in model.langs}
        for lang, ws in pieces:
            if len(ws) > SHORT_RUN:
                s = model.score(ws).sum(axis=0)
                counts[model.langs[int(s.argmax())]].update(ws)
        model = Model({k: v for k, v in counts.items() if v} or counts)
    return model


def sample(df: DataFrame, key: str, text: str, label: str) -> list[tuple[str, str]]:
    """At most SAMPLE_PER_LABEL labelled texts of each label, by the hash of the key."""
    known = df.where(
        F.col(label).isNotNull() & ~F.lower(F.trim(F.col(label))).isin("", "und")
        & F.length(text).between(40, SAMPLE_CHARS)
    )
    # thin each label by hash to a small multiple of the sample before it is collected
    spark = df.sparkSession
    sizes = known.groupBy(F.col(label).alias("__lk_label")).agg(F.count(F.lit(1)).alias("__lk_n")).orderBy(
        F.desc("__lk_n"), "__lk_label").limit(MAX_LABELS).collect()
    if not sizes:
        return []
    most = max(min(SAMPLE_PER_LABEL, SAMPLE_TOTAL // len(sizes)), 1)
    share = spark.createDataFrame(
        [(r[0], int(min(1.0, 1.5 * most / r[1]) * (1 << 30))) for r in sizes], "__lk_label string, __lk_share long")
    # MAX_LABELS rows at most
    rows = (
        known.join(F.broadcast(share), F.col(label) == F.col("__lk_label"))
        .where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.col("__lk_share")).select(label, text, key).collect())
    taken: Counter = Counter()
    out = []
    for r in sorted(rows, key=lambda r: (str(r[0]), str(r[2]))):
        if taken[r[0]] < most:
            taken[r[0]] += 1
            out.append((r[0], r[1]))
    return out


def _viterbi(scores: np.ndarray, prices: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Best path of each sequence; the rows of all (scores, and the price of a change before each) stand one
    after the other, and all sequences step together."""
    out = np.zeros(len(scores), dtype=np.int64)
    first = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    order = order[lens[order] > 0]
    if not len(order):
        return out
    k = scores.shape[1]
    off, sl = first[order], lens[order]
    n_at = np.searchsorted(-sl, -np.arange(int(sl[0])), side="left")
    best = scores[off].copy()
    back: list[np.ndarray] = [np.zeros((0, 0))]
    for t in range(1, int(sl[0])):
        n = int(n_at[t])
        now = best[:n]
        top = now.argmax(axis=1)
        jump = now[np.arange(n), top] - prices[off[:n] + t]
        stay = now >= jump[:, None]
        back.append(np.where(stay, np.arange(k)[None, :], top[:, None]).astype(np.int16))
        best[:n] = np.where(stay, now, jump[:, None]) + scores[off[:n] + t]
    # back from the ends, again all together: a sequence joins at its last step
    state = best.argmax(axis=1)
    for t in range(int(sl[0]) - 1, -1, -1):
        n = int(n_at[t])
        out[off[:n] + t] = state[:n]
        if t:
            state[:n] = back[t][np.arange(n), state[:n]]
    return out


def _weights(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Weight of each unit: a short foreign phrase says nothing about the language around it,
    but neighbouring short units of one language that are more than a phrase together do."""
    short = sizes <= SHORT_RUN
    weights = np.where(short, 0.25, 1.0)
    if sizes.sum() <= 2 * SHORT_RUN:
        weights[:] = 1.0
        return weights
    top = scores.argmax(axis=1) if len(scores) else short
    run, lang, words, last = [], -1, 0, -2
    for i in [*np.flatnonzero(short).tolist(), len(sizes) + 1]:
        end = i != last + 1
        if end or sizes[i] and run and top[i] != lang:
            if words > SHORT_RUN:
                weights[run] = 1.0
            run, words = [], 0
        last = i
        # units without words part nothing
        if i < len(sizes) and sizes[i]:
            run.append(i)
            lang, words = top[i], words + int(sizes[i])
    return weights


def _pieces(n: int) -> list[int]:
    """First words of the pieces of a unit of ``n`` words; the last has less than two pieces' words."""
    return list(range(0, max(n - PIECE + 1, 1), PIECE)) if n > LONG else [0]


def detect(model: Model, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """Stretches (start, end, language, confidence) of every text, in order."""
    cut: list[list[tuple[int, int]]] = []
    words: list[str] = []
    sizes: list[int] = []
    # first word and end of pieces in their unit, and the pieces that go on from the one before
    inside: dict[int, tuple[int, int]] = {}
    goes_on: list[int] = []
    for t in texts:
        low = t.lower()
        low = low if len(low) == len(t) else None
        parts = []
        for a, b in units(t):
            ws = WORD.findall(low[a:b]) if low is not None else words_of(t[a:b])
            n = len(ws)
            if n > SHORT_RUN and unaccented_greek(" ".join(ws)):
                ws = [PLAIN + fold(w) for w in ws]
            words += ws
            if n <= LONG or low is None:
                parts.append((a, b))
                sizes.append(n)
                continue
            first = _pieces(n)
            for x, y in zip(first, [*first[1:], n]):
                inside[len(sizes)] = (x, y)
                if x:
                    goes_on.append(len(sizes))
                parts.append((a, b))
                sizes.append(y - x)
        cut.append(parts)
    k = len(model.langs)
    size = np.array(sizes, dtype=np.int64)
    ends = np.cumsum(size)
    single = model.score(words) if words else np.zeros((0, k), np.float32)
    sums = np.concatenate([np.zeros((1, k)), np.cumsum(single, axis=0, dtype=np.float64)])
    unit = sums[ends] - sums[ends - size]
    price = np.full(len(size), SWITCH)
    price[goes_on] = INSIDE
    lens = np.array([len(us) for us in cut], dtype=np.int64)
    first_of = (np.cumsum(lens) - lens).tolist()
    spread = [(f, f + n) for f, n in zip(first_of, lens.tolist())]
    unit_of, size_of = [unit[a:b] for a, b in spread], [size[a:b] for a, b in spread]
    weight = np.concatenate([_weights(u, z) for u, z in zip(unit_of, size_of)]) if len(size) else np.zeros(0)
    steps = _viterbi(unit * weight[:, None], price, lens)
    paths = [steps[a:b] for a, b in spread]
    out = []
    for t, us, u, z, path, base in zip(texts, cut, unit_of, size_of, paths, first_of):
        if not us or not z.sum():
            out.append([(0, len(t), "und", 0.0)])
            continue
        row = []
        for a, b, lang in _runs(path, z):
            s = u[a:b].sum(axis=0)
            n = max(int(z[a:b].sum()), 1)
            rest = np.delete(s, lang)
            margin = float(s[lang] - rest.max()) / math.sqrt(n) if len(rest) else 10.0
            start = us[a][0]
            if price[base + a] == INSIDE and row:
                # words of the piece before and of this one, the split that scores best, else the pieces' own
                (x, middle), (_, y) = inside[base + a - 1], inside[base + a]
                lo = int(ends[base + a - 1] - size[base + a - 1])
                gain = single[lo:int(ends[base + a]), last] - single[lo:int(ends[base + a]), lang]
                split = int(np.argmax(np.concatenate([[0.0], np.cumsum(gain)])))
                split = x + split if 0 < split < y - x else middle
                places = [m.span() for m in WORD.finditer(t.lower(), *us[a])]
                start = places[split][0]
                row[-1] = (row[-1][0], places[split - 1][1], *row[-1][2:])
            row.append((start, us[b - 1][1], model.langs[lang], round(1 / (1 + math.exp(-min(max(margin, -30), 30))), 4)))
            last = lang
        out.append(row)
    return out


def _runs(path: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal language over the units, those of few words joined to a neighbour."""
    runs: list[list[int]] = []
    for i, lang in enumerate(path.tolist()):
        if runs and runs[-1][2] == lang:
            runs[-1][1], runs[-1][3] = i + 1, runs[-1][3] + int(sizes[i])
        else:
            runs.append([i, i + 1, lang, int(sizes[i])])
    while len(runs) > 1:
        i = min(range(len(runs)), key=lambda j: runs[j][3])
        if runs[i][3] > SHORT_RUN:
            break
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(runs)]
        j = max(near, key=lambda j: runs[j][3])
        runs[i][2] = runs[j][2]
        merged: list[list[int]] = []
        for r in runs:
            if merged and merged[-1][2] == r[2]:
                merged[-1][1], merged[-1][3] = r[1], merged[-1][3] + r[3]
            else:
                merged.append(r)
        runs = merged
    return [(a, b, lang) for a, b, lang, _ in runs]


FIELDS = [
    T.StructField("seg_no", T.IntegerType()), T.StructField("seg_start", T.IntegerType()),
    T.StructField("seg_end", T.IntegerType()), T.StructField("lang", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("segments", T.IntegerType())]


def stretches(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every stretch of every document (columns doc_id, text, lang of ``docs``): doc_id,
    stored_lang, seg_no, seg_start, seg_end, lang, confidence, segments."""
    known = fit(sample(docs, "doc_id", "text", "lang"))
    # the model comes from a bounded sample, so its size is bounded too
    shared = spark.sparkContext.broadcast(known)

    def make():
        model = shared.value

        def run(texts: list[str]) -> tuple[list[int], list[list]]:
            found = detect(model, texts)
            flat = [x for f in found for x in f]
            return [len(f) for f in found], [
                [i for f in found for i in range(1, len(f) + 1)], *([x[k] for x in flat] for k in range(4)),
                [len(f) for f in found for _ in f]]

        return run

    return expand(docs, {"doc_id": "doc_id", "stored_lang": "lang"}, "text", FIELDS, make)
