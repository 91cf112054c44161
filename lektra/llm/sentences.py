"""Sentence boundaries by a finite transducer.

Texts pass two finite machines. The lexical one turns characters into classes by
what stands within ``CONTEXT`` characters of them: it neutralises the points of
abbreviations, initials, decimals and trailing dots, and marks the first letter
after a closing quotation mark where a word of saying follows. The boundary
transducer reads the classes and emits a mark at every first character of a
sentence.

Texts are processed in chunks that step together, and no chunk needs another one's
text: the lexical machine reads a chunk with its context on both sides, and a
text of more than one chunk is run from every state, which gives each chunk's
transition function; the functions are composed by a parallel prefix scan, and a
second run of all chunks, now from known states, emits.

Words are data per language (``ABBREVIATIONS``, ``SAYING``); what follows decides
the rest: a letter with a point stands for a name, several for an abbreviation that
ends a sentence unless a small letter, a comma or, after capitals, a capital follows.

Defined cases: null and blank texts have no sentence; a text without a mark is
one sentence; white space belongs to none; sentences of a text do not overlap;
repeated rows repeat their sentences. ``;`` and the raised dot end a sentence
only after a Greek word, and an abbreviation that may close a sentence does so
unless a small letter follows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lektra.llm.batches import expand
from lektra.llm.confusables import LONE, LOOKALIKES

# Abbreviations that never end a sentence, by language.
ABBREVIATIONS = {
    "el": "βλ πρβλ δηλ κ.τ.λ π.χ λ.χ",
    "la": "cod codd cf s.v lib cap kal D.M vol pp p no ed fr fl ca Cn Sex Ti Ser App Mam Sp sig pag",
    "en": "e.g i.e viz St Mr Mrs Ms Dr Prof vs Gen Col Lt Capt Sgt Maj Rev Hon Gov Sen Fig Figs Eq Vol",
    "de": "z.B d.h bzw vgl Nr",
    "fr": "p.ex c.-à-d",
    "it": "ecc",
}
# Abbreviations that may end one.
FINAL_ABBREVIATIONS = {"el": "κτλ", "la": "etc", "de": "usw", "it": "ecc"}
# Words of saying after a quotation.
SAYING = {
    "el": "φησίν φησί φησι φησιν εἶπεν εἶπε ἔφη ἔφησεν λέγει ἦ",
    "la": "inquit inquam ait dixit respondit",
    "en": "said says asked replied cried answered shouted whispered exclaimed added",
}
# Who may stand between an English quotation and its word of saying.
SPEAKERS = "he she it they we I you"
# Words that start a sentence even after capitals with points.
STARTERS = "He She It They We I The A An In On At But And This That There"
#: characters on each side that the class of a character may depend on
CONTEXT = 64

WS, GREEK, OTHER, STOP, HARD, GREEK_STOP, CLOSE, OPEN, SKIP, SAY_GREEK, SAY_OTHER, MARK = range(12)
CLASSES = 12
# States. In a sentence: inside a word or after one, with the script of the last word.
BEFORE, IN_G, AFTER_G, IN_O, AFTER_O, NONE = range(6)
END, END_CLOSE, END_WS, END_CLOSE_WS, HARD_END, HARD_CLOSE, HARD_CLOSE_WS = range(6, 13)
# as END and END_CLOSE, while the last word is Greek (needed when no boundary follows)
END_G, END_CLOSE_G = 13, 14
STATES = 15


def _build() -> tuple[np.ndarray, np.ndarray]:
    nxt = np.zeros((STATES, CLASSES), dtype=np.uint8)
    emit = np.zeros((STATES, CLASSES), dtype=bool)
    word = {GREEK: IN_G, OTHER: IN_O, SAY_GREEK: IN_G, SAY_OTHER: IN_O}

    def start(state: int) -> None:
        for c in range(CLASSES):
            emit[state, c] = c != WS
            nxt[state, c] = word.get(c, NONE)
        for c in (STOP, HARD):
            nxt[state, c] = END if c == STOP else HARD_END

    def inside(state: int, greek: bool, in_word: bool) -> None:
        after = AFTER_G if greek else NONE if state == NONE else AFTER_O
        for c in range(CLASSES):
            nxt[state, c] = after
        for c in (GREEK, SAY_GREEK):
            nxt[state, c] = IN_G
        for c in (OTHER, SAY_OTHER):
            nxt[state, c] = IN_G if in_word and greek else IN_O
        nxt[state, SKIP] = state
        nxt[state, STOP] = END_G if greek else END
        nxt[state, HARD] = HARD_END
        nxt[state, GREEK_STOP] = END_G if greek else after

    inside(IN_G, True, True)
    inside(AFTER_G, True, False)
    inside(IN_O, False, True)
    inside(AFTER_O, False, False)
    inside(NONE, False, False)

    start(BEFORE)
    nxt[BEFORE, WS] = BEFORE
    for end, close, greek in ((END, END_CLOSE, False), (END_G, END_CLOSE_G, True)):
        for s in (end, close):
            inside(s, greek, False)
            for c in (STOP, HARD, GREEK_STOP):
                nxt[s, c] = end
            nxt[s, HARD] = HARD_END
            nxt[s, CLOSE] = close
            nxt[s, SKIP] = s
            # a quotation that opens right after the mark starts a sentence
            emit[s, OPEN] = True
            nxt[s, OPEN] = NONE
        nxt[end, WS] = END_WS
        nxt[close, WS] = END_CLOSE_WS
    for s, close, ws in ((HARD_END, HARD_CLOSE, END_WS), (HARD_CLOSE, HARD_CLOSE, HARD_CLOSE_WS)):
        start(s)
        for c in (STOP, HARD, GREEK_STOP):
            nxt[s, c], emit[s, c] = HARD_END, False
        nxt[s, CLOSE], emit[s, CLOSE] = close, False
        nxt[s, SKIP], emit[s, SKIP] = s, False
        nxt[s, WS] = ws
    start(END_WS)
    nxt[END_WS, WS] = END_WS
    for s in (END_CLOSE_WS, HARD_CLOSE_WS, HARD_CLOSE):
        if s != HARD_CLOSE:
            start(s)
            nxt[s, WS] = s
        for c in (SAY_GREEK, SAY_OTHER):
            emit[s, c] = False
    return nxt, emit


NEXT, EMIT = _build()

_GREEK_RANGES = ((0x370, 0x400), (0x1F00, 0x2000))


def _base_classes() -> np.ndarray:
    import unicodedata as U

    table = np.full(0x10000, MARK, dtype=np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        cat = U.category(ch)
        if ch.isspace():
            table[cp] = WS
        elif cat in ("Mn", "Me", "Mc", "Cf"):
            table[cp] = SKIP
        elif cat[0] == "L":
            table[cp] = GREEK if any(a <= cp < b for a, b in _GREEK_RANGES) or cp == 0xB5 else OTHER
        elif cat in ("Pf", "Pe"):
            table[cp] = CLOSE
        elif cat in ("Pi", "Ps"):
            table[cp] = OPEN
    for ch in "\"'":
        table[ord(ch)] = CLOSE
    for ch in ".!?…．！？؟":
        table[ord(ch)] = STOP
    for ch in "。｡։।॥⁝⁞។៕၊။۔።፧‼⁇⁈⁉;":
        table[ord(ch)] = HARD
    for ch in ";；··‧•":
        table[ord(ch)] = GREEK_STOP
    table[0x37E] = STOP
    return table


_TABLE = _base_classes()


def _skeleton() -> dict[int, str | None]:
    """Character -> what it looks like, case kept: accents off, look-alikes to one letter."""
    import unicodedata as U

    shape = {}
    for line in LOOKALIKES.strip().splitlines():
        letters = [x for x in line.split() if x != "-"]
        shape |= {x: letters[0] for x in letters}
    shape |= {x: letters[0] for x, letters in LONE.items()} | {"µ": "m", "σ": "s"}
    out: dict[int, str | None] = {}
    for cp in [*range(0x20, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]:
        c = U.normalize("NFKD", chr(cp))[0] if cp >= 0xFF00 else U.normalize("NFD", chr(cp))[0]
        c = shape.get(c, c)
        if c != chr(cp):
            out[cp] = c
    return out


_SKELETON = _skeleton()
_DROP = re.compile("[­͏​-‍⁠﻿\u0300-\u036f]")


def _words(by_language: dict[str, str]) -> list[str]:
    return [w for ws in by_language.values() for w in ws.split()]


def _alt(words: list[str]) -> str:
    """The words as they look, longest first."""
    looks = {w.translate(_SKELETON) for w in words}
    return "|".join(re.escape(w) for w in sorted(looks, key=lambda w: (-len(w), w)))


_SMALL = r"[^\W\d_A-ZΑ-Ω]"
_QUIET = re.compile(
    # several letters with points: capitals before a word that does not start a sentence, small ones before a small letter
    rf"(?<![\w.])(?:[A-Z]\.(?:[A-Z]\.)+(?=\s*,|\s+(?!(?:{_alt(STARTERS.split())})\b)[^\W\d_])"
    rf"|{_SMALL}\.(?:{_SMALL}\.)+(?=\s*,|\s+{_SMALL})"
    rf"|(?:{_alt(_words(ABBREVIATIONS))}|[A-ZΑ-Ω])\.|(?:{_alt(_words(FINAL_ABBREVIATIONS))})\.(?=\s*,|\s+{_SMALL})"
    r"|[^\W\d_]\.(?=[^\W\d_]\.))"
    rf"|(?<=\d)[.·](?=\d)|(?:\.\.+|…)(?=\s*{_SMALL})"
)
_MAY_END = {"", *(w.translate(_SKELETON) for w in _words(FINAL_ABBREVIATIONS))}
_SAY = re.compile(
    rf"[»”’\"'」』]\s+(?:({_alt(_words(SAYING))})|((?:{_alt(SPEAKERS.split())}|[A-Z]\w*)\s+(?:{_alt(SAYING['en'].split())})))(?!\w)")


def classes(text: str) -> np.ndarray:
    """Class of every character, after the lexical machine."""
    if len(text) <= CHUNK:
        return _classes(text)
    out = []
    for lo in range(0, len(text), CHUNK):
        before = min(lo, CONTEXT)
        out.append(_classes(text[lo - before:lo + CHUNK + CONTEXT])[before:before + CHUNK])
    return np.concatenate(out)


#: characters that the lexical machine reads at once
CHUNK = 4096


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    out = _TABLE[np.where(codes < 0x10000, codes, 0x41)]
    if not text:
        return out
    t, back = text, None
    if _DROP.search(t):
        keep = [i for i, ch in enumerate(t) if not _DROP.match(ch)]
        back, t = np.array([*keep, len(text)]), "".join(t[i] for i in keep)
    t = t.translate(_SKELETON)
    for m in _QUIET.finditer(t):
        if m.group().rstrip(".…") in _MAY_END and t[m.end():m.end() + CONTEXT].lstrip()[:1].isupper():
            continue
        for i in range(m.start(), m.end()):
            if t[i] in ".·…":
                out[i if back is None else back[i]] = MARK
    for m in _SAY.finditer(t):
        i = m.start(1) if m.group(1) else m.start(2)
        i = i if back is None else back[i]
        out[i] = SAY_GREEK if out[i] == GREEK else SAY_OTHER
    return out


def _run(block: np.ndarray, state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """End states of chunks (rows of ``block``) from ``state``; class CLASSES is padding."""
    for col in block.T:
        state = table[state, col]
    return state


_PAD = CLASSES
_NEXT_P = np.concatenate([NEXT, np.arange(STATES, dtype=np.uint8)[:, None]], axis=1)
_EMIT_P = np.concatenate([EMIT, np.zeros((STATES, 1), dtype=bool)], axis=1)


def scan_functions(f: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of the functions f[0], f[1], ... (rows), by doubling."""
    out, step = f.copy(), 1
    while step < len(out):
        nxt = out.copy()
        nxt[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        out, step = nxt, step * 2
    return out


def sentence_starts(texts: list[str], width: int = 256) -> list[np.ndarray]:
    """Offsets of the first characters of the sentences of every text."""
    cls = [classes(t) for t in texts]
    owner, offset, pieces = [], [], []
    for i, c in enumerate(cls):
        for o in range(0, len(c), width):
            owner.append(i)
            offset.append(o)
            pieces.append(c[o:o + width])
    if not pieces:
        return [np.zeros(0, dtype=np.int64) for _ in texts]
    owner_a, offset_a = np.array(owner), np.array(offset)
    lens = np.array([len(p) for p in pieces])
    state0 = np.full(len(pieces), BEFORE, dtype=np.uint8)
    multi = [i for i, c in enumerate(cls) if len(c) > width]
    if multi:
        first = np.searchsorted(owner_a, multi)
        last = np.searchsorted(owner_a, multi, side="right")
        rows = np.concatenate([np.arange(a, b) for a, b in zip(first, last)])
        block = np.full((len(rows), width), _PAD, dtype=np.uint8)
        for k, r in enumerate(rows):
            block[k, : lens[r]] = pieces[r]
        functions = np.tile(np.arange(STATES, dtype=np.uint8), (len(rows), 1))
        for col in block.T:
            functions = _NEXT_P[functions, col[:, None]]
        at = 0
        for a, b in zip(first, last):
            n = b - a
            through = scan_functions(functions[at:at + n])
            state0[a + 1:b] = through[:-1, BEFORE]
            at += n
    # all chunks step together, longest first so that finished ones drop out
    order = np.argsort(-lens, kind="stable")
    sorted_lens = lens[order]
    state = state0[order]
    block = np.full((len(order), int(sorted_lens[0])), _PAD, dtype=np.uint8)
    for k, r in enumerate(order):
        block[k, : lens[r]] = pieces[r]
    hits_row, hits_col = [], []
    for j in range(block.shape[1]):
        n = int(np.searchsorted(-sorted_lens, -j, side="left"))
        col = block[:n, j]
        e = np.flatnonzero(EMIT[state[:n], col])
        if len(e):
            hits_row.append(e)
            hits_col.append(np.full(len(e), j))
        state[:n] = NEXT[state[:n], col]
    if not hits_row:
        return [np.zeros(0, dtype=np.int64) for _ in texts]
    r = order[np.concatenate(hits_row)]
    pos = offset_a[r] + np.concatenate(hits_col)
    own = owner_a[r]
    idx = np.lexsort((pos, own))
    own, pos = own[idx], pos[idx]
    cuts = np.searchsorted(own, np.arange(1, len(texts)))
    return np.split(pos, cuts)


def spans(texts: list[str], width: int = 256) -> list[list[tuple[int, int]]]:
    """(start, end) of the sentences of every text; ends exclude trailing white space."""
    out = []
    for text, starts in zip(texts, sentence_starts(texts, width)):
        ends = [*starts[1:].tolist(), len(text)]
        row = []
        for s, e in zip(starts.tolist(), ends):
            row.append((s, s + len(text[s:e].rstrip())))
        out.append(row)
    return out


def split_sentences(df: DataFrame, key: str, text: str, with_text: bool = False) -> DataFrame:
    """One row per sentence: the key, ``sent_no`` (from 1), ``sent_start``, ``sent_end``
    and, if asked for, ``sentence``."""
    fields = [T.StructField(c, T.IntegerType()) for c in ("sent_no", "sent_start", "sent_end")]
    if with_text:
        fields.append(T.StructField("sentence", T.StringType()))

    def make():
        def run(texts: list[str]) -> tuple[list[int], list[list]]:
            cut = spans(texts)
            flat = [x for c in cut for x in c]
            cols: list[list] = [
                [i for c in cut for i in range(1, len(c) + 1)], [x[0] for x in flat], [x[1] for x in flat]]
            if with_text:
                cols.append([t[s:e] for t, c in zip(texts, cut) for s, e in c])
            return [len(c) for c in cut], cols

        return run

    return expand(df, {key: key}, text, fields, make)
