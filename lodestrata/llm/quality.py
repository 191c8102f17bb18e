"""Text quality of documents: line labels by a hidden Markov model, and per-document statistics.

Every non-blank line (long lines in stretches) gets categorical features, computed for whole batches over code-point
arrays; a hidden Markov model with states prose, list, table and junk explains them as products of categorical
emissions, so that a line is read in the light of its neighbours. The model is trained by expectation-maximisation on a
bounded sample of labelled documents, in which lines of a document labelled K may be K or prose. Viterbi paths label
the lines; the labels' shares are weighted by non-blank characters.

Defined results: null, empty and blank texts have no lines, zero counts and null shares, and are never found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.chars import Rolling, codes, mix, pieces, words
from lodestrata.session import spread

STATES = ("prose", "list", "table", "junk")
#: Labelled documents the model is trained on, at most: those of least hash, so a sample alike at every size.
LABELLED = 2000
#: Lines of one labelled document used in training, at most: as many in a row, from a place that its id's hash gives.
TRAIN_LINES = 400
#: A line is read in stretches of about so many characters, cut at blanks.
STRETCH = 400
#: Fixed: frequent function words of English, French, German and Spanish, accents kept.
COMMON = tuple(
    """the of and a an in to is was were are that for it its as with by on from at this these those not or if then than when where which who whether but while had has have been be more most into between near
    neither nor no yet so such their they we our he she his her both only every each one two
    le la les l de des du d un une et en est sont que qui pas ne dans pour par sur avec au aux ce cette ces il elle on se si plus mais ou selon chaque près son sa ses lorsque
    der die das den dem des ein eine einer eines und ist sind nicht noch von mit zu im in auf für bei nach um weil wenn ob liegt sich als auch am
    el los las un una y es son que no se en del por para con al lo su sus si más pero o según cada cuando""".split()
)


def _classes() -> np.ndarray:
    """A class for each code point: 0 other symbol, 1 lower letter, 2 upper letter, 3 other letter, 4 digit, 5 blank, 6 line end, 7 sentence mark, 8 other plain punctuation, 9 separator, 10 control or mojibake sign."""
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            t[c] = 1 if ch.islower() else 2 if ch.isupper() else 3
        elif ch.isnumeric():
            t[c] = 4
        elif ch.isspace():
            t[c] = 5
        elif not ch.isprintable():
            t[c] = 10
    for ch in "\n\r\x0b\x0c\x85\u2028\u2029":
        t[ord(ch)] = 6
    for ch in ".!?。！？…":
        t[ord(ch)] = 7
    for ch in ",'’‘\"“”()-–:":
        t[ord(ch)] = 8
    for ch in "|\t;":
        t[ord(ch)] = 9
    for ch in "ÃÂ¬¤§�":
        t[ord(ch)] = 10
    return t


_HELD: dict[str, np.ndarray] = {}


def _table(name: str, make) -> np.ndarray:
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def _common() -> np.ndarray:
    code, off = codes(list(COMMON))
    return np.unique(Rolling(code).of(off[:-1], off[1:]))


def _lower() -> np.ndarray:
    t = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x3000):
        low = chr(c).lower()
        if len(low) == 1:
            t[c] = ord(low)
    return t


#: Features and their number of values.
FEATURES = {"bullet": 6, "ends": 7, "common": 19, "separators": 6, "cells": 5, "symbols": 7, "digits": 6, "words": 6, "repeated": 5, "variety": 4, "wordlen": 6, "odd": 5, "inside": 5, "case": 4, "again": 3, "heading": 3, "commas": 5}


def _bins(x: np.ndarray, *edges: float) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right").astype(np.uint8)


def lines(texts: list[str]) -> dict[str, np.ndarray]:
    """Of each non-blank line or stretch: doc (its text), chars (non-blank characters), the counts behind the statistics, and `f`, its features.

    A long line makes several rows; `runs` is 1 in its first and `stops` may be 1 in its last, so that both sum to lines as they stand in the text.
    """
    code, off = codes(texts)
    cls = _table("classes", _classes)[code]
    n = len(code)
    brk = cls == 6
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    cut[1:] |= brk
    begin = np.flatnonzero(cut[:-1])
    physical = begin
    # stretches of long lines: cut at the first blank after every STRETCH characters
    size = np.diff(np.append(begin, n))
    if (size > 2 * STRETCH).any():
        long = np.flatnonzero(size > 2 * STRETCH)
        reps = size[long] // STRETCH
        want = np.repeat(begin[long], reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)) * STRETCH
        blanks = np.flatnonzero(cls == 5)
        if len(blanks):
            at = np.searchsorted(blanks, want)
            ok = at < len(blanks)
            at, want = blanks[at[ok]] + 1, want[ok]
            ok = (at - want < STRETCH) & (at < n)
            begin = np.union1d(begin, at[ok])
    if not n:
        begin = begin[:0]
    stop = np.append(begin[1:], n)
    filled = (cls != 5) & (cls != 6) & (code != 9)
    total = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    cum = total(filled)
    chars = cum[stop] - cum[begin]
    keep = chars > 0
    begin, stop, chars = begin[keep], stop[keep], chars[keep]
    m = len(begin)
    doc = np.searchsorted(off, begin, "right") - 1
    if not m:
        return {"doc": doc, "chars": chars, "f": np.zeros((0, len(FEATURES)), np.uint8), **{k: np.zeros(0, np.int64) for k in ("words", "letters", "symbols", "commons", "stops", "runs")}}
    count = lambda flag: (lambda c: c[stop] - c[begin])(total(flag))
    letters, digits, uppers = count((cls >= 1) & (cls <= 3)), count(cls == 4), count(cls == 2)
    seps, odd, plain, marks = count(cls == 9), count(cls == 10), count(cls == 8), count(cls == 7)
    symbols = count(cls == 0)
    tabs, pipes, commas = count(code == 9), count((code == 124) | (code == 59)), count(code == 44)
    wide = np.zeros(n, bool)
    wide[2:] = (code[2:] == 32) & (code[1:-1] == 32) & (code[:-2] != 32)
    gaps = count(wide)
    alpha = (cls >= 1) & (cls <= 4)
    inner = np.zeros(n, bool)
    sym = (cls == 0) | (cls == 10) | ((cls == 9) & (code != 9)) | (code == 58) | (code == 39)
    inner[1:-1] = sym[1:-1] & ((cls[:-2] >= 1) & (cls[:-2] <= 3)) & ((cls[2:] >= 1) & (cls[2:] <= 4))
    inside = count(inner)
    # words
    ws, we, wd = words(code, off)
    wl = np.searchsorted(begin, ws, "right") - 1
    ok = wl >= 0
    ws, we, wl = ws[ok], we[ok], wl[ok]
    low = Rolling(_table("lower", _lower)[code])
    h = low.of(ws, we)
    known = _table("common", _common)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    nwords = np.bincount(wl, minlength=m)
    commons = np.bincount(wl, weights=known[at] == h, minlength=m)
    wordchars = np.bincount(wl, weights=we - ws, minlength=m)
    longest = np.zeros(m, np.int64)
    np.maximum.at(longest, wl, we - ws)
    key = (wl.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    key.sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(first)
    runs, line_of = np.diff(np.append(starts, len(key))), (key[starts] >> np.uint64(40)).astype(np.int64)
    most, distinct = np.zeros(m, np.int64), np.bincount(line_of, minlength=m)
    np.maximum.at(most, line_of, runs)
    # first and last filled characters
    where = np.flatnonzero(filled)
    a = where[np.searchsorted(where, begin)]
    z = where[np.searchsorted(where, stop) - 1]
    zc, zk = code[z], cls[z]
    close = np.isin(zc, [41, 34, 39, 0x201D, 0x2019, 93, 0xBB]) & (z > a)
    zc, zk = np.where(close, code[z - 1], zc), np.where(close, cls[z - 1], zk)
    ends = np.select([zk == 7, zc == 59, zc == 44, zc == 58, (zk >= 1) & (zk <= 3), zk == 4], [1, 2, 3, 4, 5, 6], 0).astype(np.uint8)
    pad = lambda i: np.minimum(a + i, n - 1)
    c0, c1, c2 = code[a], code[pad(1)], code[pad(2)]
    nums = cls[a] == 4
    k = a.copy()
    for _ in range(5):
        step = nums & (cls[np.minimum(k, n - 1)] == 4) & (k < n - 1)
        k = np.where(step, k + 1, k)
    after = code[np.minimum(k, n - 1)]
    bullet = np.select(
        [np.isin(c0, [45, 42, 43, 0x2022, 0x2023, 0x25E6, 0x2013]) & (c1 == 32), nums & ((after == 46) | (after == 41)) & (cls[np.minimum(k + 1, n - 1)] == 5), (cls[a] == 1) & ((c1 == 41) | (c1 == 46)) & (c2 == 32), c0 == 35, np.isin(c0, [124, 60, 91, 123])],
        [1, 2, 3, 4, 5], 0,
    ).astype(np.uint8)
    # the same line again in its document
    lh = low.of(a, z + 1) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inv, cnt = np.unique(lh, return_inverse=True, return_counts=True)
    w1 = np.maximum(nwords, 1)
    f = np.stack(
        [
            bullet, ends, np.where(nwords < 5, 0, 1 + 6 * _bins(nwords, 9, 16) + _bins(commons / w1, 1e-9, 0.08, 0.16, 0.26, 0.4)), _bins((seps + gaps) / w1, 1e-9, 0.1, 0.3, 0.6, 0.95), _bins(np.maximum(np.maximum(tabs, pipes), gaps), 1, 2, 4, 8),
            _bins(symbols / chars, 1e-9, 0.02, 0.06, 0.15, 0.35, 0.8), _bins(digits / chars, 1e-9, 0.04, 0.1, 0.25, 0.5), _bins(nwords, 1, 3, 5, 9, 18), _bins(np.where(nwords > 3, most / w1, 0), 0.12, 0.25, 0.5, 0.8),
            np.where(nwords < 8, 0, 1 + _bins(distinct / w1, 0.3, 0.6)), _bins(np.maximum(wordchars / w1, 0), 3, 4.3, 5.6, 7.5, 15), _bins(odd / chars, 1e-9, 0.01, 0.05, 0.2), _bins(inside / w1, 1e-9, 0.05, 0.15, 0.5),
            np.where(letters == 0, 0, np.where(cls[a] == 2, np.where(uppers > 0.6 * letters, 3, 1), 2)), _bins(cnt[inv], 2, 4), np.where(nwords > 9, 0, np.where((c0 == 35) | (commons == 0), 1, 2)), _bins(commas / w1, 1e-9, 0.12, 0.3, 0.7),
        ],
        axis=1,
    ).astype(np.uint8)
    line = np.searchsorted(physical, begin, "right")
    fresh = np.append(True, line[1:] != line[:-1])
    stops = ((zk == 7) & np.append(fresh[1:], True)).astype(np.int64)
    return {"doc": doc, "chars": chars, "f": f, "words": nwords, "letters": wordchars, "symbols": symbols + odd + seps, "commons": commons, "stops": stops, "runs": fresh.astype(np.int64)}


class Model:
    """Log probabilities: start (4), step (4, 4), emission per feature (4, values)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emission: list[np.ndarray]):
        self.start, self.step, self.emission = start, step, emission

    def scores(self, f: np.ndarray) -> np.ndarray:
        """Log likelihood of each line under each state; features are dependent, so their sum is damped."""
        out = np.zeros((len(f), len(STATES)))
        for k, e in enumerate(self.emission):
            out += e.T[f[:, k]] * WEIGHTS.get(NAMES[k], DAMP)
        return out

    def viterbi(self, f: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The state of each line; lines of a document are adjacent."""
        if not len(f):
            return np.zeros(0, np.int8)
        s = self.scores(f)
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        size = np.diff(np.append(first, len(doc)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        back = np.zeros((len(f), len(STATES)), np.int8)
        v = self.start + s[first]
        last = v.copy()
        for t in range(1, size[0]):
            n = np.searchsorted(-size, -t, "left")  # documents with more than t lines
            via = v[:n, :, None] + self.step
            back[first[:n] + t] = via.argmax(1)
            v = via.max(1) + s[first[:n] + t]
            last[:n] = v
        path = np.zeros(len(f), np.int8)
        state = last.argmax(1)
        path[first + size - 1] = state
        for t in range(size[0] - 1, 0, -1):
            n = np.searchsorted(-size, -t, "left")
            state[:n] = back[first[:n] + t, state[:n]]
            path[first[:n] + t - 1] = state[:n]
        return path


#: Prior of a prose line in a document labelled otherwise, in training.
PROSE_INSIDE = 0.02
#: Weight of the summed log emissions, as the features of a line are not independent.
DAMP = 0.6
#: Features that tell most on their own count in full or more.
WEIGHTS = {"common": 1.0, "odd": 2.0}
NAMES = tuple(FEATURES)


def train(docs: list[tuple[int, np.ndarray]], rounds: int = 4) -> Model:
    """Fits the model to (label, features of the lines in order) of labelled documents; lines may be of the label or prose.

    A prose document may hold lines of any kind. Without labels of a kind its emissions stay flat, so it is never chosen over one that explains lines.
    """
    k = len(STATES)
    sizes = list(FEATURES.values())
    docs = [(label, f) for label, f in docs if len(f)]
    allowed = np.zeros((k, k))
    allowed[:, 0] = PROSE_INSIDE
    allowed[np.arange(k), np.arange(k)] = 1
    allowed[0] = 1
    with np.errstate(divide="ignore"):
        mask = np.log(allowed)
    resp = []
    for label, f in docs:
        r = np.full((len(f), k), 0.0)
        r[:, label] = 0.9
        r[:, 0] += 0.1
        resp.append(r)
    step_counts = np.eye(k) * 8 + 1.0
    start_counts = np.ones(k)
    model = None
    for turn in range(rounds):
        if turn:
            resp, step_counts, start_counts = [], np.ones((k, k)) * 0.5 + np.eye(k), np.ones(k)
            for label, f in docs:
                s = model.scores(f) + mask[label]
                g, x = _forward_backward(s, model.start, model.step)
                resp.append(g)
                step_counts += x
                start_counts += g[0]
        allf, allr = (np.concatenate([f for _, f in docs]), np.concatenate(resp)) if docs else (np.zeros((0, len(sizes)), np.uint8), np.zeros((0, k)))
        emission = []
        for j, size in enumerate(sizes):
            c = np.stack([np.bincount(allf[:, j], weights=allr[:, s], minlength=size) for s in range(k)]) + 0.5
            emission.append(np.log(c / c.sum(1, keepdims=True)))
        model = Model(np.log(start_counts / start_counts.sum()), np.log(step_counts / step_counts.sum(1, keepdims=True)), emission)
    return model


def _forward_backward(s: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, k = s.shape
    e = np.exp(s - s.max(1, keepdims=True))
    a, b, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    p, t0 = np.exp(step), np.exp(start)
    for t in range(n):
        v = (t0 if t == 0 else a[t - 1] @ p) * e[t]
        scale[t] = v.sum() or 1e-300
        a[t] = v / scale[t]
    for t in range(n - 2, -1, -1):
        b[t] = p @ (e[t + 1] * b[t + 1]) / scale[t + 1]
    g = a * b
    g /= np.maximum(g.sum(1, keepdims=True), 1e-300)
    x = p * (a[:-1].T @ (e[1:] * b[1:] / scale[1:, None])) if n > 1 else np.zeros((k, k))
    return g, x


def _sampled(f: np.ndarray, doc_id: int) -> np.ndarray:
    """TRAIN_LINES lines in a row, from a place that depends on the id alone; all of a shorter document."""
    spare = len(f) - TRAIN_LINES
    at = int(mix(np.array([doc_id], np.int64).view(np.uint64))[0] % np.uint64(spare + 1)) if spare > 0 else 0
    return f[at : at + TRAIN_LINES]


def fit(documents: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    """Trains on at most `limit` labelled documents of `documents` (doc_id, text); features are computed by the executors."""
    chosen = labels.filter(F.col("text_kind").isin(*STATES)).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for i, j in pieces(texts):
                x = lines(texts[i:j])
                edge = np.searchsorted(x["doc"], np.arange(j - i + 1))
                part = [_sampled(x["f"][edge[k] : edge[k + 1]], int(b["doc_id"].iloc[i + k])).tobytes() for k in range(j - i)]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j], "kind": b["text_kind"].iloc[i:j], "f": part})

    rows = documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "text_kind")), "doc_id").mapInPandas(features, "doc_id long, kind string, f binary")
    found = sorted((r["doc_id"], STATES.index(r["kind"]), bytes(r["f"])) for r in rows.toLocalIterator())
    return train([(k, np.frombuffer(f, np.uint8).reshape(-1, len(FEATURES))) for _, k, f in found])


STATISTICS = (
    "doc_id long, n_lines int, n_words long, mean_word_length double, symbol_ratio double, stop_line_share double, common_word_share double, "
    "prose_share double, list_share double, table_share double, junk_share double, kind string"
)


def statistics(documents: DataFrame, model: Model) -> DataFrame:
    """STATISTICS of each row of documents (doc_id, text), without a shuffle but to spread a small input. Shares of labels are of non-blank characters."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for i, j in pieces(texts):
                yield _statistics(b["doc_id"].iloc[i:j].to_numpy(), texts[i:j], held.value)

    return spread(documents.select("doc_id", "text")).mapInPandas(run, STATISTICS)


def _statistics(ids: np.ndarray, texts: list[str], model: Model) -> pd.DataFrame:
    x = lines(texts)
    n, doc = len(texts), x["doc"]
    state = model.viterbi(x["f"], doc)
    per = lambda w: np.bincount(doc, weights=w, minlength=n)
    chars, nlines, nwords = per(x["chars"]), per(x["runs"]), per(x["words"])
    with np.errstate(divide="ignore", invalid="ignore"):
        shares = np.stack([per(x["chars"] * (state == s)) / chars for s in range(len(STATES))], 1)
        out = {
            "doc_id": ids, "n_lines": nlines.astype(np.int32), "n_words": nwords.astype(np.int64), "mean_word_length": per(x["letters"]) / nwords, "symbol_ratio": per(x["symbols"]) / chars,
            "stop_line_share": per(x["stops"]) / nlines, "common_word_share": per(x["commons"]) / nwords, **{f"{s}_share": shares[:, k] for k, s in enumerate(STATES)},
        }
    kind = np.array(STATES, object)[np.nan_to_num(shares).argmax(1)]
    kind[chars == 0] = None
    return pd.DataFrame({k: pd.array(v, "Float64") if np.asarray(v).dtype == np.float64 else v for k, v in out.items()} | {"kind": kind})
