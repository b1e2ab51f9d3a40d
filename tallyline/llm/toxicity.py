"""Toxicity scores by a bidirectional gated recurrent network in numpy.

Every word enters as two vectors: one of its hashed spelling as a word, one the
mean of its hashed character 3- and 5-grams. Two gated recurrent layers read a
window of words in both directions, attention pools their states, and a logistic
unit scores the window. A text's score is the largest score of its overlapping
windows (64 words, a new one every 48, the last one ending with the text),
rescaled on labelled texts kept apart from the gradient.

Training uses at most ``toxic_rows`` and ``clean_rows`` labelled whole texts, chosen by a
hash of the id. A first network is trained on a few evenly spaced windows of each, later ones
on the window that the network before them scores highest among all windows of the text.
Scoring and rescaling go over all windows of all texts.

Defined results: a NULL or empty text has no window and score 0. Without labelled
texts of both classes nothing can be learned and every score is 0. Labels of one id
that differ count as toxic; NULL labels are not used. Repeated rows are scored
again. An empty table gives an empty result. :func:`keep_clean` returns the columns it was
given, whatever their names; :func:`score` reads id and text only.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import batches_of, held_out, texts
from tallyline.session import materialize

WORD_BUCKETS = 1 << 14
GRAM_BUCKETS = 1 << 15
GRAMS = (3, 5)
SIZE = 8  # of word vectors, gram vectors, each direction's state, attention
WINDOW, STRIDE = 64, 48
MEMORY = 150_000  # words whose projections a worker remembers
WINDOWS_AT_ONCE = 1024


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample, and settings of the optimiser. In the first of
    ``rounds`` a text is trained by ``first_windows`` of its windows, from then on by the
    window that scores highest among all of them."""
    toxic_rows: int = 1000
    clean_rows: int = 4000
    rounds: int = 3
    first_windows: int = 4
    held_apart: float = 0.25  # of the sample, for the rescaling
    passes: int = 3
    least_steps: int = 300  # small samples get more passes
    batch: int = 128
    rate: float = 0.01
    seed: int = 3


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def window_starts(n: int) -> list[int]:
    """Starts of the windows that cover ``n`` words."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


@dataclass
class WordInputs:
    """Hashed buckets of some words: one per word, and all of its grams."""
    word: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> WordInputs:
        framed = [b"^" + w + b"$" for w in words]
        sizes = np.array([len(w) for w in framed], dtype=np.int64)
        raw = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(len(words)), sizes)
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw))  # bytes left in the word
        found, owners = [], []
        for n in GRAMS:
            at = np.flatnonzero(room >= n)
            h = np.full(len(at), n, dtype=np.uint32)
            for j in range(n):
                h = (h ^ raw[at + j]) * np.uint32(16777619)
            found.append((h ^ (h >> np.uint32(15))) % np.uint32(GRAM_BUCKETS))
            owners.append(owner[at])
        who = np.concatenate(owners)
        order = np.argsort(who, kind="stable")
        count = np.bincount(who, minlength=len(words))
        word = np.array([zlib.crc32(w.strip(b".,;:!?\"'()")) % WORD_BUCKETS for w in words], dtype=np.int64)
        return cls(word, np.concatenate(found)[order].astype(np.int64), np.cumsum(count) - count, count)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = x * np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def _sum_at(index: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
    """Add ``rows`` to the rows of ``into`` that ``index`` names."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    starts = np.flatnonzero(np.diff(index, prepend=-1))
    into[index[starts]] += np.add.reduceat(rows[order], starts, axis=0)


@dataclass
class Network:
    """Parameters by name, all float32."""
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def new(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def draw(*shape, by=None):
            return (rng.standard_normal(shape) * (by or 1 / np.sqrt(shape[-2]))).astype(np.float32)

        s = SIZE
        return cls({
            "word": draw(WORD_BUCKETS, s, by=0.02), "gram": draw(GRAM_BUCKETS, s, by=0.05),
            "W": draw(2 * s, 6 * s), "b": np.zeros(6 * s, np.float32), "U": draw(2, s, 3 * s),
            "A": draw(2 * s, s), "a": np.zeros(s, np.float32), "v": draw(s, 1)[:, 0],
            "o": draw(2 * s, 1)[:, 0], "c": np.zeros(1, np.float32)})

    def vectors(self, x: WordInputs) -> np.ndarray:
        grams = np.add.reduceat(self.p["gram"][x.gram], x.first, axis=0)
        grams /= x.count[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][x.word], grams], axis=1)

    def projections(self, x: WordInputs) -> np.ndarray:
        """Input part of the gates of both directions, per word."""
        return self.vectors(x) @ self.p["W"] + self.p["b"]

    def forward(self, table: tuple, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Window logits. ``table``: projections per word for either direction,
        ``at``: (windows, places) rows of them, ``mask``: which places hold words."""
        n, places, s = at.shape[0], at.shape[1], SIZE
        ahead, behind = table
        states = np.zeros((places + 1, 2, n, s), np.float32)
        x = np.empty((2, n, 3 * s), np.float32)
        order = np.ascontiguousarray(at.T)
        gates = []
        whole = bool(mask.all())
        for t in range(places):
            back = places - 1 - t
            np.take(ahead, order[t], axis=0, out=x[0], mode="clip")
            np.take(behind, order[back], axis=0, out=x[1], mode="clip")
            h = states[t]
            inner = np.matmul(h, self.p["U"])
            zr = _sigmoid(x[..., :2 * s] + inner[..., :2 * s])
            z, r = zr[..., :s], zr[..., s:]
            new = np.tanh(x[..., 2 * s:] + r * inner[..., 2 * s:])
            out = h - new
            out *= z
            out += new
            if not whole:
                m = np.stack([mask[:, t], mask[:, back]])[..., None]
                out = np.where(m, out, h)
            states[t + 1] = out
            if keep:
                gates.append((z, r, new, inner[..., 2 * s:]))
        both = np.concatenate([states[1:, 0], states[1:, 1][::-1]], axis=2)  # places, windows, 2 s
        u = np.tanh(both @ self.p["A"] + self.p["a"])
        e = np.where(mask.T, u @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (weight[..., None] * both).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return (logit, (states, gates, both, u, weight, pooled)) if keep else logit

    def gradients(self, x: WordInputs, at: np.ndarray, mask: np.ndarray, target: np.ndarray):
        """Mean logistic loss of some windows and its gradient by parameter."""
        p, s = self.p, SIZE
        vec = self.vectors(x)
        table = vec @ p["W"] + p["b"]
        halves = (np.ascontiguousarray(table[:, :3 * s]), np.ascontiguousarray(table[:, 3 * s:]))
        logit, (states, gates, both, u, weight, pooled) = self.forward(halves, at, mask, keep=True)
        prob = _sigmoid(logit)
        g = {k: np.zeros_like(a) for k, a in p.items()}
        d = ((prob - target) / len(target)).astype(np.float32)
        g["o"], g["c"][0] = pooled.T @ d, d.sum()
        d_pool = d[:, None] * p["o"]
        d_weight = (both * d_pool).sum(axis=2)
        d_both = weight[..., None] * d_pool
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.tensordot(d_e, u, axes=([0, 1], [0, 1]))
        d_u = d_e[..., None] * p["v"] * (1 - u * u)
        g["A"] = np.tensordot(both, d_u, axes=([0, 1], [0, 1]))
        g["a"] = d_u.sum(axis=(0, 1))
        d_both = d_both + d_u @ p["A"].T
        d_states = np.stack([d_both[..., :s], d_both[::-1][..., s:]], axis=1)
        d_ahead = np.empty((at.shape[1], len(target), 3 * s), np.float32)
        d_behind = np.empty_like(d_ahead)
        d_h = np.zeros((2, len(target), s), np.float32)
        turn = np.transpose(p["U"], (0, 2, 1))
        places = at.shape[1]
        for t in reversed(range(places)):
            z, r, new, inner = gates[t]
            h, back = states[t], places - 1 - t
            m = np.stack([mask[:, t], mask[:, back]])[..., None]
            d_out = d_h + d_states[t]
            d_live = d_out * m
            d_new = d_live * (1 - z) * (1 - new * new)
            d_z = d_live * (h - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=2)
            d_in = np.concatenate([d_z, d_r, d_new * r], axis=2)
            g["U"] += np.matmul(np.transpose(h, (0, 2, 1)), d_in)
            d_h = d_out * (1 - m) + d_live * z + np.matmul(d_in, turn)
            d_ahead[t], d_behind[back] = d_x
        flat = np.zeros_like(table)
        _sum_at(at.T.ravel(), np.concatenate([d_ahead, d_behind], axis=2).reshape(-1, 6 * s), flat)
        g["W"], g["b"] = vec.T @ flat, flat.sum(axis=0)
        d_vec = flat @ p["W"].T
        _sum_at(x.word, d_vec[:, :s], g["word"])
        _sum_at(x.gram, np.repeat(d_vec[:, s:] / x.count[:, None].astype(np.float32), x.count, axis=0), g["gram"])
        loss = -np.mean(np.where(target > 0.5, np.log(prob + 1e-9), np.log(1 - prob + 1e-9)))
        return float(loss), g


def _laid_out(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words, places of the windows' words among them, and the mask."""
    index: dict[bytes, int] = {}
    longest = max(map(len, windows))
    at = np.zeros((len(windows), longest), dtype=np.int64)
    mask = np.zeros((len(windows), longest), dtype=bool)
    for k, words in enumerate(windows):
        at[k, :len(words)] = [index.setdefault(w, len(index)) for w in words]
        mask[k, :len(words)] = True
    return list(index), at, mask


def train(sample: list[tuple[list[list[bytes]], int]], how: Training = Training()) -> Network | None:
    """Fit a network to (windows of a text, label) pairs; None without both labels."""
    if len({label for _, label in sample}) < 2:
        return None
    rng = np.random.default_rng(how.seed)
    net = Network.new(how.seed)
    data = sorted(((w, label) for windows, label in sample for w in windows), key=lambda d: len(d[0]))
    first = {k: np.zeros_like(a) for k, a in net.p.items()}
    second = {k: np.zeros_like(a) for k, a in net.p.items()}
    starts = list(range(0, len(data), how.batch))
    passes = max(how.passes, -(-how.least_steps // max(1, len(starts))))
    step, last = 0, max(1, passes * len(starts))
    for _ in range(passes):
        for start in rng.permutation(starts):
            batch = data[start:start + how.batch]
            words, at, mask = _laid_out([w for w, _ in batch])
            target = np.array([label for _, label in batch], np.float32)
            _, g = net.gradients(WordInputs.of(words), at, mask, target)
            step += 1
            rate = how.rate * (1 - 0.9 * step / last)
            for k, grad in g.items():
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.01 * (grad * grad - second[k])
                fixed = (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)
                net.p[k] -= (rate * fixed).astype(np.float32)
    return net


def _rescale(net: Network, best: np.ndarray, target: np.ndarray, share: float | None,
             rounds: int = 30, ridge: float = 1e-3) -> None:
    """Logistic fit of the labels ``target`` by ``best``, the largest window logit of each
    whole text, with the classes weighted as if ``share`` of the texts were toxic."""
    share = float(target.mean()) if share is None else share
    weight = np.where(target > 0.5, share / target.mean(), (1 - share) / (1 - target.mean()))
    x = np.stack([best, np.ones_like(best)], axis=1)
    fit = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        slope = x.T @ (weight * (p - target)) + ridge * fit
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        move = np.linalg.solve(bend, slope)
        fit = fit - move / max(1.0, np.abs(move).max())
    net.scale, net.shift = max(float(fit[0]), 1e-3), float(fit[1])


class Scorer:
    """Scores texts, remembering the projections of words already met."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = tuple(np.zeros((4096, 3 * SIZE), np.float32) for _ in range(2))

    def _rows(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.place))
        if len(self.place) + len(new) > MEMORY and self.place:
            self._forget()
            new = list(set(words))
        if new:
            at = len(self.place)
            room = len(self.table[0])
            if at + len(new) > room:
                more = np.zeros((max(at + len(new) - room, room), 3 * SIZE), np.float32)
                self.table = tuple(np.concatenate([half, more]) for half in self.table)
            for k in range(0, len(new), 20_000):
                part = new[k:k + 20_000]
                made = self.net.projections(WordInputs.of(part))
                for half, columns in zip(self.table, (made[:, :3 * SIZE], made[:, 3 * SIZE:])):
                    half[at + k:at + k + len(part)] = columns
            self.place.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))

    def _windows(self, lists: list[list[bytes]]):
        """(owner, start, logit) of every window of the texts with these words, in arrays."""
        rows = self._rows([w for words in lists for w in words])
        short, whole, start = [], [], 0
        for k, words in enumerate(lists):
            n = len(words)
            if n < WINDOW:
                short += [(k, 0, start, n)] if n else []
            else:
                whole += [(k, s, start + s, WINDOW) for s in window_starts(n)]
            start += n
        short.sort(key=lambda w: w[3])
        for group in (short, whole):
            for i in range(0, len(group), WINDOWS_AT_ONCE):
                owner, begins, first, sizes = (np.array(c) for c in zip(*group[i:i + WINDOWS_AT_ONCE]))
                step = np.arange(int(sizes.max()))
                mask = step < sizes[:, None]
                at = rows[np.where(mask, first[:, None] + step, 0)]
                yield owner, begins, self.net.forward(self.table, at, mask)

    def logits(self, batch: list[str]) -> list[float]:
        """The largest window logit of each text, -inf without a window."""
        best = np.full(len(batch), -np.inf)
        for owner, _, found in self._windows([words_of(t) for t in batch]):
            np.maximum.at(best, owner, found)
        return best.tolist()

    def tops(self, batch: list[str]) -> list[tuple[float, list[bytes]] | None]:
        """The largest window logit of each text and the first window that has it."""
        lists = [words_of(t) for t in batch]
        found = list(self._windows(lists))
        out: list[tuple[float, list[bytes]] | None] = [None] * len(batch)
        if found:
            owner, begins, logits = (np.concatenate(part) for part in zip(*found))
            # by text, then falling logit, then place: the first row of each text is its best
            order = np.lexsort((begins, -logits, owner))
            for i in order[np.concatenate([[True], np.diff(owner[order]) > 0])].tolist():
                out[owner[i]] = float(logits[i]), lists[owner[i]][begins[i]:begins[i] + WINDOW]
        return out

    def scores(self, batch: list[str]) -> list[float]:
        x = np.array(self.logits(batch)) * self.net.scale + self.net.shift
        return (1 / (1 + np.exp(-np.clip(x, -60, 60))) * np.isfinite(x)).tolist()


def _text_groups(column, limit: int = 1 << 19):
    """Groups of texts of about ``limit`` characters."""
    held, size = [], 0
    for text in texts(column):
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    label, key = F.col(f"`{label_col}`"), F.col(f"`{id_col}`")
    return (labels.where(label.isNotNull() & key.isNotNull())
            .groupBy(key.alias("id")).agg(F.max(label.cast("int")).alias("label")))


def labelled_sample(df: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, label) of a bounded number of labelled whole texts, written out. The
    ids are chosen from the labels alone, so the join's small side is at most
    ``toxic_rows + clean_rows`` rows, and texts are not shuffled."""
    known = _known(labels, id_col, label_col)
    order = [F.xxhash64(F.lit(how.seed), "id"), F.col("id")]
    chosen = (known.where("label = 1").orderBy(*order).limit(how.toxic_rows)
              .union(known.where("label = 0").orderBy(*order).limit(how.clean_rows)))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    picked = rows.join(F.broadcast(chosen), "id").select(F.col("id").cast("string").alias("id"), "text", "label")
    return materialize(picked, "toxicity-sample")


def _cut(sample: DataFrame, limit: int, net: Network | None, windows: int) -> list[dict]:
    """(id, label, logit, windows) of the sampled texts with words, in a fixed order: a
    few evenly spaced windows each, or with ``net`` the best of all windows and its logit.
    Tasks read the whole texts; what comes back is bounded by texts and windows."""
    out = pa.schema([("id", pa.string()), ("label", pa.int32()), ("logit", pa.float64()),
                     ("windows", pa.list_(pa.binary()))])
    shared = sample.sparkSession.sparkContext.broadcast(net)

    def spread(words):
        starts = window_starts(len(words))
        if len(starts) > windows:
            starts = [starts[k * len(starts) // windows] for k in range(windows)]
        return [b" ".join(words[s:s + WINDOW]) for s in starts]

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            def cut():
                ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                done = 0
                for group in _text_groups(batch.column(1)):
                    tops = scorer.tops(group) if scorer else [(0.0, None)] * len(group)
                    for text, top in zip(group, tops):
                        if top:
                            parts = [b" ".join(top[1])] if scorer else spread(words_of(text))
                            if parts:
                                yield ids[done], labels[done], top[0], parts
                        done += 1

            yield from batches_of(cut(), out, 256)

    found = sample.mapInArrow(run, "id string, label int, logit double, windows array<binary>").toArrow().to_pylist()
    shared.unpersist()
    found.sort(key=lambda r: (zlib.crc32(r["id"].encode()), r["id"], r["windows"]))
    found = found[:limit]  # repeated ids may give more texts
    for r in found:
        r["windows"] = [w.split() for w in r["windows"]]
    return found


def fit(df: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """Train on labelled texts of ``df``.

    The first network is trained on evenly spaced windows. Every later one is trained on
    the best window of each text, found by the network before it among all windows, as
    the score of a text is that of its best window; clean texts keep their first
    windows besides. A share of the texts is held apart, and their largest logits over
    all windows fit the scale on which 0.5 parts the labels.
    """
    share = _known(labels, id_col, label_col).agg(F.avg("label")).first()[0]
    sample = labelled_sample(df, labels, how, id_col, text_col, label_col)
    limit = how.toxic_rows + how.clean_rows
    first = _cut(sample, limit, None, how.first_windows)
    if len({r["label"] for r in first}) < 2:
        return None
    # texts are held apart by a hash of the id, the same in every round
    apart = {r["id"] for r in first if zlib.crc32(r["id"].encode(), how.seed) % 1000 < 1000 * how.held_apart}
    used = [r for r in first if r["id"] not in apart]
    if len({r["label"] for r in used}) < 2:
        apart, used = set(), first
    net = train([(r["windows"], r["label"]) for r in used], how)
    clean = [(r["windows"], 0) for r in used if not r["label"]]
    for _ in range(how.rounds - 1):
        tops = [r for r in _cut(sample, limit, net, 1) if r["id"] not in apart]
        net = train([(r["windows"], r["label"]) for r in tops] + clean, how)
    every = _cut(sample, limit, net, 1)
    judged = [r for r in every if r["id"] in apart]
    judged = judged if len({r["label"] for r in judged}) == 2 else every
    _rescale(net, np.array([r["logit"] for r in judged]), np.array([r["label"] for r in judged], np.float64), share)
    return net


def score(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [s for group in _text_groups(batch.column(1)) for s in scorer.scores(group)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())],
                                             names=["doc_id", "score"])

    return rows.mapInArrow(run, schema)


def keep_clean(df: DataFrame, net: Network | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, with the columns of ``df``."""
    if net is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(net)
    at = df.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [s for group in _text_groups(batch.column(at)) for s in scorer.scores(group)]
            yield batch.filter(pa.array([s < threshold for s in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def training_labels(labels: DataFrame, id_col: str = "doc_id", modulus: int = 5, remainder: int = 0) -> DataFrame:
    """The rows of ``labels`` that may be learned from."""
    return labels.where(~held_out(id_col, modulus, remainder))
