"""Language-model scores by a hidden Markov model over words.

Words (and one end mark per text) are emitted by latent states. A word is emitted
through its class: the ``own_classes`` most frequent training words are classes of
their own, every other word belongs to one of ``shared_classes`` classes by hash and
has a share of its class in each state: (N q + 1) / (N + V + 1), with N and V the
words and different words of the class in training and q the word's part of the
class's expected count in the state. Before the first step q is c / N, with c the
word's count. A word that the class has never seen has the share 1 / (N + V + 1),
so the probabilities of a text's continuations add up to 1.

Training is Baum-Welch: tasks run the scaled forward-backward recursion over their
texts, and the expected counts per word and state are summed by Spark, where they
meet with what other tasks found. Every training word has counts of its own. The
driver gets those of the frequent words, of the classes and of the moves, whose
number is bounded. Those of all other words stay in tables: texts are held in
blocks of about ``block_tokens`` words, a word met once in the whole input has its
counts beside its block, and of every other word the blocks send their sums, one
entry per block and word, to the word's bucket and get the total back. Long texts
are cut into sequences of ``train_piece`` words for training only. Scoring runs the
scaled forward recursion over every whole text, so a score is the exact likelihood
of the text under the model.

Counts of frequent words (``known_words``, a bound) travel to the tasks. Those of all
other words are joined by word once, whatever their number, so none is left out.

Defined results: a NULL or empty text is the end mark alone. Without training texts
all counts are 0, and every state emits every class alike. Repeated rows are
counted and scored each. An empty table gives an empty result. Columns other than id, text and
those of the training condition, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat, tee

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import batches_of, raw_texts
from tallyline.session import drop_table, materialize

END = ""  # no word is empty
LONGEST_KNOWN = 64  # bytes of a word that travels to the tasks
BATCH_BYTES = 4 << 20  # sent to Python at once
BOUNDED_ROWS = 1 << 13  # known words, classes and moves whose counts are summed together,
BOUNDED_TASKS = 256  # and tasks whose sums are added first


@dataclass(frozen=True)
class Shape:
    """Size and training of the model."""
    states: int = 8
    own_classes: int = 16_384
    shared_classes: int = 2048
    known_words: int = 131_072
    steps: int = 5
    train_piece: int = 256
    sticky: float = 0.8
    smoothing: float = 20.0
    seed: int = 17
    block_tokens: int = 1 << 16  # a block of texts ends with the text that reaches them
    bucket_words: int = 500_000  # occurrences of the words of a bucket, about

    @property
    def classes(self) -> int:
        return self.own_classes + self.shared_classes


def words_of(raw: bytes) -> list[bytes]:
    """A-Z in lower case; runs of anything but blanks (9 to 13 and 32)."""
    return raw.lower().split()


def _rows(df: DataFrame, id_col: str, text_col: str, training) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                     (~training).alias("held_out"))


def word_counts(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """(word, c, apart) over the texts of ``rows``: how often training texts and how
    often texts held out have the word; the end mark is the empty word. Tasks count
    first and pass on what they hold when ``most`` words are reached."""
    def run(batches):
        out = pa.schema([("word", pa.string()), ("c", pa.int64()), ("apart", pa.int64())])
        counts: dict[bool, Counter] = {False: Counter(), True: Counter()}

        def flush():
            for apart, held in counts.items():
                words = list(held)
                for k in range(0, len(words), 50_000):
                    part = words[k:k + 50_000]
                    found, none = pa.array([held[w] for w in part], pa.int64()), pa.array([0] * len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.binary()).cast(pa.string()), *((none, found) if apart else (found, none))],
                        schema=out)
                held.clear()

        for batch in batches:
            for raw, apart in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
                held = counts[apart]
                held.update(words_of(raw))
                held[b""] += 1
                if len(held) >= most:
                    yield from flush()
        yield from flush()

    return (rows.select("text", "held_out")
            .mapInArrow(run, "word string, c bigint, apart bigint")
            .groupBy("word").agg(F.sum("c").alias("c"), F.sum("apart").alias("apart")))


@dataclass
class Vocabulary:
    """What tasks need to know of the training words; bounded by ``Shape``."""
    shape: Shape
    place: dict[bytes, int]  # rank by count; below own_classes it is the class
    logs: np.ndarray  # log10(c + 1) by rank
    share_logs: np.ndarray  # log10(N + V + 1) by shared class
    weights: np.ndarray  # training words by class
    total: int
    different: int

    def shared_class(self, word: bytes) -> int:
        return self.shape.own_classes + zlib.crc32(word) % self.shape.shared_classes

    def classes_by_rank(self) -> np.ndarray:
        own = self.shape.own_classes
        return np.array([i if i < own else self.shared_class(w) for w, i in self.place.items()], dtype=np.int64)


def vocabulary(counts: DataFrame, shape: Shape) -> Vocabulary:
    """Bounded summary of the full table ``counts`` (word, c), which is written out."""
    short = counts.where(F.octet_length("word") <= LONGEST_KNOWN)
    level, least, n = F.floor(16 * F.log2("c")), None, 0  # each task would send as many words as are wanted
    for r in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):
        if n < shape.known_words:
            least, n = r[0], n + r[1]
    top = [(r[0], r[1]) for r in short.where(level >= F.lit(least))
           .orderBy(F.desc("c"), "word").limit(shape.known_words).collect()]
    size = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    place = {w.encode(): i for i, (w, _) in enumerate(top)}
    own = top[:shape.own_classes]
    bucket = (F.crc32(F.col("word").cast("binary")) % shape.shared_classes).alias("bucket")
    table = counts.groupBy(bucket).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = np.zeros(shape.shared_classes, np.int64), np.zeros(shape.shared_classes, np.int64)
    for r in table:
        n[r[0]], v[r[0]] = r[1], r[2]
    for word, c in own:  # words with a class of their own leave the shared one
        k = zlib.crc32(word.encode()) % shape.shared_classes
        n[k], v[k] = n[k] - c, v[k] - 1
    weights = np.zeros(shape.classes)
    weights[:len(own)] = [c for _, c in own]
    weights[shape.own_classes:] = n + 1
    return Vocabulary(shape, place, np.log10(np.array([c for _, c in top], dtype=np.float64) + 1),
                      np.log10(n + v + 1.0), weights, int(size[0] or 0), int(size[1]))


def packed(numbers: np.ndarray) -> bytes:
    """Count and numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers).reshape(-1).view(np.uint8).reshape(-1, numbers.itemsize).T
    return numbers.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, kind) -> np.ndarray:
    kind, n = np.dtype(kind), int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], n * kind.itemsize, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def encoded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The texts in blocks, held out or not: ``texts`` with sums over their known
    words; the block's known words (``ranks``, ascending) and its other ``words`` with
    their shared classes (``kinds``, counted from 0); and the words of the texts, one
    text after the other, as places in ranks followed by words (``ids``)."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        voc = shared.value
        place, own = voc.place, voc.shape.own_classes
        ranked = voc.classes_by_rank()

        class Open:
            def __init__(self, held: bool):
                self.held, self.docs, self.words, self.sizes = held, [], [], []

            def row(self):
                words, known = self.words, len(place)
                ids = np.fromiter(map(place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                missing = np.flatnonzero(ids < 0)
                others: dict[bytes, int] = {}
                ids[missing] = [known + others.setdefault(words[i], len(others)) for i in missing.tolist()]
                used = np.zeros(known + len(others), np.bool_)
                used[ids] = True
                ranks = np.flatnonzero(used[:known])
                ids = (np.cumsum(used) - 1)[ids]
                kinds = np.fromiter((voc.shared_class(w) - own for w in others), dtype=np.int64, count=len(others))
                log_count = np.concatenate([voc.logs[ranks], np.zeros(len(others))])
                log_share = np.concatenate([np.zeros(np.searchsorted(ranks, own)), voc.logs[ranks[ranks >= own]]
                                            - voc.share_logs[ranked[ranks[ranks >= own]] - own],
                                            -voc.share_logs[kinds]])
                firsts = np.cumsum([0, *self.sizes[:-1]])
                texts = zip(self.docs, self.sizes, np.add.reduceat(ids < len(ranks), firsts, dtype=np.int64).tolist(),
                            np.add.reduceat(log_count[ids], firsts).tolist(),
                            np.add.reduceat(log_share[ids], firsts).tolist())
                names = ("doc_id", "n_tokens", "n_found", "log_count", "log_share")
                return (self.held, [dict(zip(names, t)) for t in texts], packed(ids.astype("<u4")),
                        packed(ranks.astype("<u4")), packed(kinds.astype("<u4")), [w.decode() for w in others])

        def blocks():
            nonlocal out
            now = {held: Open(held) for held in (False, True)}
            for batch in batches:
                out = pa.schema([("held_out", pa.bool_()), ("texts", pa.list_(pa.struct(
                    [("doc_id", batch.schema.field(0).type), ("n_tokens", pa.int64()), ("n_found", pa.int64()),
                     ("log_count", pa.float64()), ("log_share", pa.float64())]))), ("ids", pa.binary()),
                    ("ranks", pa.binary()), ("kinds", pa.binary()), ("words", pa.list_(pa.string()))])
                for doc, raw, held in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)),
                                          batch.column(2).to_pylist()):
                    words = words_of(raw)
                    words.append(b"")
                    block = now[held]
                    block.docs.append(doc)
                    block.words += words
                    block.sizes.append(len(words))
                    if len(block.words) >= voc.shape.block_tokens:
                        yield block.row()
                        now[held] = Open(held)
            for rest in now.values():
                if rest.docs:
                    yield rest.row()

        out = None
        for row in blocks():
            yield from batches_of([row], out)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"held_out boolean, texts array<struct<doc_id: {kind}, n_tokens: bigint, "
                           "n_found: bigint, log_count: double, log_share: double>>, ids binary, ranks binary, "
                           "kinds binary, words array<string>")


def with_counts(texts: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """The blocks with what training has met of their other words, in place of the
    words: how often (``times``, 0 if never), and the ``numbers`` of those that more
    than one place of the input has (else -1). Blocks ask by buckets of words."""
    def ask(batches):
        out = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.binary()),
                         ("words", pa.list_(pa.string()))])
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words")):
                words = words.values
                bucket = np.array([zlib.crc32(w) % buckets for w in words.cast(pa.binary()).to_pylist()], np.int64)
                order = np.argsort(bucket, kind="stable")
                different, first = np.unique(bucket[order], return_index=True)
                rows = [(b, block, packed(at.astype("<u4")), words.take(pa.array(at)).to_pylist())
                        for b, at in zip(different.tolist(), np.split(order, first[1:]))]
                yield from batches_of(rows, out)

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            names = ("at", "times", "numbers")
            return pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in names]]).empty_table()
        words = asked.column("words").combine_chunks()
        sizes = _numbers(pc.list_value_length(words)).astype(np.int64)
        at = pc.index_in(words.flatten(), value_set=known.column("word").combine_chunks())
        found, at = _numbers(at.is_valid()), _numbers(at.fill_null(0))
        time, number = np.zeros(len(at), "<i8"), np.full(len(at), -1, "<i8")
        time[found] = _numbers(known.column("c").combine_chunks())[at[found]]
        number[found] = _numbers(known.column("number").combine_chunks())[at[found]]
        return pa.table([asked.column("block"), asked.column("at"),
                         *[pa.array([packed(v) for v in np.split(values, np.cumsum(sizes)[:-1])], pa.binary())
                           for values in (time, number)]], names=["block", "at", "times", "numbers"])

    def place(batches):
        for batch in batches:
            times, numbers = [], []
            for kinds, met in zip(batch.column("kinds").to_pylist(), batch.column("met").to_pylist()):
                n = len(unpacked(kinds, "<u4"))
                time, number = np.zeros(n, "<i8"), np.full(n, -1, "<i8")
                for part in met or []:
                    at = unpacked(part["at"], "<u4")
                    time[at], number[at] = unpacked(part["times"], "<i8"), unpacked(part["numbers"], "<i8")
                times.append(packed(time))
                numbers.append(packed(number))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(times, pa.binary()), pa.array(numbers, pa.binary())],
                names=[*batch.schema.names[:-1], "times", "numbers"])

    asked = texts.select("block", "words").mapInArrow(ask, "bucket int, block bigint, at binary, words array<string>")
    known = counts.select((F.crc32(F.col("word").cast("binary")) % buckets).cast("int").alias("bucket"),
                          "word", "c", "number")
    met = (asked.groupBy("bucket").cogroup(known.groupBy("bucket"))
           .applyInArrow(answer, "block bigint, at binary, times binary, numbers binary")
           .groupBy("block").agg(F.collect_list(F.struct("at", "times", "numbers")).alias("met")))
    kept = texts.drop("words")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.join(met, "block", "left").select(*kept.columns, "met").mapInArrow(
        place, f"{fields}, times binary, numbers binary")


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states: probability of the class in the state

    @classmethod
    def new(cls, vocab: Vocabulary) -> Model:
        """Word frequencies, tilted at random per state; states tend to stay."""
        shape, rng = vocab.shape, np.random.default_rng(vocab.shape.seed)
        k = shape.states
        emit = np.maximum(vocab.weights, 1e-3)[:, None] * rng.gamma(1.0, size=(shape.classes, k))
        move = np.full((k, k), (1 - shape.sticky) / max(1, k - 1))
        np.fill_diagonal(move, shape.sticky if k > 1 else 1.0)
        return cls(np.full(k, 1 / k), move, emit / emit.sum(axis=0))

    def improved(self, vocab: Vocabulary, start, move, emit) -> Model:
        """Maximisation from expected counts, smoothed towards word frequencies."""
        base = vocab.weights / vocab.weights.sum()
        emit = emit + vocab.shape.smoothing * np.maximum(base, 1e-12)[:, None]
        return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True),
                     emit / emit.sum(axis=0))


def _in_step(sequences: list[np.ndarray]):
    """Sequences from long to short as one array in time order: the places of
    step t are ``ends[t]:ends[t + 1]``, of the first sequences."""
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
    firsts = np.cumsum(sizes) - sizes
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    return flat, firsts, active, order


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each whole sequence's probability by the scaled forward recursion."""
    if not sequences:
        return np.zeros(0)
    flat, firsts, active, order = _in_step(sequences)
    total = np.zeros(len(sequences))
    ones = np.ones(model.move.shape[0])
    state = None
    for t, m in enumerate(active.tolist()):
        before = model.start if t == 0 else state[:m] @ model.move
        state = before * model.emit[flat[firsts[:m] + t]]
        scale = state @ ones
        state /= scale[:, None]
        total[:m] += np.log10(scale)
    out = np.empty(len(sequences))
    out[order] = total
    return out


def expected_counts(model: Model, sequences: list[np.ndarray], classes: int):
    """Baum-Welch expectation: counts of first states, moves and emissions."""
    k = model.move.shape[0]
    flat, firsts, active, _ = _in_step(sequences)
    ends = np.concatenate([[0], np.cumsum(active)])
    seen = np.empty(ends[-1], dtype=np.int64)
    alpha = np.empty((ends[-1], k))
    scale = np.empty(ends[-1])
    ones = np.ones(k)
    for t, m in enumerate(active.tolist()):
        here = slice(ends[t], ends[t] + m)
        seen[here] = flat[firsts[:m] + t]
        before = model.start if t == 0 else alpha[ends[t - 1]:ends[t - 1] + m] @ model.move
        state = before * model.emit[seen[here]]
        scale[here] = state @ ones
        alpha[here] = state / scale[here][:, None]
    move = np.zeros((k, k))
    beta = np.ones((active[0], k))
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        here = slice(ends[t], ends[t] + m)
        if t:
            ahead = model.emit[seen[here]] * beta[:m] / scale[here][:, None]
            move += alpha[ends[t - 1]:ends[t - 1] + m].T @ ahead
            alpha[here] *= beta[:m]
            beta[:m] = ahead @ model.move.T
        else:
            alpha[here] *= beta[:m]
    emit = np.stack([np.bincount(seen, weights=alpha[:, s], minlength=classes) for s in range(k)], axis=1)
    return alpha[:active[0]].sum(axis=0), move * model.move, emit


@dataclass
class Learned:
    """What tasks need of the model; bounded by ``Shape``."""
    model: Model  # by class
    known: np.ndarray  # ranks x states: the class's probability times the tilt
    sizes: np.ndarray  # training words by shared class
    found: np.ndarray | None = None  # shared classes x states: expected counts

    @classmethod
    def of(cls, vocab: Vocabulary, model: Model, known: np.ndarray | None = None,
           found: np.ndarray | None = None) -> Learned:
        own, classes = vocab.shape.own_classes, vocab.classes_by_rank()
        self = cls(model, model.emit[classes], vocab.weights[own:] - 1, found)
        if found is not None:
            self.known[own:] *= self.tilt(classes[own:] - own, np.rint(10 ** vocab.logs[own:]) - 1, known[own:])
        return self

    def tilt(self, k: np.ndarray, c: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Shares of words of the shared classes ``k`` in each state, as multiples
        of (c + 1) / (N + V + 1), from the words' expected ``counts``."""
        c = c[:, None]
        return ((self.sizes[k][:, None] * counts + c) / (self.found[k] + 1) + 1) / (c + 1)


def with_found(blocks: DataFrame, sums: DataFrame | None) -> DataFrame:
    """Each of the ``blocks``, a row without ``bucket``, followed by the expected counts
    of its words met in training, a row with ``sums`` for every bucket (-1: words met
    once), in the order of the words."""
    alone = blocks.withColumns({"bucket": F.lit(None).cast("int"), "sums": F.lit(None).cast("binary")})
    if sums is None:
        return alone
    return (alone.unionByName(sums.select("block", "bucket", "sums"), allowMissingColumns=True)
            .repartition("block").sortWithinPartitions("block", F.col("bucket").isNotNull()))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


@dataclass
class Block:
    """A block of texts, whose words are numbered from 0: known ones, then others."""
    block: int
    ranks: np.ndarray  # of the known words
    kinds: np.ndarray  # shared class by other word
    times: np.ndarray  # in training, by other word
    numbers: np.ndarray  # by other word, -1 if no other block has it
    found: dict[int, bytes]  # expected counts by bucket
    sequences: list[np.ndarray] | None = None  # the texts
    texts: pa.StructArray | None = None
    held_out: bool | None = None

    @classmethod
    def rows(cls, batches):
        """The blocks of ``batches``, one at a time, with the texts if they have them."""
        block = None
        for batch in batches:
            names = set(batch.schema.names)
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in
                       ("block", "held_out", "ids", "ranks", "kinds", "times", "numbers", "bucket", "sums")
                       if name in names}
                if row.get("bucket") is not None:
                    block.found[row["bucket"]] = row["sums"]
                    continue
                if block is not None:
                    yield block
                block = cls(row["block"], unpacked(row["ranks"], "<u4").astype(np.int64),
                            unpacked(row["kinds"], "<u4").astype(np.int64), unpacked(row["times"], "<i8"),
                            unpacked(row["numbers"], "<i8"), {}, held_out=row.get("held_out"))
                if "ids" in row:
                    block.texts = batch.column("texts")[i].values
                    ends = np.cumsum(_numbers(block.texts.field("n_tokens")))
                    block.sequences = np.split(unpacked(row["ids"], "<u4").astype(np.int64), ends[:-1])
        if block is not None:
            yield block

    def once(self) -> np.ndarray:
        """Places of the other words that nothing but this block has."""
        return np.flatnonzero((self.times > 0) & (self.numbers < 0))

    def buckets(self, n: int):
        """(bucket, places of its words), for words that other blocks may have too."""
        at = np.flatnonzero(self.numbers >= 0)
        bucket = self.numbers[at] % n
        order = np.argsort(bucket, kind="stable")
        different, first = np.unique(bucket[order], return_index=True)
        return zip(different.tolist(), np.split(at[order], first[1:]))

    def model(self, learned: Learned, n: int) -> Model:
        """The model by the numbers of this block's words."""
        rare = learned.model.emit[len(learned.model.emit) - len(learned.sizes) + self.kinds]
        if learned.found is not None:
            for bucket, at in [(-1, self.once()), *self.buckets(n)]:
                if len(at):
                    sums = unpacked(self.found[bucket], "<f4").reshape(-1, rare.shape[1])
                    rare[at] *= learned.tilt(self.kinds[at], self.times[at].astype(np.float64), sums.astype(np.float64))
        return Model(learned.model.start, learned.model.move, np.concatenate([learned.known[self.ranks], rare]))


def _joined(blocks, models, tokens: int):
    """Blocks and their models, gathered until they have ``tokens`` words: (blocks, one
    model for all, the places in it where theirs begin, sequences by its numbers)."""
    def one():
        starts = np.cumsum([0, *[len(m.emit) for m in ours]])
        return (held, Model(ours[0].start, ours[0].move, np.concatenate([m.emit for m in ours])), starts,
                [s + first for b, first in zip(held, starts) for s in b.sequences])

    held, ours, size = [], [], 0
    for block, model in zip(blocks, models):
        held.append(block)
        ours.append(model)
        size += sum(map(len, block.sequences))
        if size >= tokens:
            yield one()
            held, ours, size = [], [], 0
    if held:
        yield one()


def _pieces(sequences, piece: int):
    for ids in sequences:
        for i in range(0, len(ids), piece):
            yield ids[i:i + piece]


def _gathered(items, tokens: int):
    held, size = [], 0
    for s in items:
        held.append(s)
        size += len(s)
        if size >= tokens:
            yield held
            held, size = [], 0
    if held:
        yield held


def _written_alone(df: DataFrame, name: str) -> DataFrame:
    """:func:`materialize`, whose shuffles are freed as soon as the table is written:
    those of every training step would else stay on disk side by side. Python gets
    its rows, which are long, in small batches."""
    conf = df.sparkSession.conf
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
              "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {key: conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        return materialize(df, name)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


SENT = "bucket int, alone bigint, block bigint, numbers binary, sums binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["bucket", "alone", "block", "numbers", "sums"])


def gathered(blocks: DataFrame, shared, buckets: int, piece: int) -> DataFrame:
    """Expectation over the blocks (with ``found``): rows (bucket, alone, block, numbers,
    sums) of the words of a bucket in a block; with bucket -1 and ``alone`` (the
    block) of the words met once; and with buckets below -1, ``alone`` (some tasks) and
    no block the task's sums of known words, shared classes, first states and moves."""
    def run(batches):
        now = shared.value
        known, k = now.known.shape
        first = known + len(now.sizes)
        counts = np.zeros((first + 1 + k, k))
        blocks, again = tee(Block.rows(batches))
        for group, local, starts, sequences in _joined(blocks, (b.model(now, buckets) for b in again), 100_000):
            sums = np.zeros(local.emit.shape)
            for part in _gathered(_pieces(sequences, piece), 300_000):
                start, move, emit = expected_counts(local, part, len(local.emit))
                sums += emit
                counts[first] += start
                counts[first + 1:] += move
            rows = []
            for block, start, end in zip(group, starts, starts[1:]):
                n = start + len(block.ranks)
                counts[block.ranks] += sums[start:n]
                rare = sums[n:end]
                for s in range(k):
                    counts[known:first, s] += np.bincount(block.kinds, rare[:, s], len(now.sizes))
                rare, once = rare.astype("<f4"), block.once()
                if len(once):
                    rows.append((-1, block.block, block.block, None, packed(rare[once])))
                for bucket, at in block.buckets(buckets):
                    rows.append((bucket, None, block.block, packed(block.numbers[at]), packed(rare[at])))
            yield _sent(rows)
        task = TaskContext.get().partitionId() // BOUNDED_TASKS
        at = np.flatnonzero(counts.any(axis=1)).astype("<i8")
        for part in np.split(at, np.searchsorted(at, np.arange(BOUNDED_ROWS, len(counts), BOUNDED_ROWS))):
            if len(part):
                yield _sent([(int(-2 - part[0] // BOUNDED_ROWS), task, None, packed(part),
                              packed(counts[part].astype("<f4")))])

    return blocks.select("block", "texts", "ids", "ranks", "kinds", "times", "numbers", "bucket",
                         "sums").mapInArrow(run, SENT)


def asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """Rows as of :func:`gathered`, without sums: the words whose counts blocks need."""
    def run(batches):
        for block in Block.rows(batches):
            yield _sent([(bucket, None, block.block, packed(block.numbers[at]), None)
                         for bucket, at in block.buckets(buckets)])

    return blocks.select("block", "ranks", "kinds", "times", "numbers").mapInArrow(run, SENT)


def totals(sent: DataFrame, states: int) -> DataFrame:
    """Sums by number over all rows of a bucket and ``alone``, for the words of each of
    the rows; those of buckets below -1 once, without a block."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        bucket = table.column("bucket")[0].as_py()
        if bucket == -1:
            return table.drop_columns("alone")
        numbers = [unpacked(v.as_py(), "<i8") for v in table.column("numbers")]
        different, places = np.unique(np.concatenate(numbers), return_inverse=True)
        places = np.split(places, np.cumsum([len(n) for n in numbers])[:-1])
        total = np.zeros((len(different), states))
        for at, value in zip(places, table.column("sums")):
            if value.is_valid:  # a row has a number once
                total[at] += unpacked(value.as_py(), "<f4").reshape(-1, states)
        total = total.astype("<f4")
        if bucket < -1:
            blocks, numbers, sums = [None], [packed(different)], [packed(total)]
        else:
            blocks, numbers = table.column("block").to_pylist(), [None] * len(places)
            sums = [packed(total[at]) for at in places]
        return pa.table([pa.array([bucket] * len(sums), pa.int32()), pa.array(blocks, pa.int64()),
                         pa.array(numbers, pa.binary()), pa.array(sums, pa.binary())],
                        names=["bucket", "block", "numbers", "sums"])

    return sent.groupBy("bucket", "alone").applyInArrow(run, "bucket int, block bigint, numbers binary, sums binary")


def baum_welch(blocks: DataFrame, vocab: Vocabulary, buckets: int) -> tuple[Learned, DataFrame | None]:
    """Train on the blocks that are not held out: the bounded part of the model, and
    the table (block, bucket, sums) of the expected counts of all words of all blocks
    that are not known."""
    shape = vocab.shape
    model = Model.new(vocab)
    if not vocab.total:
        return Learned.of(vocab, Model(model.start, model.move, np.full_like(model.emit, 1 / shape.classes))), None
    own, k, known, ranked = shape.own_classes, shape.states, len(vocab.place), vocab.classes_by_rank()
    first = known + shape.shared_classes  # counts: known words, shared classes, first states, moves
    learned, words = Learned.of(vocab, model), None
    for step in range(shape.steps):
        shared = blocks.sparkSession.sparkContext.broadcast(learned)
        sent = _written_alone(gathered(with_found(blocks.where("NOT held_out"), words), shared, buckets,
                                       shape.train_piece), "word-sums")
        shared.destroy()
        if words is not None:
            drop_table(words)
        last = step == shape.steps - 1
        words = _written_alone(totals(sent.union(asked(blocks.where("held_out"), buckets)) if last else sent, k),
                               "word-states")
        drop_table(sent)
        counts = np.zeros((first + 1 + k, k))
        bounded = words.where("block IS NULL").withColumn("alone", F.lit(None).cast("bigint"))
        for row in totals(bounded, k).select("numbers", "sums").collect():
            counts[unpacked(row[0], "<i8")] = unpacked(row[1], "<f4").reshape(-1, k)
        words = words.where("block IS NOT NULL")
        classes = np.zeros((shape.classes, k))
        np.add.at(classes, ranked, counts[:known])
        classes[own:] += counts[known:first]
        model = model.improved(vocab, counts[first], counts[first + 1:], classes)
        learned = Learned.of(vocab, model, counts[:known], classes[own:])
    return learned, words


def likelihoods(blocks: DataFrame, learned: Learned, words: DataFrame | None, buckets: int) -> DataFrame:
    """The texts of ``blocks`` with ``log_classes``, the log10 likelihood but for the
    words' fixed shares; and with ``more`` and ``more_log``, sums over those of their
    words that training has met but are not known."""
    shared = blocks.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        blocks, again = tee(Block.rows(batches))
        for group, model, _, sequences in _joined(blocks, (b.model(shared.value, buckets) for b in again), 400_000):
            found = np.concatenate([log_likelihoods(model, part) for part in _gathered(sequences, 4_000_000)])
            done = 0
            for block in group:
                times = np.concatenate([np.zeros(len(block.ranks), np.int64), block.times])
                ids, sizes = np.concatenate(block.sequences), [len(s) for s in block.sequences]
                firsts, n = np.cumsum([0, *sizes[:-1]]), len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [block.texts.field("doc_id"), pa.array([block.held_out] * n),
                     *[block.texts.field(c) for c in ("n_tokens", "n_found", "log_count", "log_share")],
                     pa.array(found[done:done + n]),
                     pa.array(np.add.reduceat(times[ids] > 0, firsts, dtype=np.int64)),
                     pa.array(np.add.reduceat(np.log10(times + 1.0)[ids], firsts))],
                    names=["doc_id", "held_out", "n_tokens", "n_found", "log_count", "log_share", "log_classes",
                           "more", "more_log"])
                done += n

    kind = blocks.schema["texts"].dataType.elementType["doc_id"].dataType.simpleString()
    return with_found(blocks, words).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_found bigint, log_count double, "
             "log_share double, log_classes double, more bigint, more_log double")


def score(df: DataFrame, training, shape: Shape = Shape(), id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Learn from the rows where the column ``training`` holds and score all rows:
    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), the
    base being add-one word frequencies."""
    rows = _rows(df, id_col, text_col, F.coalesce(training, F.lit(False)))
    counts = _written_alone(
        word_counts(rows).withColumn("number", F.monotonically_increasing_id())
        .withColumn("number", F.expr("IF(c + apart > 1, number, -1)")), "word-counts")
    trained = counts.where("c > 0")
    vocab = vocabulary(trained, shape)
    buckets = 1 + int(max(0, vocab.total - np.rint(10 ** vocab.logs - 1).sum())) // shape.bucket_words
    texts = _written_alone(encoded(rows, vocab).withColumn("block", F.monotonically_increasing_id()), "word-classes")
    blocks = _written_alone(with_counts(texts, trained, 8 * buckets), "word-blocks")
    drop_table(texts)
    drop_table(counts)
    learned, words = baum_welch(blocks, vocab, buckets)
    scale = float(np.log10(vocab.total + vocab.different + 1))
    return likelihoods(blocks, learned, words, buckets).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_found") + F.col("more")).alias("n_known"),
        F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        (F.col("log_count") + F.col("more_log") - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("log_classes") + F.col("log_share") + F.col("more_log")).alias("score"))
