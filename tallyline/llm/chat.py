"""Chat formatting with shared turns stored once, as a prefix tree in depth-first order.

A turn is written as ``turn`` role ``text`` text ``end`` (a :class:`Template`'s control
strings). Control strings inside roles and texts are escaped: c0 E..E rest gets one escape
character E more after its first character c0, so none is left as it was, and taking one
E away from each such place gives the text back.

Conversations that begin with the same turns share them. A turn's place in the tree is
the digest of all turns up to it. Different conversations, sorted by these digests, come in
depth-first order of the tree, and what one has in common with the one before it are the
turns that need not be written again:

1. Turns of a conversation are brought together, tokenized and written to a table.
2. Different conversations (digests and sizes, no texts) are dealt by ranges of their
   digests and sorted; one pass in each task gives the turns that are new, and places
   counted from the task's start. One row per task tells how to join the tasks.
3. Each turn of the tree becomes a segment: its ids, its place ``start`` in the order of
   all ids, the ``position`` id of its first token (the tokens before it in its
   conversation), and ``visible_until``: the end of its subtree. The tokens at places
   ``start`` to ``visible_until`` are those that follow it in some conversation, so a
   token attends to the segments whose interval holds its place (and to earlier tokens of
   its own segment). Segments are written in order of ``start``.
4. An index has every conversation's segments, and the intervals of places that its
   last token attends to, joined where they meet.

Ids under the loss mask (``loss_from`` to ``loss_until`` inside the segment) are those of the
texts of ``learned`` roles, without control strings.

Bounds: a conversation is one row, as a text is; a turn that any number of conversations share
is one segment, and no step gathers the conversations that share it.

Defined results: rows of a conversation are ordered by turn, then role and text (NULL first); a
NULL role or text is empty; repeated rows are turns of their own; rows without a conversation id
are one conversation. Other columns are not read. An empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import batches_of
from tallyline.llm.token_ids import PartEncoder, byte_letters, encoder
from tallyline.session import materialize


@dataclass(frozen=True)
class Template:
    """Control strings before a role, between role and text, and after a text.

    A control string's first character stands nowhere else in any of them, and
    none begins another, so they can neither overlap nor arise where parts meet.
    """
    turn: str = "[INST]"
    text: str = "[/INST]"
    end: str = "</s>"
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = (self.turn, self.text, self.end)
        firsts = {m[:1] for m in marks}
        if len(self.escape) != 1 or any(len(m) < 2 or self.escape in m or firsts & set(m[1:]) for m in marks) \
                or any(a is not b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("control strings must be unlike each other and hold no escape character")

    def _places(self, times: str) -> re.Pattern:
        escape = re.escape(self.escape)
        return re.compile("|".join(f"{re.escape(m[0])}{escape}{times}{re.escape(m[1:])}"
                                   for m in (self.turn, self.text, self.end)))

    @cached_property
    def _plain(self) -> re.Pattern:
        return self._places("*")

    @cached_property
    def _escaped(self) -> re.Pattern:
        return self._places("+")

    def quote(self, text: str) -> str:
        """``text`` without any control string in it."""
        return self._plain.sub(lambda m: m[0][0] + self.escape + m[0][1:], text)

    def unquote(self, text: str) -> str:
        """The text that :meth:`quote` was given."""
        return self._escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    def parts(self, role: str, text: str) -> tuple[str, str, str]:
        """What stands before the text, the text, and what follows, as written."""
        return self.turn + self.quote(role) + self.text, self.quote(text), self.end

    def parse(self, written: str) -> list[tuple[str, str]]:
        """(role, text) of every turn of a written conversation."""
        turns = written.split(self.end)
        if turns.pop():
            raise ValueError("the last turn has no end")
        out = []
        for turn in turns:
            head, mark, text = turn.partition(self.text)
            if not mark or not head.startswith(self.turn):
                raise ValueError("not a written turn")
            out.append((self.unquote(head[len(self.turn):]), self.unquote(text)))
        return out


@lru_cache(maxsize=2)
def _bytes_of_ids(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    own: PartEncoder = encoder(path)
    byte_of = {chr(c): b for b, c in byte_letters().items()}
    table = [b""] * len(own.lengths)
    for token, number in own.tokenizer.get_vocab(with_added_tokens=False).items():
        table[number] = bytes(byte_of[c] for c in token)
    return table


def decode(ids: np.ndarray, path: str) -> str:
    table = _bytes_of_ids(path)
    return b"".join([table[i] for i in ids.tolist()]).decode()


TURNS = pa.schema([("conv", pa.int64()), ("idx", pa.int64()), ("token_ids", pa.binary()), ("loss_from", pa.int64()),
                   ("loss_until", pa.int64()), ("leaf", pa.binary()), ("path", pa.list_(pa.binary())),
                   ("before", pa.list_(pa.int64()))])
_TURNS = ("conv bigint, idx bigint, token_ids binary, loss_from bigint, loss_until bigint, leaf binary, "
          "path array<binary>, before array<bigint>")


def _tokenized(tokenizer: str, template: Template):
    """Conversations to one row per turn; the last one has the whole path: digests of
    all turns so far, and the number of ids before each turn and at the end."""
    def run(batches):
        encode = encoder(tokenizer)

        def rows(batch):
            convs = [[(t["role"] or "", t["text"] or "") for t in turns] for turns in batch.column(1).to_pylist()]
            # parts of many conversations are encoded together, and taken one by one
            ids = encode.many(part for turns in convs for turn in turns for part in template.parts(*turn))
            for conv, turns in zip(batch.column(0).to_pylist(), convs):
                digest, path, before = b"", [], [0]
                for k, (role, text) in enumerate(turns):
                    head, body, end = next(ids), next(ids), next(ids)
                    chain = hashlib.blake2b(digest, digest_size=16)
                    for value in (role.encode(), text.encode()):
                        chain.update(len(value).to_bytes(8, "little") + value)
                    digest = chain.digest()
                    path.append(digest)
                    raw = np.concatenate([head, body, end]).astype("<u4").tobytes()
                    before.append(before[-1] + len(raw) // 4)
                    until = len(head) + len(body) if role in template.learned else len(head)
                    last = k + 1 == len(turns)
                    yield (conv, k, raw, len(head), until, *((digest, path, before) if last else (None,) * 3))

        for batch in batches:
            yield from batches_of(rows(batch), TURNS, 512)
    return run


_PLACED = "part bigint, number bigint, conv bigint, leaf binary, path array<binary>, before array<bigint>, " \
          "shared bigint, starts array<bigint>, place bigint"


def _placed(batches):
    """Sorted different conversations of a task: how many first turns each shares with
    the one before it, and places as if the task's first one were all new."""
    part, number, path, starts, place = TaskContext.get().partitionId(), 0, [], [], 0
    schema = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("conv", pa.int64()), ("leaf", pa.binary()),
                        ("path", pa.list_(pa.binary())), ("before", pa.list_(pa.int64())), ("shared", pa.int64()),
                        ("starts", pa.list_(pa.int64())), ("place", pa.int64())])

    def rows(batch):
        nonlocal number, path, starts, place
        for conv, leaf, new, before in zip(*(batch.column(i) for i in range(4))):
            new, before = new.as_py(), before.as_py()
            shared = _common(path, new)
            starts = starts[:shared] + [place + b - before[shared] for b in before[shared:-1]]
            yield part, number, conv.as_py(), leaf.as_py(), new, before, shared, starts, place
            place += before[-1] - before[shared]
            path, number = new, number + 1

    for batch in batches:
        yield from batches_of(rows(batch), schema, 512)


def _common(a: list, b: list) -> int:
    """How many first entries are equal. Digests are of all turns so far, so
    equality at one place is equality up to it."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[middle - 1] == b[middle - 1] else (low, middle - 1)
    return low


_JOINS = "part bigint, shared bigint, skipped bigint, base bigint, inherited array<bigint>"


def _joins(batches):
    """From the first and last conversation of every task, in order: how many turns the
    first one shares with the task before, the ids they have, where the task's ids begin,
    and the true places of the shared turns."""
    schema = pa.schema([("part", pa.int64()), ("shared", pa.int64()), ("skipped", pa.int64()), ("base", pa.int64()),
                        ("inherited", pa.list_(pa.int64()))])

    def rows():
        path, places, base = [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                shared = _common(path, row["first_path"])
                skipped, inherited = row["first_before"][shared], places[:shared]
                yield row["part"], shared, skipped, base, inherited
                places = [inherited[j] if j < shared and s < skipped else base - skipped + s
                          for j, s in enumerate(row["last_starts"])]
                path, base = row["last_path"], base + row["total"] - skipped

    yield from batches_of(rows(), schema, 64)


def write_chats(df: DataFrame, folder: str, tokenizer: str, template: Template = Template(), conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> None:
    """Write ``segments`` (start, n_tokens, position, visible_until, loss_from,
    loss_until, token_ids; in order of start) and ``index`` (conv_id, segments,
    attends: array of from, until) as Parquet under ``folder``."""
    rows = df.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                     F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    gathered = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    turns = materialize(gathered.mapInArrow(_tokenized(tokenizer, template), _TURNS), "chat_turns")
    ends = turns.where("leaf is not null").select("conv", "leaf", "path", "before")

    # equal conversations are one row, as the partial aggregate leaves one per task
    different = ends.groupBy("leaf").agg(F.min("conv").alias("conv"), F.first("path").alias("path"),
                                         F.first("before").alias("before"))
    sorted_ = different.select("conv", "leaf", "path", "before").repartitionByRange("path").sortWithinPartitions("path")
    placed = materialize(sorted_.mapInArrow(_placed, _PLACED), "chat_places")
    # one row per task of the range partitioning
    tasks = placed.groupBy("part").agg(
        F.min_by("path", "number").alias("first_path"), F.min_by("before", "number").alias("first_before"),
        F.max_by("path", "number").alias("last_path"), F.max_by("starts", "number").alias("last_starts"),
        F.max(F.col("place") + F.element_at("before", -1) - F.expr("before[shared]")).alias("total"))
    joins = materialize(tasks.repartition(1).sortWithinPartitions("part").mapInArrow(_joins, _JOINS), "chat_joins")

    j = joins.select("part", F.col("shared").alias("j_shared"), "skipped", "base", "inherited")
    first = F.col("number") == 0
    shared = F.when(first, F.col("j_shared")).otherwise(F.col("shared"))
    starts = F.transform("starts", lambda s, i: F.when((i < F.col("j_shared")) & (s < F.col("skipped")),
                                                       F.get("inherited", i))
                         .otherwise(F.col("base") - F.col("skipped") + s))
    true = placed.join(j, "part").select(
        "conv", "leaf", "before", shared.cast("int").alias("shared"), starts.alias("starts"),
        F.when(first, F.col("base")).otherwise(F.col("base") - F.col("skipped") + F.col("place")).alias("place"))
    true = materialize(true.withColumn("until", F.col("place") + F.element_at("before", -1) - F.expr("before[shared]")),
                       "chat_tree")

    # a subtree ends where the last conversation that holds the segment ends
    each = true.select("conv", "until", "shared", "before", F.posexplode("starts").alias("idx", "start"))
    held = F.when(F.col("idx") >= F.col("shared"), F.struct(F.col("idx").cast("bigint").alias("idx"),
                                                            F.get("before", F.col("idx")).alias("position"), "conv"))
    tree = each.groupBy("start").agg(F.max("until").alias("visible_until"), F.max(held).alias("at"))
    tree = tree.select("start", "visible_until", "at.position", F.col("at.idx").alias("own_idx"),
                       F.col("at.conv").alias("own_conv"))
    written = turns.join(tree, (turns["idx"] == tree["own_idx"]) & turns["conv"].eqNullSafe(tree["own_conv"]))
    (written.select("start", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"), "position",
                    "visible_until", "loss_from", "loss_until", "token_ids")
     .repartitionByRange("start").sortWithinPartitions("start").write.parquet(os.path.join(folder, "segments")))

    pieces = F.transform("starts", lambda s, i: F.struct(
        s.alias("from"), (s + F.get("before", i + 1) - F.get("before", i)).alias("until")))
    paths = true.select("leaf", F.col("starts").alias("segments"), pieces.alias("pieces"))
    # an interval begins where a segment does not follow the one before it
    begins = F.filter("pieces", lambda p, i: (i == 0) | (p["from"] != F.get("pieces", i - 1)["until"]))
    stops = F.filter("pieces", lambda p, i: (i == F.size("pieces") - 1) | (p["until"] != F.get("pieces", i + 1)["from"]))
    paths = paths.select("leaf", "segments", F.zip_with(begins, stops, lambda b, s: F.struct(
        b["from"].alias("from"), s["until"].alias("until"))).alias("attends"))
    (ends.select(F.col("conv").alias("conv_id"), "leaf").join(paths, "leaf").drop("leaf")
     .write.parquet(os.path.join(folder, "index")))


READ = pa.schema([("start", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("learned", pa.string()),
                  ("written_chars", pa.int64())])


def read_chats(spark: SparkSession, folder: str, tokenizer: str, template: Template = Template()) -> DataFrame:
    """One row per conversation and turn of the files under ``folder``: (conv_id, idx,
    role, text, learned, written_chars). ``learned`` is the text under the loss mask
    (NULL: none), ``written_chars`` the characters of the turn as written."""
    def run(batches):
        def rows(batch):
            for start, begin, until, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(raw, "<u4")
                written = decode(ids, tokenizer)
                (role, text), = template.parse(written)
                learned = template.unquote(decode(ids[begin:until], tokenizer)) if role in template.learned else None
                yield start, role, text, learned, len(written)

        for batch in batches:
            yield from batches_of(rows(batch), READ, 512)

    segments = spark.read.parquet(os.path.join(folder, "segments")).select("start", "loss_from", "loss_until", "token_ids")
    turns = segments.mapInArrow(run, "start bigint, role string, text string, learned string, written_chars bigint")
    index = spark.read.parquet(os.path.join(folder, "index"))
    return index.select("conv_id", F.posexplode("segments").alias("idx", "start")).join(turns, "start").drop("start")


def training_arrays(segment) -> dict[str, np.ndarray]:
    """A segment's row as arrays, one entry per token: ``ids``, ``positions``, ``loss``,
    and ``seen_from``, ``seen_until``: the places of the tokens that attend to it."""
    n = segment["n_tokens"]
    at = np.arange(n)
    return {"ids": np.frombuffer(segment["token_ids"], "<u4"), "positions": segment["position"] + at,
            "loss": (at >= segment["loss_from"]) & (at < segment["loss_until"]), "seen_from": segment["start"] + at,
            "seen_until": np.full(n, segment["visible_until"])}
