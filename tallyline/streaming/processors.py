"""Per-phone quota state for streams (``transformWithState``, row API).

Spark calls ``handleInputRows`` once per phone per micro-batch with that
phone's new calls. State is one BIGINT per phone in the state store (RocksDB,
checkpointed), so a restarted query resumes with the counts it had. It never
expires unless a TTL is given (``ttl_ms``, processing time since the last
update), which changes the semantics: a phone idle that long starts afresh. Memory per
call is bounded: at most ``max_votes`` rows of a phone are held, however many
calls the phone places in one batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

COUNT_SCHEMA = "n bigint"


def _project(row: Row, fields: tuple[str, ...]) -> Row:
    return Row(**{f: row[f] for f in fields})


class BatchQuotaProcessor(StatefulProcessor):
    """Variant A: add the whole batch to the phone's count, then emit the
    batch's calls only if the new count is within ``max_votes``.

    The stored count keeps growing with rejected calls, as the running count
    of the source system does. With ``trimmed=True`` the input comes from
    :func:`trim_calls`, whose column ``_calls`` is the number of calls a row stands for.
    """

    def __init__(self, max_votes: int, output: StructType, trimmed: bool = False,
                 ttl_ms: int | None = None):
        self.max_votes = max_votes
        self.fields = tuple(output.fieldNames())
        self.trimmed = trimmed
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("calls", COUNT_SCHEMA, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = (self.count.get() or (0,))[0]
        seen = 0
        held: list[Row] = []
        for row in rows:
            seen += row["_calls"] if self.trimmed else 1
            if before + seen <= self.max_votes:
                held.append(row)
            elif held:
                held = []
        self.count.update((before + seen,))
        if before + seen <= self.max_votes:
            for row in held:
                yield _project(row, self.fields)

    def close(self) -> None:
        pass


class ArrivalQuotaProcessor(StatefulProcessor):
    """Variant B: accept a phone's calls in arrival order (``order`` columns
    within the batch) until ``max_votes`` have been accepted in total.

    Only accepted calls are counted, so the stored value stops at
    ``max_votes``. A heap keeps the earliest ``max_votes - used`` calls of the
    batch.
    """

    def __init__(self, max_votes: int, output: StructType,
                 order: tuple[str, ...] = ("ts", "vote_id"), ttl_ms: int | None = None):
        self.max_votes = max_votes
        self.fields = tuple(output.fieldNames())
        self.order = order
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("accepted", COUNT_SCHEMA, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        used = (self.used.get() or (0,))[0]
        room = self.max_votes - used
        if room <= 0:
            for _ in rows:
                pass
            return
        order = self.order
        # a NULL comes before any value, as in the batch form
        first = heapq.nsmallest(room, rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in order))
        if first:
            self.used.update((used + len(first),))
        for row in first:
            yield _project(row, self.fields)

    def close(self) -> None:
        pass


def trim_calls(variant: str, max_votes: int, order: tuple[str, ...] = ("ts", "vote_id")):
    """A ``mapInArrow`` function that cuts each map task's calls down before the
    shuffle by phone, so a phone with a large share of a micro-batch does not
    send all of its calls to one task. Calls without a phone are one phone's
    calls; a NULL comes before any value in ``order``. A task holds two numbers
    per phone it has met, and for phones that place ``max_votes`` calls in it up to that
    many sort keys; never the calls.

    ``arrival``: as soon as ``max_votes`` calls of a phone have been passed on, no call
    after the last of them can be among the phone's first ones: that is the bar. The
    sort keys of calls passed below it are held, and the last of the first
    ``max_votes`` of them is the next bar. Input in order of arrival passes ``max_votes``
    calls per phone and task, input in random order a few times as many.
    ``batch``: the first ``max_votes`` calls of each phone in the task pass, with 1 in the
    column ``_calls``; all others are one more row at the task's end that has
    their number there. :class:`BatchQuotaProcessor` needs only the sum: more than
    ``max_votes`` calls in one task already reject the phone's batch.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keys = [(c, "ascending") for c in ("phone_number", *order)]

    def grouped(chunk):
        """The chunk by phone and order, its phones, and where each one's calls start and end."""
        chunk = chunk.take(pc.sort_indices(chunk, sort_keys=keys, null_placement="at_start"))
        phones = chunk.column(chunk.schema.get_field_index("phone_number"))
        codes = phones.dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        return chunk, phones.take(pa.array(starts)).to_pylist(), starts, np.append(starts[1:], len(codes))

    def arrival(chunks):
        passed: dict = {}  # phone -> (calls passed, the last of them), until there are max_votes
        below: dict = {}  # phone -> (the bar, sort keys of calls passed below it)
        for chunk in chunks:
            if not chunk.num_rows:
                continue
            chunk, phones, starts, ends = grouped(chunk)
            columns = [chunk.column(chunk.schema.get_field_index(c)) for c in order]

            def sort_keys(rows):
                values = zip(*[c.take(pa.array(rows)).to_pylist() for c in columns])
                return [tuple((v is not None, v) for v in row) for row in values]

            ends = np.minimum(ends, starts + max_votes)
            keep = np.zeros(chunk.num_rows, dtype=bool)
            for phone, start, end, latest in zip(phones, starts.tolist(), ends.tolist(), sort_keys(ends - 1)):
                bar, held = below.get(phone, (None, None))
                if bar is None:
                    n, last = passed.pop(phone, (0, latest))
                    n, last = n + end - start, max(last, latest)
                    if n < max_votes:
                        passed[phone] = n, last
                    else:
                        below[phone] = last, []
                else:
                    if latest >= bar:
                        # calls are in order: find the first at or after the bar
                        low, high = start, end
                        while low < high:
                            middle = (low + high) // 2
                            low, high = (middle + 1, high) if sort_keys([middle])[0] < bar else (low, middle)
                        end = low
                    held = sorted(held + sort_keys(np.arange(start, end)))[:max_votes]
                    below[phone] = held[-1] if len(held) == max_votes else bar, held
                keep[start:end] = True
            yield chunk.filter(pa.array(keep))

    def batch(chunks):
        passed: dict = {}
        more: dict = {}
        names = schema = None
        for chunk in chunks:
            if not chunk.num_rows:
                continue
            chunk, phones, starts, ends = grouped(chunk)
            names, schema = [*chunk.schema.names, "_calls"], chunk.schema
            keep = np.zeros(chunk.num_rows, dtype=bool)
            for phone, start, end in zip(phones, starts.tolist(), ends.tolist()):
                seen = passed.get(phone, 0)
                take = min(end - start, max_votes - seen)
                keep[start:start + take] = True
                passed[phone] = seen + take
                if take < end - start:
                    more[phone] = more.get(phone, 0) + end - start - take
            out = chunk.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.ones(out.num_rows, dtype=np.int64))], names=names)
        if more:
            columns = [pa.array(list(more), f.type) if f.name == "phone_number" else pa.nulls(len(more), f.type)
                       for f in schema]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(more.values()), pa.int64())], names=names)

    return arrival if variant == "arrival" else batch
