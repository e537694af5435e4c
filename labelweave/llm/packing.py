"""Hierarchical packing of documents into sequences of several context sizes.

Documents are routed by length: whole windows of the longest tier are cut off a document, its rest goes to the smallest
tier that holds it.  Each tier is packed best fit first; what stays open in a window is filled with documents of
shorter tiers, the last of them cut to fit exactly.  When rows run out, open windows end at powers of two, so nothing
is padded.  Sequences of a tier are dealt to steps of equal token counts so that the steps' attention costs are even.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelweave.llm.common import releasing
from labelweave.llm.tokens import MarkedIds, PieceIds, load_added, load_ranks

#: Context sizes, powers of two.
TIERS = (128, 256, 512, 1024)
#: Documents' rests that a task holds before it packs them.
POOL = 2048
#: Tokens of a step.
STEP_TOKENS = 16_384


class Packer:
    """Packs a stream of documents in bounded memory; :meth:`add` and :meth:`flush` return finished pieces.

    A piece is ``(key, start, ids, doc_tokens, sequence, offset, tier, step)`` with ``ids`` as bytes.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step_tokens: int = STEP_TOKENS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers must be ascending powers of two")
        self.tiers, self.pool, self.step_tokens = tiers, pool, step_tokens
        self.rests: list[tuple] = []
        self.windows: list[tuple[int, list[tuple]]] = []
        self.sequences = self.steps = 0

    def add(self, key, ids: bytes) -> list[tuple]:
        n, most = len(ids) // 4, self.tiers[-1]
        whole = n - n % most
        for start in range(0, whole, most):
            self.windows.append((most, [(key, start, ids[4 * start : 4 * (start + most)], n)]))
        if whole < n:
            self.rests.append((key, whole, ids[4 * whole :], n))
        if len(self.rests) >= self.pool:
            self._pack(last=False)
        return self._deal(last=False)

    def flush(self) -> list[tuple]:
        self._pack(last=True)
        return self._deal(last=True)

    def _pack(self, last: bool) -> None:
        # by tier: rests in ascending order of length, the serial number keeps the order total
        by_tier: dict[int, list[tuple[int, int, tuple]]] = {t: [] for t in self.tiers}
        serial = 0

        def put(piece):
            nonlocal serial
            length = len(piece[2]) // 4
            insort(by_tier[next(t for t in self.tiers if t >= length)], (length, serial, piece))
            serial += 1

        for piece in self.rests:
            put(piece)
        self.rests = []
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, own = self.tiers[k], by_tier[self.tiers[k]]
            while own:
                length, _, piece = own.pop()
                window, room = [piece], tier - length
                while room:
                    # the longest rest that fits, from this tier down
                    for t in self.tiers[k::-1]:
                        at = bisect_right(by_tier[t], (room, serial)) - 1
                        if at >= 0:
                            length, _, piece = by_tier[t].pop(at)
                            break
                    else:
                        # none fits: the shortest one of a shorter tier, or of this one, is cut
                        source = next((by_tier[t] for t in self.tiers[: k + 1] if by_tier[t]), None)
                        if source is None:
                            break
                        _, _, (key, start, ids, n) = source.pop(0)
                        piece, length = (key, start, ids[: 4 * room], n), room
                        put((key, start + room, ids[4 * room :], n))
                    window.append(piece)
                    room -= length
                if not room:
                    self.windows.append((tier, window))
                elif last:
                    self._end(window)
                else:
                    self.rests += window

    def _end(self, window: list[tuple]) -> None:
        """An open window as windows whose lengths are powers of two."""
        left = sum(len(p[2]) // 4 for p in window)
        window = window[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            room, part = size, []
            while room:
                key, start, ids, n = window.pop()
                take = min(room, len(ids) // 4)
                part.append((key, start, ids[: 4 * take], n))
                if take < len(ids) // 4:
                    window.append((key, start + take, ids[4 * take :], n))
                room -= take
            self.windows.append((size, part))
            left -= size

    def _deal(self, last: bool) -> list[tuple]:
        """Finished windows, once there are enough of them to balance steps."""
        if not last and len(self.windows) < self.pool:
            return []
        out = []
        by_size: dict[int, list[list[tuple]]] = {}
        for size, window in self.windows:
            by_size.setdefault(size, []).append(window)
        self.windows = []
        for size in sorted(by_size):
            windows = sorted(by_size[size], key=lambda w: -sum((len(p[2]) // 4) ** 2 for p in w))
            per_step = max(1, self.step_tokens // size)
            steps = -(-len(windows) // per_step)
            for i, window in enumerate(windows):
                lap, at = divmod(i, steps)
                step = self.steps + (at if lap % 2 == 0 else steps - 1 - at)
                offset = 0
                for key, start, ids, n in window:
                    out.append((key, start, ids, n, self.sequences, offset, size, step))
                    offset += len(ids) // 4
                self.sequences += 1
            self.steps += steps
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 0,
    with_ids: bool = False,
    added: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id``.

    ``tokenizer`` is the rank file of a byte-level BPE vocabulary; a document's ids are followed by ``end_id``.
    ``added`` is a tokenizers JSON file whose added tokens are matched in the texts.  ``with_ids`` adds the piece's ids.  Each task packs the documents that it reads in one pass with bounded memory, so
    there is no shuffle and no hot key; numbers of sequences and steps carry the task's number.  A null or empty text is
    one ``end_id``; rows are independent, so repeated or null ids are packed row by row.
    """
    source = docs.select("doc_id", "text")
    schema = T.StructType([source.schema["doc_id"]])
    for name, kind in (
        ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"),
        ("sequence_id", "long"), ("offset", "long"), ("tier", "integer"), ("step_id", "long"),
    ):
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", "binary")
    arrow = to_arrow_schema(schema)
    end = end_id.to_bytes(4, "little")
    marks = load_added(added) if added else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        encode = MarkedIds(PieceIds(load_ranks(tokenizer), pattern), marks).encode
        packer = Packer(tiers)

        def table(pieces):
            keys, starts, ids, n, sequences, offsets, sizes, steps = zip(*pieces)
            columns = [
                keys, starts, [len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], n,
                [base + s for s in sequences], offsets, sizes, [base + s for s in steps],
            ]
            if with_ids:
                columns.append(ids)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = packer.add(doc_id, encode(text or "") + end)
                if pieces:
                    yield table(pieces)
        pieces = packer.flush()
        if pieces:
            yield table(pieces)

    return source.mapInArrow(releasing(run), schema)
