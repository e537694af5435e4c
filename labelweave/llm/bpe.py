"""Byte-level BPE in DuckDB, inside Spark tasks.

A task collects the different words of its texts.  A recursive query holds them as (word, position, token) rows: every round joins
adjacent tokens to the merge table and contracts each word's leftmost pair of minimum rank, until no pair is left.
Ordered aggregation gives each word's ids and, from the vocabulary, its decoded bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from labelweave.llm.common import ENTRY_BYTES, map_texts
from labelweave.llm.tokens import cut, load_ranks

#: Bytes of cuts and results that a worker remembers, in two generations.
CACHE_BYTES = 256 << 20
#: Words of more bytes need one round per merge; they are merged one by one outside the recursion.
LONG_WORD = 128
#: Words that one recursive query takes, and the rows that it may hold: a word has a row per byte in each of its rounds.
WORDS_PER_QUERY, ROWS_PER_QUERY = 40_000, 3_000_000

ENCODE = """
WITH RECURSIVE step AS (
    SELECT word, pos, tok, 0 AS round FROM letters
    UNION ALL
    SELECT p.word, p.pos, CASE WHEN p.pos = b.place THEN b.merged ELSE p.tok END, p.round + 1
    FROM step p
    JOIN (
        SELECT word, arg_min(pos, cost) AS place, arg_min(follows, cost) AS gone, (min(cost) >> 16)::INTEGER AS merged
        FROM (
            SELECT q.word, q.pos, q.follows, (m.merged::BIGINT << 16) | q.pos AS cost
            FROM (
                SELECT word, pos, tok, lead(tok) OVER w AS following, lead(pos) OVER w AS follows, lead(word) OVER w AS same
                FROM step WINDOW w AS (ORDER BY word, pos)
            ) q
            JOIN merges m ON m.a = q.tok AND m.b = q.following AND q.same = q.word
        )
        GROUP BY word
    ) b ON b.word = p.word AND b.gone <> p.pos
)
SELECT s.word, count(*) AS n, string_agg(s.tok::VARCHAR, ' ' ORDER BY s.pos) AS ids,
       unhex(string_agg(v.bytes, '' ORDER BY s.pos)) AS decoded
FROM step s
JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) e USING (word, round)
JOIN vocabulary v ON v.tok = s.tok
GROUP BY s.word
"""


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long word: pairs wait in a heap by (rank, position), the leftmost of the least rank is contracted."""
    import heapq

    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            both = parts[i] + parts[j]
            if both in ranks:
                heapq.heappush(heap, (ranks[both], i, both))

    for i in range(n):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] is None or after[i] >= n or parts[i] + parts[after[i]] != both:
            continue
        j = after[i]
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p in parts if p is not None]


class Codec:
    """Encodes and decodes texts with a vocabulary; remembers cuts in bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.words = regex.compile(pattern).findall
        # two generations: what the older one holds is taken over when it is met again, the rest is forgotten
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, bytes, bytes]] = {}
        self.size = 0
        self.db = duckdb.connect()
        for setting in ("threads = 1", "memory_limit = '500MB'", "temp_directory = ''"):
            self.db.execute(f"SET {setting}")
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, merged = (pa.array(c, pa.int32()) for c in zip(*pairs))
        merges = pa.table({"a": a, "b": b, "merged": merged})  # noqa: F841
        vocabulary = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "bytes": [t.hex() for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, bytes, bytes]]:
        """Number of ids, decimal ids joined by a space, and decoded bytes of different words."""
        import pyarrow as pa

        out: dict[str, tuple[int, bytes, bytes]] = {}
        short: list[tuple[str, bytes]] = []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) <= LONG_WORD:
                short.append((w, raw))
            else:
                ids = merge_long(raw, self.ranks)
                out[w] = (len(ids), " ".join(map(str, ids)).encode(), b"".join(self.tokens[i] for i in ids))
        for part in self._parts(short):
            number = [i for i, (_, raw) in enumerate(part) for _ in raw]
            place = [j for _, raw in part for j in range(len(raw))]
            letter = [self.ranks[raw[j : j + 1]] for _, raw in part for j in range(len(raw))]
            letters = pa.table({"word": pa.array(number, pa.int32()), "pos": pa.array(place, pa.int64()), "tok": pa.array(letter, pa.int32())})
            self.db.register("letters", letters)
            found = self.db.execute(ENCODE).fetchall()
            self.db.unregister("letters")
            for i, n, ids, decoded in found:
                out[part[i][0]] = (n, ids.encode(), decoded)
        return out

    @staticmethod
    def _parts(words: list[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
        """The words in lists of bounded work, short ones first, so that words of a list take about as many rounds."""
        part, rows = [], 0
        for word in sorted(words, key=lambda w: len(w[1])):
            more = len(word[1]) ** 2
            if part and (len(part) == WORDS_PER_QUERY or rows + more > ROWS_PER_QUERY):
                yield part
                part, rows = [], 0
            part.append(word)
            rows += more
        if part:
            yield part

    def code(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Per text: number of ids, decimal ids joined by a space, decoded bytes."""
        pieces = [cut(t) for t in texts]
        pieces = [self.words(t) if p is None else p for t, p in zip(texts, pieces)]
        wanted = set().union(*pieces) if pieces else set()
        if self.size > CACHE_BYTES // 2:
            self.known, self.older, self.size = {}, self.known, 0

        def keep(key: str, value: tuple[int, bytes, bytes]) -> None:
            self.known[key] = value
            self.size += ENTRY_BYTES + 2 * len(key) + len(value[1]) + len(value[2])

        def take(keys) -> set:
            """What is known of ``keys`` is kept; returns the rest."""
            rest = set()
            for k in keys:
                if k not in self.known:
                    if k in self.older:
                        keep(k, self.older[k])
                    else:
                        rest.add(k)
            return rest

        fresh = {p: self.words(p) for p in take(wanted)}
        for word, value in (self.encode_words(list(take(set().union(*fresh.values())))) if fresh else {}).items():
            keep(word, value)
        for piece, words in fresh.items():
            if len(words) != 1:
                parts = [self.known[w] for w in words]
                keep(piece, (sum(p[0] for p in parts), b" ".join([p[1] for p in parts]), b"".join([p[2] for p in parts])))
        out = []
        for own in pieces:
            parts = [self.known[p] for p in own]
            out.append((sum(p[0] for p in parts), b" ".join([p[1] for p in parts]), b"".join([p[2] for p in parts])))
        return out


@lru_cache(maxsize=1)
def shared_codec(tokenizer: str, pattern: str) -> Codec:
    """The codec of this Python worker: tasks that run in it one after the other share what it remembers."""
    return Codec(load_ranks(tokenizer), pattern)


def code_documents(docs: DataFrame, tokenizer: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document; ``with_ids`` adds ``ids`` and ``decoded``.

    ``tokenizer`` is a rank file, ``pattern`` splits texts into words.  A null or empty text has no ids.  Rows are
    independent: repeated ids keep a row each, other columns are ignored.  Each task works through its texts in batches
    and remembers a bounded number of words.
    """

    def make():
        codec = shared_codec(tokenizer, pattern)

        def run(texts: list[str]) -> dict[str, list]:
            rows = codec.code(texts)
            out = {
                "n_tokens": [n for n, _, _ in rows],
                "ids_sha256": [hashlib.sha256(ids).hexdigest() for _, ids, _ in rows],
                "decoded_sha256": [hashlib.sha256(raw).hexdigest() for _, _, raw in rows],
            }
            if with_ids:
                out["ids"] = [[int(i) for i in ids.split()] for _, ids, _ in rows]
                out["decoded"] = [raw for _, _, raw in rows]
            return out

        return run

    columns = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, make, columns + (", ids array<int>, decoded binary" if with_ids else ""))
