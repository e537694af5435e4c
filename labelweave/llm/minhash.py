"""Near-duplicate documents by MinHash bands, confirmed on the full shingle sets.

1. Every document gets its set of word shingles (64-bit hashes), a key of the whole set and a MinHash
   signature.  Documents with equal sets are one class from here on.
2. The signature is cut into bands (called trees) of a fixed number of values; classes with a band in common are a region.
   There are no sorted orders and no search for the longest common prefix among candidates: going deeper in a dense
   region would lose links that only the full sets decide.  In a small region all classes meet and similar signatures make
   candidates; in a dense one every class is linked to the smallest one without a test, to be confirmed with its family.
3. Candidates that hang together are a family; the sets of a family meet in chunks, a large family
   taken down by prefixes of the signature so that rows with a long one in common share a chunk, and links are confirmed exactly, the likeliest
   first, leaving out pairs that are connected already.  Families of several chunks go on with representatives of their
   parts, and finally every class outside a family's main part meets all chunks of the family, so no pair of
   different parts that the bands found is left unseen.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import Remembered, components, map_texts
from labelweave.llm.pairing import CHUNK, Groups, deal_chunks, deal_pairs, map_groups
from labelweave.runtime import stage

#: Values of the shortest prefix of a region.
DEPTH = 4
#: Lengths of the prefixes by which a large family is taken down the first tree.
PREFIXES = (4, 8, 16, 32)
#: Chance that a pair at the threshold shares no region.
MISS = 1e-6
#: Standard deviations of the signature's estimate that a candidate may be below the threshold.
SLACK = 5.0
#: Bytes of words and hashes that a task remembers.
CACHE_BYTES = 24 << 20
#: Representatives that a part of a chunk sends on.
REPRESENTATIVES = 8
#: Ids that are broadcast at most when documents are looked up; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def trees_for(percent: int, depth: int = DEPTH) -> int:
    """Trees after which a pair at the threshold is missed with a chance of at most ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** depth))


class _Words(Remembered):
    def __init__(self):
        super().__init__(CACHE_BYTES)

    def __missing__(self, word: bytes) -> int:
        return self.keep(word, int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"), len(word))


def shingle_set(text: str, words: int, hashes: _Words) -> np.ndarray:
    """Sorted different hashes of the shingles of ``words`` words; the whole sequence if it is shorter.

    Words are split at ASCII white space; A-Z are lower-cased.
    """
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(values: np.ndarray, functions) -> np.ndarray:
    """Smallest value of each hash function over the set, 32 bits each."""
    a, b = functions
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        part = values[at : at + 1024]
        low = np.minimum(low, (a[:, None] * part[None, :] + b[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _set_key(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def sign_documents(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """``doc_id, n_shingles, cls`` (key of the set, null if it is empty), ``regions`` (one key per tree) and ``sig``."""
    functions = _functions(trees * depth)

    def make():
        hashes = _Words()

        def run(texts):
            out = {"n_shingles": [], "cls": [], "regions": [], "sig": []}
            for text in texts:
                values = shingle_set(text, words, hashes)
                out["n_shingles"].append(len(values))
                if not len(values):
                    for name in ("cls", "regions", "sig"):
                        out[name].append(None)
                    continue
                sig = signature(values, functions)
                mixed = np.full(trees, 1469598103934665603, np.uint64) + np.arange(trees, dtype=np.uint64)
                for d in range(depth):
                    mixed = (mixed ^ sig.reshape(trees, depth)[:, d]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(31)
                out["cls"].append(_set_key(values))
                out["regions"].append(mixed.view(np.int64))
                out["sig"].append(sig.astype(np.uint16).tobytes())
            return out

        return run

    return map_texts(docs, make, "n_shingles bigint, cls bigint, regions array<bigint>, sig binary")


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal signature values of every row of ``a`` with every row of ``b``."""
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        out += a[:, k][:, None] == b[:, k][None, :]
    return out / a.shape[1]


def _candidates(regions: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """Candidate links ``(a, b)`` that connect all rows which the forest brings together.

    A region of one chunk gives a spanning forest of its similar pairs.  In a dense region every class is linked
    to its smallest one: these links only join a family, they are confirmed later.
    """
    small = regions.filter(F.col("n") <= CHUNK).join(signed, "cls")

    def meet(table: pa.Table):
        sig, ids = _matrix(table.column("sig").combine_chunks(), np.uint16), table.column("cls").to_numpy()
        order = np.argsort(ids)
        sig, ids = sig[order], ids[order]
        a, b = np.nonzero(np.triu(_alike(sig, sig) >= least, 1))
        groups = Groups(len(ids))
        kept = [(ids[i], ids[j]) for i, j in zip(a.tolist(), b.tolist()) if groups.join(i, j)]
        return pa.table({"a": pa.array([k[0] for k in kept], pa.int64()), "b": pa.array([k[1] for k in kept], pa.int64())})

    found = map_groups(small.select("region", "cls", "sig"), ["region"], meet, "a bigint, b bigint")
    dense = regions.filter(F.col("n") > CHUNK)
    # staged, so that its size is seen: by a shuffle a dense region would be one task's
    hubs = stage(dense.groupBy("region").agg(F.min("cls").alias("a")), "hubs")
    stars = dense.join(hubs, "region").select("a", F.col("cls").alias("b")).filter("a <> b")
    return found.union(stars).distinct()


def _confirm(table: pa.Table, percent: int, least: float) -> tuple[list, list]:
    """Confirmed links of one chunk or chunk pair, and representatives of its parts.

    With ``part`` in the table, rows of one part are connected already, and with two sides only pairs across are looked at.
    """
    ids = table.column("cls").to_numpy()
    sig = _matrix(table.column("sig").combine_chunks(), np.uint16)
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    groups = Groups(len(ids))
    if "part" in table.column_names:
        first: dict[int, int] = {}
        for i, p in enumerate(table.column("part").to_pylist()):
            groups.join(first.setdefault(p, i), i)
    share = _alike(sig, sig)
    # sizes too different for the threshold need no look
    possible = (share >= least) & (100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes))
    side = table.column("side").to_numpy() if "side" in table.column_names else np.zeros(len(ids), int)
    if side.any():
        possible &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(possible, 1))
    links = []
    for k in np.argsort(-share[a, b], kind="stable"):
        i, j = int(a[k]), int(b[k])
        if groups.find(i) == groups.find(j):
            continue
        small, large = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[at] == small).sum())
        if 100 * both >= percent * (sizes[i] + sizes[j] - both):
            groups.join(i, j)
            links.append((int(ids[i]), int(ids[j])))
    parts: dict[int, list[int]] = {}
    for i in range(len(ids)):
        parts.setdefault(groups.find(i), []).append(i)
    # the rows that resemble most others of their part
    chosen = []
    for members in parts.values():
        near = share[np.ix_(members, members)].sum(1)
        chosen += [int(ids[members[i]]) for i in np.argsort(-near, kind="stable")[:REPRESENTATIVES]]
    return links, chosen


def _confirmed(rows: DataFrame, keys: list[str], percent: int, least: float) -> DataFrame:
    """``a, b`` of confirmed links, and rows with ``a`` alone for representatives."""

    def run(table: pa.Table):
        links, chosen = _confirm(table, percent, least)
        return pa.table({"a": pa.array([x[0] for x in links] + chosen, pa.int64()), "b": pa.array([x[1] for x in links] + [None] * len(chosen), pa.int64())})

    return stage(map_groups(rows, keys, run, "a bigint, b bigint"), "confirmed")


def _with_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``wanted`` (doc_id, cls, ...) with ``shingles``, computed anew from the texts of those documents."""
    number = wanted.count()
    side = wanted.select("doc_id").distinct()
    side = F.broadcast(side) if number <= BROADCAST_IDS else side
    id_of = F.coalesce("doc_id", F.lit(-(2**63)))
    texts = docs.select(id_of.alias("doc_id"), "text").join(side, "doc_id", "left_semi")

    def make():
        hashes = _Words()

        def run(values):
            sets = [shingle_set(t, words, hashes) for t in values]
            return {"cls": [_set_key(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

        return run

    sets = map_texts(texts, make, "cls bigint, shingles binary")
    # a repeated id may have several texts: the set's key tells which one is wanted
    return wanted.join(sets, ["doc_id", "cls"]).dropDuplicates(["cls"])


def _deal_families(sets: DataFrame, large: DataFrame) -> DataFrame:
    """Add ``chunk`` (long): the rows of the ``large`` families in chunks of about ``CHUNK`` rows, all others in one.

    Rows with a prefix in common are one subtree.  Small subtrees of one parent share chunks; a subtree above ``CHUNK``
    is taken to the next prefix, and what still has the longest one in common is cut by a hash of the class.
    """
    size = lambda n: F.ceil(F.col(n) / CHUNK)
    prefixes = [F.xxhash64(F.substring("sig", 1, 2 * k)).alias(f"p{k}") for k in PREFIXES]
    rows = stage(sets.select("cls", "family", *prefixes).join(large.select("family"), "family"), "prefixes")
    above = dict(zip(PREFIXES, [F.lit(0).cast("long"), *[F.col(f"p{k}") for k in PREFIXES]]))
    # the subtrees of all levels at once: those below one that is dealt already are counted, but not used
    levels = F.array(*[F.struct(F.lit(k).alias("k"), above[k].alias("at"), F.col(f"p{k}").alias("p")) for k in PREFIXES])
    below = stage(rows.select("family", F.inline(levels)).groupBy("family", "k", "at", "p").agg(F.count("*").alias("n")), "subtrees")
    # few rows, as each stands for more than a chunk; staged, so that its size is seen: by a shuffle a parent would be one task's
    rest = below.filter(F.col("n") <= CHUNK).groupBy("family", "k", "at").agg(F.sum("n").alias("rest")).filter(F.col("rest") > CHUNK)
    below = below.join(stage(rest, "rests"), ["family", "k", "at"], "left").withColumn("rest", F.coalesce("rest", F.lit(1)))
    below = stage(below, "subtrees")
    dealt = []
    for k in PREFIXES:
        level = below.filter(F.col("k") == k).select("family", F.col("p").alias(f"p{k}"), F.col("n").alias(f"n{k}"), F.col("rest").alias(f"rest{k}"))
        rows = rows.join(level, ["family", f"p{k}"])
        dealt.append(F.when(F.col(f"n{k}") <= CHUNK, F.xxhash64(F.lit(k), above[k], F.pmod(F.col(f"p{k}"), size(f"rest{k}")))))
    rows = stage(rows.select("cls", "family", F.coalesce(*dealt, F.col(f"p{PREFIXES[-1]}")).alias("chunk")), "dealt")
    # chunks that are too large by now, with the longest prefix in common or by chance
    counts = stage(rows.groupBy("family", "chunk").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * CHUNK), "full_chunks")
    rows = rows.join(counts, ["family", "chunk"], "left")
    chunk = F.when(F.col("n").isNull(), F.col("chunk")).otherwise(F.xxhash64("chunk", F.pmod(F.xxhash64("cls"), size("n"))))
    return sets.join(stage(rows.select("cls", chunk.alias("chunk")), "chunks"), "cls", "left").withColumn("chunk", F.coalesce("chunk", F.lit(0).cast("long")))


def _linked(docs: DataFrame, words: int, percent: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and of every class ``cls, component_id, keep`` (id and class of the row that stays)."""
    trees = trees_for(percent, depth)
    t = percent / 100
    least = t - SLACK * math.sqrt(t * (1 - t) / (trees * depth))
    signed = stage(sign_documents(docs, words, trees, depth), "signed")
    id_of = F.coalesce("doc_id", F.lit(-(2**63)))
    classes = stage(
        signed.filter("cls IS NOT NULL").groupBy("cls").agg(
            F.min("doc_id").alias("least_id"), F.min(id_of).alias("look_up"), F.first("sig").alias("sig"), F.first("regions").alias("regions")
        ),
        "classes",
    )
    members = classes.select("cls", F.explode("regions").alias("region"))
    counts = members.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1")
    regions = stage(members.join(counts, "region"), "regions")
    candidates = stage(_candidates(regions, classes.select("cls", "sig"), least), "candidates")
    families = stage(components(candidates).select(F.col("vertex").alias("cls"), F.col("component").alias("family")), "families")
    wanted = families.join(classes.select("cls", F.col("look_up").alias("doc_id"), "sig"), "cls")
    wanted = wanted.select("cls", "family", "doc_id", "sig")
    sets = stage(_with_sets(docs, stage(wanted, "wanted"), words).drop("doc_id"), "sets")

    family_sizes = stage(sets.groupBy("family").agg(F.count("*").alias("n")), "family_sizes")
    large = stage(family_sizes.filter(F.col("n") > CHUNK), "large_families")
    split = not large.isEmpty()
    dealt = _deal_families(sets, large) if split else sets.withColumn("chunk", F.lit(0).cast("long"))
    first = _confirmed(dealt, ["family", "chunk"], percent, least)
    links = first.filter("b IS NOT NULL")
    parts = None
    if split:
        # representatives of the parts of all chunks of a large family meet
        heads = first.filter("b IS NULL").select(F.col("a").alias("cls"))
        second = sets.join(large.select("family"), "family").join(heads, "cls", "left_semi")
        sizes = second.groupBy("family").agg(F.count("*").alias("n"))
        pairs = deal_pairs(deal_chunks(second, ["family"], F.xxhash64("cls"), stage(sizes, "head_sizes"), CHUNK))
        links = stage(links.union(_confirmed(pairs, ["family", "i", "j"], percent, least).filter("b IS NOT NULL")), "links")
        # classes outside a family's main part meet all of it
        parts = components(links)
        inside = sets.join(large.select("family"), "family").join(parts, F.col("cls") == F.col("vertex"), "left")
        inside = stage(inside.withColumn("part", F.coalesce("component", "cls")).drop("vertex", "component"), "inside")
        by_part = inside.groupBy("family", "part").agg(F.count("*").alias("m"))
        main = by_part.groupBy("family").agg(F.max(F.struct("m", "part")).alias("most"), F.sum("m").alias("n"))
        main = stage(main.select("family", F.col("most.part").alias("main"), (F.col("n") - F.col("most.m")).alias("outside"), "n"), "main_parts")
        main = main.filter("outside > 0")
        chunked = inside.join(main, "family").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn("others", F.ceil(F.col("outside") / CHUNK).cast("int"))
        own = F.pmod(F.xxhash64("cls"), F.col("others")).cast("int")
        # not by the prefix: a dense subtree would be one chunk
        place = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks")).cast("int")
        columns = ["family", "cls", "sig", "shingles", "part"]
        inner = chunked.select(*columns, place.alias("j"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"), F.lit(0).alias("side"))
        outer = chunked.filter("part <> main").select(
            *columns, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), own.alias("i"), F.lit(1).alias("side")
        )
        third = _confirmed(inner.unionByName(outer), ["family", "i", "j"], percent, least).filter("b IS NOT NULL")
        if not third.isEmpty():
            links, parts = links.union(third), None
    # nothing is linked anew if the last look found no link
    parts = components(links) if parts is None else parts
    reach = classes.join(parts, F.col("cls") == F.col("vertex"))
    # the smallest id, null only if there is no other, with the smallest class that has it
    first_of = lambda: F.struct(F.col("least_id").isNull().alias("unnamed"), F.col("least_id").alias("doc_id"), "cls")
    least_of = reach.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min(first_of()).alias("first"))
    linked = stage(reach.select("cls", "component").join(least_of, "component").select("cls", "component_id", "first"), "linked")
    own = classes.select("cls", "least_id", first_of().alias("own"))
    keep = F.coalesce("first", "own").alias("keep")
    return signed, own.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "least_id").alias("component_id"), keep)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, depth: int = DEPTH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of different shingles of ``words`` words (fewer words:
    the whole sequence).  ``component_id`` is the smallest ``doc_id`` that links reach, ``kept`` marks that document.  Null and
    empty texts, and texts of white space only, have an empty set and are linked with nothing.  Rows that repeat an id and a text
    share a component; a row with a null id is a document of its own unless it is linked, and is never kept beside one with an id.
    Other columns are ignored.
    """
    signed, named = _linked(docs, words, percent, depth)
    out = signed.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("component_id").isNull()).alias("kept"))


def _with_class(docs: DataFrame, words: int, name: str = "_cls") -> DataFrame:
    """All columns of ``docs`` and ``name``, the key of the row's set (null if it is empty)."""

    def make():
        hashes = _Words()

        def run(texts):
            sets = [shingle_set(t, words, hashes) for t in texts]
            return {name: [_set_key(s) if len(s) else None for s in sets]}

        return run

    return map_texts(docs, make, f"{name} bigint", tuple(docs.columns))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, with one row of each group of linked ones: a row with the smallest id, null only if all ids are.

    Rows are decided one by one: exact copies with one id leave one row, and a row that repeats an id stays unless it is linked
    itself.  Rows with an empty set are linked with nothing and all stay.  Only rows whose id is repeated, or null, are shingled
    again to tell them apart.  The ids are broadcast up to ``BROADCAST_IDS`` of them; beyond it the join shuffles.
    """
    signed, named = _linked(docs, words, percent, DEPTH)
    rows = signed.select("doc_id", "cls").join(named, "cls", "left")
    stays = F.col("cls").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("cls") == F.col("keep.cls")))
    kinds = stage(rows.select("doc_id", "cls", stays.alias("stays")).groupBy("doc_id", "cls", "stays").agg(F.count("*").alias("n")), "row_kinds")
    kept = F.sum(F.when(F.col("stays"), F.col("n")).otherwise(0)).alias("kept")
    most = F.max(F.when(F.col("stays") & F.col("cls").isNotNull(), F.col("n")).otherwise(0)).alias("most")
    ids = kinds.groupBy("doc_id").agg(F.sum("n").alias("n"), kept, most).filter("kept < n OR most > 1")
    ids = stage(ids.select("doc_id", (F.col("kept") > 0).alias("mixed")), "dropped")

    def side(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if frame.count() <= BROADCAST_IDS else frame

    same = lambda other: docs["doc_id"].eqNullSafe(other["doc_id"])
    found = side(ids)
    out = docs.join(found, same(found), "left_anti").select(*docs.columns)
    mixed = ids.filter("mixed").select("doc_id")
    if mixed.isEmpty():
        return out
    found = side(mixed)
    name = "_cls"
    while name in [c.lower() for c in docs.columns]:
        name = f"_{name}"
    again = stage(_with_class(docs.join(found, same(found), "left_semi").select(*docs.columns), words, name), "repeated_ids")
    keepers = stage(kinds.filter("stays AND cls IS NOT NULL").join(mixed, kinds["doc_id"].eqNullSafe(mixed["doc_id"]), "left_semi"), "keepers")
    chosen = again.join(keepers, (again[name] == keepers["cls"]) & again["doc_id"].eqNullSafe(keepers["doc_id"]), "left_semi")
    one = chosen.dropDuplicates(["doc_id", name])
    return out.unionByName(again.filter(F.col(name).isNull()).unionByName(one).select(*docs.columns))
