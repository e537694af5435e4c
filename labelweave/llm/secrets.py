"""Secret scanning with Spark SQL functions only.

Three patterns give the base spans.  Further spans come from candidate strings of a character class: the Shannon
entropy of a window that slides over the candidate is kept from incremental counts, one character in and one out
for each step, and where it is high the windows are joined to a span.  Spans on the allow-list, or that touch a base span, are suppressed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed patterns of the base spans: kind -> (pattern, group whose length counts, least length)
BASE = {
    "assign": (
        "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + ")"
        + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: What a text must have for a base pattern to be worth while: the pattern with its least length.
_HINT = {
    "assign": BASE["assign"][0][:-1] + ")",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of ``alphabet`` that ``pattern`` finds and that satisfy ``also``."""

    name: str
    pattern: str
    also: str
    alphabet: str
    window: int
    bits: float


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{32,}", r"[0-9].*[A-Fa-f]|[A-Fa-f].*[0-9]", _DIGITS + "abcdefABCDEF", 32, 3.0),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", _DIGITS + _LOWER + _LOWER.upper() + "+/_=-", 20, 3.7),
)
#: Candidates that are known not to be secrets: placeholders, alphabets, identifiers in the usual form.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|0123456789|1234567890|abcdefghij|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
KINDS = (*BASE, *(c.name for c in CLASSES))


#: Elements of an array that grows while it is folded; full ones are set aside, so that none is copied over and over.
_PART = 256


def _running(array: Column, kind: str, emit, advance) -> Column:
    """Array of ``emit(at, x)``, of type ``kind``, for the elements ``x``; ``at`` starts at 0 and becomes ``advance(at, x)``."""
    empty, none = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def step(state, x):
        part = F.concat(state["part"], F.array(emit(state["at"], x)))
        full = F.size(state["part"]) >= _PART - 1
        return F.struct(
            advance(state["at"], x).alias("at"),
            F.when(full, F.concat(state["parts"], F.array(part))).otherwise(state["parts"]).alias("parts"),
            F.when(full, empty).otherwise(part).alias("part"),
        )

    begin = F.struct(F.lit(0).alias("at"), none.alias("parts"), empty.alias("part"))
    return F.aggregate(array, begin, step, lambda s: F.flatten(F.concat(s["parts"], F.array(s["part"]))))


def _positions(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """Array of ``(start, end, text, value)`` of the leftmost non-overlapping matches, in code points.

    The pieces between the matches come from splitting by the same pattern; starts are running sums of the
    lengths of pieces and matches.
    """
    found = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(F.regexp_extract_all(text, F.lit(pattern), 0)), F.lit(0))).alias("piece"),
        *[F.regexp_extract_all(text, F.lit(pattern), g).alias(f"g{g}") for g in groups],
    )
    value = f"g{groups[-1]}"

    def emit(at, x):
        start = at + F.length(x["piece"])
        return F.struct(start.alias("start"), (start + F.length(x["g0"])).alias("end"), x["g0"].alias("text"), x[value].alias("value"))

    return _running(found, "struct<start:int,end:int,text:string,value:string>", emit, lambda at, x: at + F.length(x["piece"]) + F.length(x["g0"]))


_SPANS = "array<struct<start:int,end:int,kind:string,rank:int>>"


def _base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    # a run of hexadecimal digits that is too short can be left out of the search: no match can begin inside a longer one
    spans = _positions(text, _HINT[kind] + "[0-9a-f]*" if kind == "hex" else pattern, (0, group) if group else (0,))
    firm = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    rank = KINDS.index(kind)
    made = F.transform(firm, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank")))
    return F.when(text.rlike(_HINT[kind]), made).otherwise(F.array().cast(_SPANS))


def window_range(candidate: Column, kind: CharacterClass) -> Column:
    """``(first, last)`` in code points: from the first window of high entropy to the end of the last; -1 if there is none."""
    w = kind.window
    logs = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(w + 2)])
    # the entropy of a window is log2(w) - sum(n log2 n) / w
    most = w * (math.log2(w) - kind.bits) + 1e-9
    begin = F.struct(
        F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )

    def fold(chars):
        def step(state, i):
            place = lambda at: F.instr(F.lit(kind.alphabet), F.element_at(chars, at + 1))
            came = place(i)
            went = F.when(i >= w, place(i - w)).otherwise(F.lit(0))
            n_came, n_went = F.element_at(state["counts"], came), F.when(went > 0, F.element_at(state["counts"], F.greatest(went, F.lit(1)))).otherwise(0)
            value = lambda n: F.element_at(logs, n + 1)
            moved = F.when(went == 0, value(n_came + 1) - value(n_came)).when(
                went == came, F.lit(0.0)
            ).otherwise(value(n_came + 1) - value(n_came) + value(F.greatest(n_went, F.lit(1)) - 1) - value(n_went))
            counts = F.transform(state["counts"], lambda n, k: n + F.when(k + 1 == came, 1).otherwise(0) - F.when(k + 1 == went, 1).otherwise(0))
            total = state["total"] + moved
            high = (i >= w - 1) & (total <= most)
            return F.struct(
                F.when(came == went, state["counts"]).otherwise(counts).alias("counts"),
                total.alias("total"),
                F.when((state["first"] < 0) & high, i - w + 1).otherwise(state["first"]).alias("first"),
                F.when(high, i + 1).otherwise(state["last"]).alias("last"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), begin, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    # the characters are split once and bound: an expression inside the fold would be computed anew at each step
    chars = F.filter(F.split(candidate, ""), lambda c: c != "")
    return F.element_at(F.transform(F.array(chars), fold), 1)


def _entropy_spans(text: Column, kind: CharacterClass, base: Column) -> Column:
    spans = _positions(text, kind.pattern, (0,))
    likely = F.filter(spans, lambda s: s["text"].rlike(kind.also) & ~s["text"].rlike(ALLOWED))
    ranged = F.transform(likely, lambda s: F.struct(s["start"].alias("at"), window_range(s["text"], kind).alias("r")))
    found = F.filter(ranged, lambda x: x["r"]["first"] >= 0)
    rank = KINDS.index(kind.name)
    made = F.transform(
        found,
        lambda x: F.struct(
            (x["at"] + x["r"]["first"]).alias("start"), (x["at"] + x["r"]["last"]).alias("end"), F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank")
        ),
    )
    free = F.filter(made, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.when(text.rlike(kind.pattern), free).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    texts = F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of ``(start, end, kind, rank)`` spans of each whole text.

    Spans are in code points, the end is exclusive.  A null or empty text has none.  Each row is independent, so repeated rows,
    null ids and other columns pass through; a column named like a new one is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast(_SPANS)
    with_base = docs.withColumn("base", F.concat(*[_base_spans(body, kind) for kind in BASE]))
    added = F.concat(*[_entropy_spans(body, c, F.col("base")) for c in CLASSES])
    worth = body.rlike(CLASSES[1].pattern)
    return with_base.withColumn("added", F.when(worth, added).otherwise(empty))


def secret_report(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )


#: Code points of the blocks in which a text is cut, so that a piece is taken from the blocks around it alone.
_BLOCK = 1024


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by ``mark``; ``n_chars`` follows the text where there is such a column.

    Overlapping spans are replaced together.  A null text stays null.
    """
    columns = docs.columns
    # columns of the documents that are named like the spans are set aside meanwhile
    aside = {c: f"_aside_{c}" for c in columns if c in ("base", "added")}
    found = find_secrets(docs.withColumnsRenamed(aside))
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    # what stays before each span, or nothing where spans overlap; at the end what stays after the last one
    length = F.length("text")
    ends = F.concat(spans, F.array(F.struct(length.alias("start"), length.alias("end"))))
    kind = "struct<from:int,until:int,first:boolean>"
    stays = _running(
        ends,
        kind,
        lambda at, s: F.struct(at.alias("from"), s["start"].alias("until"), (s["start"] >= at).alias("first")),
        lambda at, s: F.greatest(at, s["end"]),
    )
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), 0)

    def cut(held):
        def piece(s):
            near = F.slice(held, F.floor(s["from"] / _BLOCK).cast("int") + 1, F.floor(s["until"] / _BLOCK).cast("int") - F.floor(s["from"] / _BLOCK).cast("int") + 1)
            return F.substring(F.array_join(near, ""), s["from"] % _BLOCK + 1, s["until"] - s["from"])

        return F.array_join(F.transform(F.filter(stays, lambda s: s["first"]), piece), mark)

    rebuilt = F.element_at(F.transform(F.array(blocks), cut), 1)
    any_span = F.size(F.concat("base", "added")) > 0
    out = found.withColumn("text", F.when(F.col("text").isNotNull() & any_span, rebuilt).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(any_span, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in columns])
