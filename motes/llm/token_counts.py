"""Token counts of a byte-level byte-pair vocabulary by compiled finite-state machines.

A machine over classes of characters cuts text into pieces: letters, digits, other signs, each with one blank before it, white space, and the
English endings 's 't 're 've 'm 'll 'd; a run of white space leaves its last character to what follows. What follows a white space or an apostrophe may cut before it, so a transition says whether a cut lies before the character
read, and before the one before that. A text is read in blocks side by side: each block's map from every state before it to the state after it is
made first, the maps are composed by a parallel prefix scan, and the blocks are then read again from their known states. The pieces go, side by side too,
through the transducer of byte_pairs, whose transitions carry by how much the count of tokens grows.

A text of more than CHUNK characters is cut into chunks, each counted in a task of its own choice. A chunk in the middle of a text does not know the state before
it: its maps show from where on all states agree, and it stands for (head, count, tail) - what lies before its first cut that holds after any beginning, the
tokens of the pieces between, and what lies after its last cut. Such chunks compose: the tail of one and the head of the next are counted as a text.

Strings of added tokens inside texts are single tokens, found leftmost and longest first, as the library does by default; texts on both sides are cut separately.

Defined results: null counts as the empty text, which has no tokens; rows that repeat are rows each; columns named n_bytes, n_tokens or over_limit give way
to the results, other columns stay; an empty table gives none; a vocabulary of another kind raises ValueError.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_pairs import Merges, Transducer
from .common import n_splits, packed, slices, table

LIMIT = 512
#: Characters of a chunk.
CHUNK = 1 << 17
#: Bytes of text read side by side.
UNIT = 2_000_000
#: Characters of a block.
BLOCK = 64
FILE = "byte_bpe_50k.json"
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# classes of characters; ENDS are letters that end an apostrophe's ending at once, R and V need an e, L needs an l
BLANK, WHITE, DIGIT, SIGN, QUOTE, ENDS, R_OR_V, E, ELL, LETTER, ADDED, END = range(12)
LETTERS = (ENDS, R_OR_V, E, ELL, LETTER)
# states: what the piece read so far is
FRESH, IN_LETTERS, IN_DIGITS, IN_SIGNS, ONE_BLANK, ONE_WHITE, MORE_BLANK, MORE_WHITE, AT_QUOTE, QUOTE_E, QUOTE_L = range(11)
STATES, CLASSES = 11, 12
#: Code points that stand for an added token and for the end of a text.
ADDED_POINT, END_POINT = 0x110000, 0x110001
HERE, BEFORE = 1, 2


def _begun(c: int) -> int:
    """State after the first character of a piece."""
    return {BLANK: ONE_BLANK, WHITE: ONE_WHITE, DIGIT: IN_DIGITS, SIGN: IN_SIGNS, QUOTE: AT_QUOTE, ADDED: FRESH, END: FRESH}.get(c, IN_LETTERS)


def _inside(c: int) -> int:
    """State after a character other than white space that follows the piece's blank."""
    return IN_SIGNS if c == QUOTE else _begun(c)


def _read(state: int, c: int) -> tuple[int, int]:
    """Next state, and where cuts are: before this character (HERE), before the last one (BEFORE)."""
    white, over = c in (BLANK, WHITE), c in (ADDED, END)
    if state == QUOTE_E and c == E or state == QUOTE_L and c == ELL or state == AT_QUOTE and c == ENDS:
        return FRESH, 0
    if state in (QUOTE_E, QUOTE_L):  # no ending: the apostrophe was a sign, and its letter begins a piece
        return (IN_LETTERS, BEFORE) if c in LETTERS else (_begun(c), BEFORE | HERE)
    if state == AT_QUOTE:
        if c in (R_OR_V, ELL):
            return (QUOTE_E if c == R_OR_V else QUOTE_L), 0
        return (IN_SIGNS, 0) if c in (SIGN, QUOTE) else (_begun(c), HERE)
    if state in (ONE_BLANK, ONE_WHITE, MORE_BLANK, MORE_WHITE):
        if white:
            return (MORE_BLANK if c == BLANK else MORE_WHITE), 0
        if over:
            return FRESH, HERE
        cut = BEFORE if state in (MORE_BLANK, MORE_WHITE) else 0
        return (_inside(c), cut) if state in (ONE_BLANK, MORE_BLANK) else (_begun(c), cut | HERE)
    same = {IN_LETTERS: LETTERS, IN_DIGITS: (DIGIT,), IN_SIGNS: (SIGN, QUOTE)}.get(state, ())
    return (state, 0) if c in same else (_begun(c), HERE)


_STEPS = [_read(s, c) for c in range(CLASSES) for s in range(STATES)]
NEXT = np.array([s for s, _ in _STEPS], np.uint8)
CUTS = np.array([f for _, f in _STEPS], np.uint8)


def character_classes() -> np.ndarray:
    """The class of every code point and of the two stand-ins: general categories L and N, and the characters with the property White_Space."""
    out = np.full(END_POINT + 1, SIGN, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else DIGIT
    out[WHITE_SPACE] = WHITE
    for letters, c in ((" ", BLANK), ("'", QUOTE), ("stmd", ENDS), ("rv", R_OR_V), ("e", E), ("l", ELL)):
        out[[ord(x) for x in letters]] = c
    out[ADDED_POINT], out[END_POINT] = ADDED, END
    return out


def settled_points(vocabulary: str) -> dict[int, int]:
    """Classes of the code points that Unicode versions tell apart: as the library cuts them, whatever version Python has here."""
    cut = Tokenizer.from_str(vocabulary).pre_tokenizer.pre_tokenize_str
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    known = {c: {x for m in regex.finditer(p, text) for x in m[0]} for p, c in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT))}
    out = {}
    for x in text:
        kind = {"L": LETTER, "N": DIGIT}.get(unicodedata.category(x)[0])
        if any((x in points) != (c == kind) for c, points in known.items()):
            out[ord(x)] = next((c for before, c in (("a", LETTER), ("1", DIGIT)) if len(cut(before + x)) == 1), SIGN)
    return out


class Counter:
    """Counts tokens by the vocabulary of one file; settled: classes of code points in which Unicode versions differ."""

    def __init__(self, vocabulary: str, settled: dict[int, int]):
        held = json.loads(vocabulary)
        model, before = held["model"], held["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain &= before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and held["normalizer"] is None
        plain &= held["truncation"] is None and held["padding"] is None
        added = [t["content"] for t in held["added_tokens"]]
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in held["added_tokens"]):
            raise ValueError("only plain byte-level byte-pair vocabularies can be compiled")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.transducer = Transducer(Merges(pairs))
        self.classes = character_classes()
        self.classes[list(settled)] = list(settled.values())
        self.added = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

    def points(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the texts, each with END_POINT after it and ADDED_POINT for added tokens; bytes, and where each point's bytes begin."""
        marks, size, parts = [], 0, []
        for t in texts:
            if self.added and self.added.search(t):
                last, kept = 0, []
                for m in self.added.finditer(t):
                    kept += [t[last : m.start()], chr(0)]
                    last = m.end()
                    marks.append(size + sum(map(len, kept)) - 1)
                t = "".join([*kept, t[last:]])
            parts.append(t)
            size += len(t) + 1
        whole = chr(0).join([*parts, ""])
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        points[np.array(marks, np.int64)] = ADDED_POINT
        points[np.cumsum([len(p) + 1 for p in parts]) - 1] = END_POINT
        return points, np.frombuffer(whole.encode(), np.uint8), np.concatenate(([0], np.cumsum(width)))

    def cuts(self, classes: np.ndarray, known: bool = True) -> tuple[np.ndarray, int]:
        """Whether a piece begins at each character, and from which character on that is certain whatever came before (0 if the state before is FRESH)."""
        n = len(classes)
        blocks = -(-n // BLOCK)
        held = np.full(blocks * BLOCK, END, np.intp)
        held[:n] = classes
        held = held.reshape(blocks, BLOCK) * STATES
        maps = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
        for k in range(BLOCK):
            maps = NEXT[held[:, k, None] + maps]
        apart = 1
        while apart < blocks:  # after each round a row is the map of twice as many blocks that end there
            maps[apart:] = np.take_along_axis(maps[apart:], maps[:-apart].astype(np.intp), axis=1)
            apart *= 2
        state = np.concatenate((np.zeros(1, np.uint8), maps[:-1, FRESH]))
        agreed = 0
        if not known:
            alike = np.flatnonzero((maps[:-1] == maps[:-1, :1]).all(axis=1))
            agreed = (int(alike[0]) + 1) * BLOCK if len(alike) else n
        flags = np.empty((blocks, BLOCK), np.uint8)
        for k in range(BLOCK):
            at = held[:, k] + state
            flags[:, k], state = CUTS[at], NEXT[at]
        flags = flags.ravel()[: n + 1] if blocks * BLOCK > n else np.append(flags.ravel(), 0)
        begins = (flags[:n] & HERE) > 0
        begins[:-1] |= (flags[1:n] & BEFORE) > 0
        return begins, agreed

    def pieces(self, points: np.ndarray, data: np.ndarray, at: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Tokens that begin at each character: those of a piece at its first one."""
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(points))
        total = np.zeros(len(points), np.int64)
        own = points[first] < ADDED_POINT
        total[first[own]] = self.transducer.counts(data, at[first[own]], at[last[own]])
        total[first[points[first] == ADDED_POINT]] = 1
        return total

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        if not texts:
            return np.zeros(0, np.int64)
        points, data, at = self.points(texts)
        begins, _ = self.cuts(self.classes[points])
        total = self.pieces(points, data, at, begins)
        end = np.flatnonzero(points == END_POINT)
        return np.diff(np.concatenate(([0], np.cumsum(total)[end])))

    def chunks(self, text: str, size: int) -> list[str]:
        """The text in chunks of about so many characters, none ending inside an added token."""
        edges, inside = list(range(size, len(text), size)), [m.span() for m in self.added.finditer(text)] if self.added else []
        for begin, end in inside:
            edges = [end if begin < e < end else e for e in edges]
        edges = sorted({0, *edges, len(text)})
        return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def summary(self, text: str, first: bool) -> tuple[str, int | None, str]:
        """A chunk as (head, count, tail); count is null, and all is head, where no cut is certain. first: the text begins with it."""
        points, data, at = self.points([text])
        points, at = points[:-1], at[:-1]  # the text goes on
        classes = self.classes[points]
        begins, agreed = self.cuts(classes, first)
        sure = begins.copy()
        sure[:agreed] = False
        if not first:  # white space before a cut may be cut otherwise where it ends a text
            sure[0] = False
            sure[1:] &= ~np.isin(classes[:-1], (BLANK, WHITE))
        heads = np.flatnonzero(sure)
        if not len(heads):
            return text, None, ""
        begin, end = int(heads[0]), int(np.flatnonzero(begins)[-1])
        if points.max(initial=0) < ADDED_POINT:
            show = lambda a, b: text[a:b]
        else:
            spans = [m.span() for m in self.added.finditer(text)]
            longer = np.ones(len(points), np.int64)
            longer[points == ADDED_POINT] = [b - a for a, b in spans]
            place = np.concatenate(([0], np.cumsum(longer)))
            show = lambda a, b: text[place[a] : place[b]]
        inner = begins.copy()
        inner[:begin] = inner[end:] = False
        cut = slice(begin, end)
        total = int(self.pieces(points[cut], data, at[begin : end + 1], inner[cut]).sum()) if end > begin else 0
        return show(0, begin), total, show(end, len(points))

    def total(self, parts: list[tuple[str, int | None, str]]) -> int:
        """Tokens of a text from its chunks in order."""
        count, tail, joins = 0, [], []
        for head, n, rest in parts:
            tail.append(head)
            if n is not None:
                joins.append("".join(tail))
                count, tail = count + n, [rest]
        joins.append("".join(tail))
        return count + int(self.count(joins).sum())


_COUNTERS: dict[str, Counter] = {}


def counter(vocabulary: str, settled: dict[int, int]) -> Counter:
    """The process's counter of a vocabulary; what it compiles for one batch serves the next."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(vocabulary, settled)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """docs without text, with n_bytes (UTF-8), n_tokens and over_limit. vocabulary: content of a tokenizer file, a few megabytes that every task receives."""
    settled = settled_points(vocabulary)
    counter(vocabulary, settled)  # raises early
    made = ["n_bytes", "n_tokens", "over_limit"]
    held, rest = packed(docs, ["text"], made)
    # a row's number comes from its place in the scan, so a task that runs again gives the same
    held = held.select("_rest", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("_row"))
    kept = held.select("_rest").schema.simpleString().removeprefix("struct<").removesuffix(">").replace("_rest:", "_rest ", 1)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, UNIT):
            counts = counter(vocabulary, settled).count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), batch.column("n_bytes"), pa.array(counts)], names=["_rest", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, UNIT):
            for i in range(batch.num_rows):
                parts = counter(vocabulary, settled).chunks(batch.column("text")[i].as_py(), chunk)
                ones = batch.select(["_rest", "n_bytes", "_row"]).take(pa.array([i] + [None] * (len(parts) - 1), pa.int64()))
                row = pa.array([batch.column("_row")[i].as_py()] * len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays([ones.column("_rest"), ones.column("n_bytes"), row, pa.array(range(len(parts)), pa.int32()), pa.array(parts)], names=["_rest", "n_bytes", "_row", "place", "text"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, UNIT):
            parts = [counter(vocabulary, settled).summary(t, p == 0) for t, p in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist(), strict=True)]
            head, count, tail = (list(x) for x in zip(*parts, strict=True)) if parts else ([], [], [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_rest", "n_bytes", "_row", "place")), pa.array(head, pa.string()), pa.array(count, pa.int64()), pa.array(tail, pa.string())], names=["_rest", "n_bytes", "_row", "place", "head", "count", "tail"])

    @F.pandas_udf("long")
    def composed(parts: pd.Series) -> pd.Series:
        return pd.Series([counter(vocabulary, settled).total([(x["head"], x["count"], x["tail"]) for x in p]) for p in parts], dtype="int64")

    long = F.length("text") > chunk
    short = held.where(~long).select("_rest", "text", "n_bytes").mapInArrow(whole, f"{kept}, n_bytes long, n_tokens long")
    pieces = held.where(long).mapInArrow(cut, f"{kept}, n_bytes long, _row long, place int, text string")
    # a few long texts may lie in one split: their chunks are dealt anew
    dealt = pieces.repartition(n_splits(docs), "_row", "place").mapInArrow(summed, f"{kept}, n_bytes long, _row long, place int, head string, count long, tail string")
    parts = F.sort_array(F.collect_list(F.struct("place", "head", F.col("count").alias("count"), "tail")))
    rows = dealt.groupBy("_row").agg(F.max("n_bytes").alias("n_bytes"), F.first("_rest", ignorenulls=True).alias("_rest"), parts.alias("parts"))
    joined = rows.select("_rest", "n_bytes", composed("parts").alias("n_tokens"))
    return short.unionByName(joined).select(*rest, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """path: of the vocabulary file, read by the driver; by default the public one of the box."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(FILE)
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), Path(path).read_text(encoding="utf-8"))
