"""Toxicity by a learned lexicon, matched through Levenshtein automata, with scores of the context of each match.

Lexicon: words, and word beginnings (stems), that tell toxic documents from others among labelled ones, by a likelihood ratio test
that counts every document once. A stem also counts by the documents with two of it. Of terms that begin alike the one with the largest ratio stays, so a stem has its natural length.
Words sit in a trie; a token meets the trie under a Levenshtein automaton (one edit for words of 5 characters or more, two from 9
on), so misspelled words match. Tokens near a word that clean training documents hold are other words, no misspellings (`innocent`).
Digits and signs inside tokens are read as letters too.
Context: a match inside quotation marks, or within WINDOW tokens after a word of reporting, counts as quoted. Exact words, stems (with the
text's length, since chance matches grow with it), misspelled and quoted words give a score by logistic regression, penalised towards PRIOR.
So that the weight of misspellings is learned, every training document is counted once more with typing errors in its long tokens; so that the weight of
quotation is, once more as a quotation, which is no abuse whatever it quotes.

The model is fitted on at most TRAIN_DOCS labelled rows by hash order (a documented parameter) whose crc32(doc_id) mod 3 is not 1. A term
marks SUPPORT of the toxic ones at least, which bounds the lexicon, so it is broadcast. Scoring reads whole texts; lang, source, doc_id and labels are no inputs.

Defined results: null counts as the empty text; texts without a match share one low score; without labels the prior weights
and an empty lexicon give every text that score; rows of labels with a null label or id are not used, and an id with several labels
is toxic if one of them says so; texts of one or two words are learned from like others; rows that repeat a doc_id are scored each; a null doc_id is not held out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, packed, slices, stash, windows, word_hashes

TRAIN_DOCS, WINDOW, THRESHOLD = 20_000, 4, 0.7
#: Lengths of stems, and the share of the toxic training documents that a term must mark.
STEMS, SUPPORT = range(4, 25), 0.01
#: Least logarithm of a term's likelihood ratio, and least share of toxic documents among those with a word or stem.
GAIN, WORD_RATE, STEM_RATE = float(np.log(50_000)), 0.9, 0.3
#: Weights of: 1, words, stems, number of stems, length of texts with stems, misspelled words, quoted words.
PRIOR = np.array([-3.0, 6.0, 0.5, 1.0, 0.0, 4.0, 1.5])
TOKEN = re.compile(r"\w[\w@$!*]*\w|\w")
LETTERS = str.maketrans("013457@$!", "oieastasi")
SIGNS = re.compile(r"[0-9@$!*]")
# fixed values: words of reporting in the languages of the tables, and quotation marks with those that close them
REPORTING = frozenset("said says saying quote quoted quotes wrote called calls term word sagte schrieb nannte zitat wort dit écrit appelé mot dijo escribió llamó palabra".split())
CLOSING = {"“": "”", "«": "»", "„": "“”", '"': '"'}
MARK = re.compile(r"[“”«»„\n]|(?<!\w)\"|\"(?!\w)")


def variants(token: str) -> list[str]:
    """A lower-case token, and the same with signs read as letters if it mixes both."""
    plain = SIGNS.search(token) and not token.isdigit() and token.translate(LETTERS).replace("*", "")
    return [token, plain] if plain else [token]


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans of quotations within a line, in one pass."""
    out: list[tuple[int, int]] = []
    begun, ends = -1, ""
    for m in MARK.finditer(text):
        c = m[0]
        if c == "\n":
            begun = -1
        elif begun >= 0 and c in ends:
            out.append((begun, m.end()))
            begun = -1
        elif begun < 0 and c in CLOSING:
            begun, ends = m.start(), CLOSING[c]
    return out


class Lexicon:
    """Trie of terms. Words match whole tokens, stems match beginnings; automata allow edits in words, but not to an innocent token."""

    def __init__(self, words: list[str], stems: list[str], innocent: list[str] = ()):
        self.words, self.stems, self.innocent = frozenset(words), frozenset(stems), frozenset(innocent)
        self.lengths = sorted({len(s) for s in stems})
        self.trie: dict = {}
        for w in words:
            if len(w) >= 5:
                node = self.trie
                for c in w:
                    node = node.setdefault(c, {})
                node[""] = w
        # one edit leaves the first or the second half of a term in place, two edits one of three parts: which parts a token must show, for its length
        self.shown: dict[tuple[int, str], set[int]] = {}
        for w in words:
            if len(w) >= 5:
                edits = 2 if len(w) >= 9 else 1
                cut = [len(w) * i // (edits + 1) for i in range(edits + 2)]
                for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                    for shift in range(-edits, edits + 1) if 0 < i < edits else (0,):
                        at = a + shift if i < edits else a - len(w)  # the last part is counted from the end
                        self.shown.setdefault((at, w[a:b]), set()).update(range(len(w) - edits, len(w) + edits + 1))
        self.looks = sorted({(at, len(part)) for at, part in self.shown})
        self.memo: dict[str, int] = {}

    def _may_match(self, token: str) -> bool:
        n = len(token)
        for at, size in self.looks:
            a = at if at >= 0 else n + at
            if n in self.shown.get((at, token[a : a + size]), ()):
                return True
        return False

    def _automaton(self, token: str) -> int:
        """Length of a term that is within its number of edits: the automaton's states are rows of edit distances, stepped along the trie."""
        stack = [(self.trie, list(range(len(token) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= (2 if len(child) >= 9 else 1):
                        return len(child)
                    continue
                new = [row[0] + 1]
                for i, t in enumerate(token):
                    new.append(min(row[i] + (t != c), row[i + 1] + 1, new[i] + 1))
                if min(new) <= 2:
                    stack.append((child, new))
        return 0

    def match(self, token: str) -> int:
        """0 no match, 1 word, 2 stem, 3 misspelled word or signs for letters."""
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
            found = 0
            for v in variants(token):
                if v in self.words:
                    found = 1 if v is token else 3
                elif any(v[:n] in self.stems for n in self.lengths):
                    found = found or 2
                elif not found and v not in self.innocent and self._may_match(v) and self._automaton(v):
                    found = 3
            self.memo[token] = found
        return found


def evidence(lexicon: Lexicon, text: str) -> tuple[int, int, int, int, int]:
    """Numbers of matches of words, of stems, of misspelled words, of quoted words, and of tokens."""
    low = text.lower()
    tokens = TOKEN.findall(low)
    memo, match = lexicon.memo, lexicon.match
    hits = {}
    for t in set(tokens):
        k = memo.get(t)
        if k or (k is None and (k := match(t))):
            hits[t] = k
    if not hits:
        return 0, 0, 0, 0, len(tokens)
    starts = ends = np.zeros(0)
    if quoted := quotations(low):
        starts, ends = np.array(quoted).T
    count = [0, 0, 0, 0]
    recent = -WINDOW - 1
    for i, m in enumerate(TOKEN.finditer(low)):
        t = m[0]
        if t in REPORTING:
            recent = i
        elif t in hits:
            at = np.searchsorted(starts, m.start(), "right") - 1
            told = i - recent <= WINDOW or (at >= 0 and m.start() < ends[at])
            count[3 if told else hits[t] - 1] += 1
    return (*count, len(tokens))


def mistyped(text: str) -> str:
    """The lower-case text with one letter of every token of 5 letters or more left out, doubled or changed, as a hash of the token says."""

    def typo(m: re.Match) -> str:
        t = m[0]
        if len(t) < 5 or not t.isalpha():
            return t
        h = zlib.crc32(t.encode())
        i = 1 + h // 3 % (len(t) - 2)
        return t[:i] + ("", t[i] + t[i], chr(97 + h // 101 % 26))[h % 3] + t[i + 1 :]

    return TOKEN.sub(typo, text.lower())


def as_quoted(text: str) -> str:
    """The text with every line in quotation marks."""
    return "\n".join(f"“{re.sub('[“”«»„]', ' ', line)}”" for line in text.split("\n"))


def _design(counts: np.ndarray) -> np.ndarray:
    """Features of evidence: for words mostly whether there is one, a little how many; for stems also how many in how long a text."""
    counts = np.asarray(counts, float).reshape(-1, 5)
    some = lambda x: 0.9 * (x > 0) + 0.1 * np.log1p(x)
    words, stems, near, quoted, size = counts.T
    return np.stack([np.ones(len(counts)), some(words), 1.0 * (stems > 0), np.log1p(stems), (stems > 0) * np.log((size + 30) / 200), some(near), some(quoted)], axis=1)


def fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Newton's method on the penalised log loss of rows that count n times, with steps halved until the loss falls."""
    w = PRIOR.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + penalty / 2 * ((w - PRIOR) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(PRIOR))
        step = np.linalg.solve(hess, x.T @ (n * (p - y)) + penalty * (w - PRIOR))
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def chosen_terms(counts: list[tuple[str, int, int]], n: int, pos: int) -> dict:
    """Words and stems of terms() with (term, documents with it, toxic ones), by falling likelihood ratio; what begins like a chosen one goes.

    n and pos are the numbers of all documents and of toxic ones.
    """

    def gain(a: int, b: int) -> float:
        total = 0.0
        for m, k in ((a, b), (n - a, pos - b)):
            for part, share in ((k, pos / n), (m - k, 1 - pos / n)):
                if part > 0:
                    total += part * np.log(part / m / share)
        return total

    usable = [(t, a, b) for t, a, b in counts if b >= (WORD_RATE if t[0] == "w" else STEM_RATE) * a]
    found = sorted(((gain(a, b), t[0] == "w", len(t), t) for t, a, b in usable), key=lambda f: (-round(f[0], 6), not f[1], -f[2], f[3]))
    words, stems, taken = [], [], set()
    begun: set[str] = set()
    for g, _, _, t in found:
        term = t[1:]
        if g < GAIN or term in begun or any(term[:k] in taken for k in range(STEMS[0], len(term) + 1)):
            continue
        (words if t[0] == "w" else stems).append(term)
        taken.add(term)
        begun.update(term[:k] for k in range(STEMS[0], len(term) + 1))
    return {"words": sorted(words), "stems": sorted(stems)}


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, n: int = TRAIN_DOCS) -> DataFrame:
    """(text, toxic) of at most n labelled documents, near copies once."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most n rows of two numbers

    def family(batches):
        for batch in batches:
            (h,), owner = word_hashes([t.encode() for t in batch.column("text").to_pylist()])
            key, at = windows(h, owner, 3)
            least = np.full(batch.num_rows, np.iinfo(np.uint64).max)
            np.minimum.at(least, owner[at], key)
            # a text without such a run is a family of its own words
            sign = h.copy()
            sign[1:] ^= (owner[1:] == owner[:-1]) * (h[:-1] * np.uint64(31))
            short = np.bincount(owner, minlength=batch.num_rows) < 3
            own = np.zeros(batch.num_rows, np.uint64)
            np.add.at(own, owner, sign)
            least[short] = mix(own[short])
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(least.view(np.int64))], names=["text", "toxic", "family"])

    # near copies mostly share the smallest hash of their three-word runs; one of them is enough to learn from. Texts of one or two words are copies only if equal
    return rows.mapInArrow(family, "text string, toxic int, family long").groupBy("family", "toxic").agg(F.min("text").alias("text"))


def terms(text: str) -> set[str]:
    """w and each word of a text; s and each stem; d and each stem of two tokens or more."""
    tokens = Counter(TOKEN.findall(text.lower()))
    words = {v for t in tokens for v in variants(t) if len(v) >= 3}
    begins = Counter()
    for w, n in tokens.items():
        begins.update({w[:k]: n for k in STEMS if len(w) > k})
    return {"w" + w for w in words} | {"s" + b for b in begins} | {"d" + b for b, n in begins.items() if n > 1}


def _counts(among=None):
    """A map over frames of text: (term, n), n the number of texts with it, only of terms among the given ones if any are."""

    def run(frames):
        for pdf in frames:
            n = Counter()
            for text in pdf.text:
                n.update(terms(text) if among is None else terms(text) & among)
            yield pd.DataFrame({"term": pd.Series(list(n), dtype=object), "n": list(n.values())})

    return run


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Lexicon and weights; passes over the bounded sample."""
    rows = stash(training_rows(docs, labels), "toxic-train")
    total = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not total[0] or not total[1] or total[0] == total[1]:
        return {"words": [], "stems": [], "innocent": [], "weights": PRIOR}
    count = lambda df, among=None: df.select("text").mapInPandas(_counts(among), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    marks = {r.term: r.n for r in count(rows.where("toxic = 1")).where(F.col("n") >= max(3, SUPPORT * total[1])).collect()}
    held = [(r.term, r.n, marks[r.term]) for r in count(rows, marks.keys()).collect()]
    lexicon = chosen_terms(held, *total)

    def near(frames):
        lex = Lexicon(**lexicon)
        for pdf in frames:
            found = {t for text in pdf.text for t in set(TOKEN.findall(text.lower())) if lex.match(t) == 3}
            yield pd.DataFrame({"token": sorted(found)}, dtype=object)

    innocent = sorted(r.token for r in rows.where("toxic = 0").mapInPandas(near, "token string").distinct().collect())

    def counted(frames):
        lex = Lexicon(**lexicon, innocent=innocent)
        for pdf in frames:
            seen = Counter((*evidence(lex, form(t)), y * (form is not as_quoted)) for t, y in zip(pdf.text, pdf.toxic, strict=True) for form in (str, mistyped, as_quoted))
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=[*"abcdeyn"])

    table = rows.mapInPandas(counted, "a long, b long, c long, d long, e long, y int, n long").toPandas()
    weights = fit_weights(_design(table[[*"abcde"]].to_numpy()), table.y.to_numpy(), table.n.to_numpy())
    return lexicon | {"innocent": innocent, "weights": weights}


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score (double). docs needs doc_id and text; all its columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs, rest = packed(docs, ["doc_id", "text"], ["score", "predicted"])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        model = held.value
        lexicon = Lexicon(model["words"], model["stems"], model["innocent"])
        for batch in slices(batches):
            e = [evidence(lexicon, t or "") for t in batch.column("text").to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(_design(e) @ model["weights"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=["doc_id", "text", "_rest", "score"])

    return docs.mapInArrow(run, schema).select("doc_id", "text", *rest, "score")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 from the threshold on)."""
    return score_texts(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
