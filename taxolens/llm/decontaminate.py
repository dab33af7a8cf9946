"""Benchmark decontamination by a generalised suffix automaton of the items.

Items are lower-cased (A-Z) word sequences. The automaton of all items takes the
words of a document one by one and keeps the length of the longest match that ends
there; where that reaches ``WINDOW`` words, the words of the match are hit, and the
state names the items. Items of fewer words are windows as a whole. Only runs of
words whose neighbouring pairs all occur in items are walked.

Automata are built on the executors, one for each block of at most ``BLOCK_BYTES`` of item
text (a longer item is cut into pieces that overlap by all but one word of a window, so
no window is lost), and written as flat arrays to the shared folder, whence the scanning
workers read them. One pass over the documents holds those of ``PASS_BYTES`` of item
text; more make more passes, whose hits are united before documents are judged or cut.

Defined cases: a null or empty text has no words, a null or wordless item has no window;
repeated items are one if they share an id; an item without an id marks words but is
not listed; repeated documents are each judged; coverage of exactly the limit stays; a
very long text takes memory in proportion; columns named like ``into`` are replaced, all
others stay; empty tables hit nothing.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import fresh_path, keep, open_shared, publish, quoted, release, small_batches, unused, utf8
from taxolens.llm.hashing import Lookup, hashed_words

WINDOW = 10
#: A document that is hit in more than this share of its words is removed whole.
MOST_COVERAGE = 0.5
#: Item text in one automaton, and in those that one pass over the documents holds.
BLOCK_BYTES, PASS_BYTES = 1 << 20, 16 << 20
#: Windows of an item in one piece.
PIECE_WORDS = 20_000
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, after lower-casing A-Z; other bytes part words.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RESULT = "n_words long, hit array<int>, items array<string>"


@dataclass
class Builder:
    """A suffix automaton that grows: transitions, suffix links, longest lengths."""

    window: int = WINDOW
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if (q := step[last].get(c)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    def build(self, items: list[tuple[str | None, bytes]]) -> Automaton:
        """The automaton of (name, text); a text is a whole item or a piece of one."""
        hashes = [(name, h.view(np.int64)) for (name, _), h in zip(items, hashed_words([t.translate(KEPT) for _, t in items], lower=False))]
        hashes = [(name, h) for name, h in hashes if h.size]
        words = np.unique(np.concatenate([h for _, h in hashes])) if hashes else np.zeros(0, np.int64)
        coded = [(name, np.searchsorted(words, h).tolist()) for name, h in hashes]
        pairs = set()
        for _, ids in coded:
            pairs.update(zip(ids, ids[1:]))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        n, order = max(1, words.size), sorted(range(len(self.step)), key=self.length.__getitem__)
        # the state of the window that ends in a state's longest match
        base = [-1] * len(self.step)
        for v in order:
            up = self.link[v]
            if self.length[v] >= self.window:
                base[v] = v if self.length[up] < self.window else base[up]
        names = sorted({name for name, _ in coded if name is not None})
        number = {name: i for i, name in enumerate(names)}
        named: dict[int, set[int]] = {}
        short: dict[int, set[tuple[int, int]]] = {}
        for name, ids in coded:
            state = 0
            for i, c in enumerate(ids):
                state = self.step[state][c]
                if i + 1 >= self.window and name is not None:
                    named.setdefault(base[state], set()).add(number[name])
            if len(ids) < self.window:
                short.setdefault(state, set()).add((len(ids), number.get(name, -1)))
        # short items by all states whose match may end with one
        ends: dict[int, set[tuple[int, int]]] = {}
        for v in order:
            found = short.get(v, set()) | (ends.get(self.link[v], set()) if self.link[v] >= 0 else set())
            if found:
                ends[v] = found
        moves = sorted((v * n + c, to) for v, own in enumerate(self.step) for c, to in own.items())
        return Automaton(
            self.window, min([self.window, *(len(ids) for _, ids in coded)]), Lookup(words), Lookup(np.array(sorted(a * n + b for a, b in pairs), np.int64)),
            np.array([k for k, _ in moves], np.int64), np.array([to for _, to in moves], np.int32), np.array(self.link, np.int32), np.array(self.length, np.int32), np.array(base, np.int32),
            names, {k: sorted(v) for k, v in named.items()}, {k: sorted(v) for k, v in ends.items()},
        )


@dataclass
class Automaton:
    """A finished automaton as flat arrays: ``moves`` (state * words + word) are sorted."""

    window: int
    least: int
    words: Lookup
    pairs: Lookup
    moves: np.ndarray
    to: np.ndarray
    link: np.ndarray
    length: np.ndarray
    base: np.ndarray
    names: list[str]
    named: dict[int, list[int]]
    short: dict[int, list[tuple[int, int]]]

    def runs(self, ids: np.ndarray, edges: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words that may hold a window; ``edges`` part the documents."""
        n = ids.size
        if n < self.least or not self.words.keys.size:
            return []
        joined = np.zeros(n + 1, bool)  # does a word belong with the one before?
        if self.least > 1:
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            key = ids[both].astype(np.int64) * self.words.keys.size + ids[both + 1]
            joined[both[self.pairs.find(key) >= 0] + 1] = True
            joined[edges[edges < n]] = False
            change = np.diff(np.concatenate([[False], joined[1:n], [False]]).astype(np.int8))
            found = zip(np.flatnonzero(change == 1).tolist(), (np.flatnonzero(change == -1) + 1).tolist())
        else:
            joined[1:n] = (ids[:-1] >= 0) & (ids[1:] >= 0)
            joined[edges[edges < n]] = False
            known = ids >= 0
            starts, ends = np.flatnonzero(known & ~joined[:n]), np.flatnonzero(known & ~joined[1:]) + 1
            found = zip(starts.tolist(), ends.tolist())
        return [(a, b) for a, b in found if b - a >= self.least]

    def walk(self, ids: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(first, behind last, items) of each window in a run of known words."""
        n, state, size = max(1, self.words.keys.size), 0, 0
        for i, c in enumerate(ids):
            while (at := self._move(state * n + c)) < 0 and state:
                state = int(self.link[state])
                size = int(self.length[state])
            if at >= 0:
                state, size = int(self.to[at]), size + 1
            if size >= self.window:
                yield i + 1 - self.window, i + 1, self.named.get(int(self.base[state]), [])
            for length, name in self.short.get(state, ()):
                if length <= size:
                    yield i + 1 - length, i + 1, [name] if name >= 0 else []

    def _move(self, key: int) -> int:
        at = int(np.searchsorted(self.moves, key))
        return at if at < self.moves.size and self.moves[at] == key else -1


def scan(automata: list[Automaton], texts: list[bytes]) -> Iterator[tuple[int, list[int], list[str]]]:
    """For each text: its number of words, positions of hit words, and items hit."""
    each = [h.view(np.int64) for h in hashed_words([t.translate(KEPT) for t in texts], lower=False)]
    edges = np.concatenate([[0], np.cumsum([h.size for h in each])]).astype(np.int64)
    flat = np.concatenate(each) if each else np.zeros(0, np.int64)
    hits: list[set[int]] = [set() for _ in texts]
    names: list[set[str]] = [set() for _ in texts]
    for a in automata:
        ids = a.words.find(flat)
        for begin, end in a.runs(ids, edges):
            doc = int(np.searchsorted(edges, begin, "right")) - 1
            base = begin - int(edges[doc])
            for first, last, items in a.walk(ids[begin:end].tolist()):
                hits[doc].update(range(base + first, base + last))
                names[doc].update(a.names[i] for i in items)
    for own, hit, items in zip(each, hits, names):
        yield own.size, sorted(hit), sorted(items)


def _pieces(most: int):
    """Items cut into pieces of so many windows: (item_id, text)."""

    def pieces(batches):
        for batch in batches:
            ids, out = [], []
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = text.translate(KEPT).split()
                for at in range(0, max(1, len(words) - WINDOW + 1), most):
                    piece = words[at : at + most + WINDOW - 1]
                    if piece:
                        ids.append(name)
                        out.append(b" ".join(piece))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary()).cast(pa.string())], ["item_id", "text"])

    return pieces


def automata(items: DataFrame, block: int = BLOCK_BYTES, at_once: int = PASS_BYTES, piece: int = PIECE_WORDS) -> list[list[str]]:
    """Builds the automata of ``items`` and returns their files, a list for each pass."""
    spark = items.sparkSession
    small_batches(spark)
    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    pieces = keep(rows.mapInArrow(_pieces(piece), "item_id string, text string"), "items")
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not total:
        return []
    parts = -(-2 * total // block) if total > block else 1
    folder = fresh_path(spark, "automata")

    def build(batches):
        own: dict[int, list[tuple[str | None, bytes]]] = {}
        for batch in batches:
            for k, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                own.setdefault(k, []).append((name, text))
        paths = []
        for k in sorted(own):
            paths.append(f"{folder}/block-{k:06d}.pickle")
            publish(paths[-1], pickle.dumps(Builder().build(sorted(own.pop(k), key=lambda x: (x[0] is None, x)))))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])
        release()

    placed = pieces.select(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)).cast("int").alias("block"), "item_id", "text")
    paths = sorted(r.path for r in placed.repartition(parts, "block").mapInArrow(build, "path string").collect())  # a name a block
    step = max(1, at_once // block)
    return [paths[at : at + step] for at in range(0, len(paths), step)]


@lru_cache(maxsize=PASS_BYTES // BLOCK_BYTES)
def _load(path: str) -> Automaton:
    """A worker's own copy of an automaton, for its next tasks too."""
    with open_shared(path, "rb") as f:
        return pickle.loads(f.read())


def _scan(paths: list[str]):
    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        out = list(scan([_load(p) for p in paths], utf8(texts)))
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["n_words", "hit", "items"])

    return found


def match(docs: DataFrame, items: DataFrame, text: str = "text", into: str = "match", block: int = BLOCK_BYTES, at_once: int = PASS_BYTES) -> DataFrame:
    """``docs`` with a struct more: n_words, hit (positions of words) and items."""
    return _match(docs, automata(items, block, at_once), text, into)


def _match(docs: DataFrame, passes: list[list[str]], text: str, into: str) -> DataFrame:
    small_batches(docs.sparkSession)
    out = docs.withColumn(into, _scan(passes[0] if passes else [])(F.col(text)))
    for paths in passes[1:]:
        more = unused(out.columns, "__more")
        out = keep(out, "match").withColumn(more, _scan(paths)(F.col(text)))
        both = F.struct(F.col(f"{into}.n_words").alias("n_words"), F.array_union(f"{into}.hit", f"{more}.hit").alias("hit"), F.array_union(f"{into}.items", f"{more}.items").alias("items"))
        out = out.withColumn(into, both).drop(more)
    return out


def cut(text: bytes, hit: list[int]) -> bytes:
    """The text without the runs of hit words."""
    spans = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(KEPT))]
    out, at, i = [], 0, 0
    while i < len(hit):
        j = i
        while j + 1 < len(hit) and hit[j + 1] == hit[j] + 1:
            j += 1
        out.append(text[at : spans[hit[i]][0]])
        at, i = spans[hit[j]][1], j + 1
    return b"".join([*out, text[at:]])


def _clean(paths: list[str], most: float):
    @F.arrow_udf("text string, dirty boolean, gone boolean")
    def clean(texts: pa.Array) -> pa.Array:
        found, rows, raw = [_load(p) for p in paths], [], utf8(texts)
        for text, (n, hit, _) in zip(raw, scan(found, raw)):
            dirty, gone = bool(hit), len(hit) > most * n
            while hit and not gone:
                text = cut(text, hit)
                n, hit, _ = next(scan(found, [text]))
                gone = n == 0
            rows.append((text.decode("utf-8", "replace") if dirty and not gone else None, dirty, gone))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.bool_()))], ["text", "dirty", "gone"])

    return clean


def remove(docs: DataFrame, items: DataFrame, most: float = MOST_COVERAGE, block: int = BLOCK_BYTES, at_once: int = PASS_BYTES) -> DataFrame:
    """``docs`` without benchmark passages: hit runs of words are cut out, and rows
    that are hit beyond ``most`` of their words (or of which no word is left) go.
    ``n_chars``, where there is such a column, follows the text; clean rows stay as
    they are. Cutting goes on until no window occurs across a cut either. Hits are those
    of all items, in however many blocks they come."""
    small_batches(docs.sparkSession)
    names, passes = quoted(docs.columns), automata(items, block, at_once)
    if not passes:
        return docs
    if len(passes) > 1:
        return _remove_by_rounds(docs, passes, most)
    own = unused(docs.columns, "__clean")
    dirty = F.col(f"{own}.dirty")
    # as not deterministic, it runs once a row, not again for the filter in workers of its own
    out = docs.withColumn(own, _clean(passes[0], most).asNondeterministic()(F.col("text"))).where(~F.col(f"{own}.gone"))
    changed = {"text": F.when(dirty, F.col(f"{own}.text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(dirty, F.char_length(f"{own}.text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*names)


def _cut():
    @F.arrow_udf("string")
    def less(texts: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([cut(t, h).decode("utf-8", "replace") for t, h in zip(utf8(texts), hits.to_pylist())], pa.string())

    return less


def _remove_by_rounds(docs: DataFrame, passes: list[list[str]], most: float) -> DataFrame:
    """``remove`` in several passes: each round unites the hits of all of them, and only
    what it cuts goes through the next one."""
    names, m = quoted(docs.columns), unused(docs.columns, "__m")
    hit, n = F.size(f"{m}.hit"), F.col(f"{m}.n_words")
    seen = keep(_match(docs, passes, "text", m), "hits")
    out = seen.where(hit == 0).select(*names)
    dirty = seen.where((hit > 0) & (hit <= most * n))
    while not dirty.isEmpty():
        less = dirty.withColumn("text", _cut()(F.col("text"), F.array_sort(f"{m}.hit"))).select(*names)
        if "n_chars" in docs.columns:
            less = less.withColumn("n_chars", F.char_length("text").cast("long"))
        seen = keep(_match(keep(less, "cut"), passes, "text", m), "hits")
        out = out.unionByName(seen.where((hit == 0) & (n > 0)).select(*names))
        dirty = seen.where(hit > 0)
    return out
