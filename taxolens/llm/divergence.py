"""Source divergence audit: how the words of each source differ from its neighbours'.

Text is tokenized on bytes: an Arrow batch's texts are one UTF-8 buffer, a table of 256
entries tells word bytes from others and lower-cases A-Z, and word boundaries are where
that changes. Slices are grouped by xxhash; every slice is compared with the first of its
group byte by byte, and those that differ are grouped by their bytes instead. Counts are
merged over a task before they leave it, then summed by Spark.

Terms in at least ``LEAST_DOCS`` documents of their language are kept. Each language's
terms are dealt by hash over blocks of some ``BLOCK_ENTRIES`` counts. A block is a sparse
matrix of sources by terms in CSR form: terms that neither of two sources has add a
constant, those that one has are sums over its row, so a block costs sources times counts,
not sources times sources times terms. Sums over blocks meet in Spark.

All arithmetic is on integers; products stay within 64 bits while a source has fewer than
9e15 words.

Defined cases: null text, lang and source are empty texts; groups without kept terms have
probabilities from smoothing alone, and 0 against each other where a language keeps none;
a language with one source has no pairs; repeated rows count as often as they occur; empty
tables give an empty result; texts and words of any length are whole; further columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolens.llm.common import keep, release, small_batches

# Smoothing, the scale of probabilities, and what is kept and shown.
SMOOTH, SCALE, LEAST_DOCS, MOST_TERMS = 2, 1_000_000_000, 10, 10
#: Texts are tokenized together until they have so many bytes.
TOGETHER = 4 << 20
#: A task merges its counts when so many rows wait, and lets them go when so many are left.
MERGE_ROWS, MOST_ROWS = 600_000, 300_000
#: Counts in a block of the matrix, about.
BLOCK_ENTRIES = 1 << 17
_A, _Z = ord("A"), ord("Z")
#: Bytes of words: letters of ASCII and all bytes of other characters.
IS_WORD = np.array([b >= 0x80 or _A <= b <= _Z or ord("a") <= b <= ord("z") for b in range(256)])
LOWERED = np.array([b + 32 if _A <= b <= _Z else b for b in range(256)], np.uint8)
COUNTS = "lang string, source string, term string, n long, docs long"


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in ``data``, the texts that begin at ``offsets`` one after
    the other; a word does not go on into the next text."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = IS_WORD[data]
    fresh = np.zeros(data.size + 1, bool)
    fresh[offsets] = True
    fresh[0] = fresh[-1] = True
    padded = np.concatenate([[False], inside, [False]])
    begins = inside & (~padded[:-2] | fresh[:-1])
    ends = inside & (~padded[2:] | fresh[1:])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(first, own): the number of a slice of each kind, and the kind of each slice. Slices
    are of one kind exactly if their bytes are the same."""
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, starts.size)
    _, first, own = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - starts
    differ = sizes != sizes[first[own]]
    same = np.flatnonzero(~differ)
    lengths = sizes[same]
    tops = np.cumsum(lengths)
    for a, b in _runs(tops, 1 << 20):  # a bounded number of bytes at once
        part, n = same[a:b], lengths[a:b]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        unlike = data[np.repeat(starts[part], n) + within] != data[np.repeat(starts[first[own[part]]], n) + within]
        if unlike.any():
            differ[part[np.unique(np.repeat(np.arange(part.size), n)[unlike])]] = True
    kinds: dict[bytes, int] = {}
    extra = []
    for i in np.flatnonzero(differ).tolist():
        word = raw[starts[i] : ends[i]]
        if word not in kinds:
            kinds[word] = first.size + len(extra)
            extra.append(i)
        own[i] = kinds[word]
    return np.concatenate([first, np.array(extra, np.int64)]), own


def _runs(tops: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes (``tops``: running totals) sum to at most
    ``most``, or of one item."""
    a = 0
    while a < tops.size:
        b = max(a + 1, int(np.searchsorted(tops, (tops[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _count(texts: pa.Array, group: np.ndarray, names: pa.Table) -> pa.Table:
    """Counts and documents of the terms of some texts, by group."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = LOWERED[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    starts, ends = boundaries(data, offsets)
    if not starts.size:
        return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "term": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "docs": pa.array([], pa.int64())})
    first, kind = group_slices(data, starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    seen, n = np.unique(kind.astype(np.int64) * len(texts) + doc, return_counts=True)  # a term in a document
    cell, back = np.unique(seen // len(texts) * names.num_rows + group[seen % len(texts)], return_inverse=True)
    raw = data.tobytes()
    term = pa.array([raw[starts[i] : ends[i]] for i in first.tolist()], pa.binary()).cast(pa.string())
    own = names.take(pa.array(cell % names.num_rows))
    return pa.table({
        "lang": own.column("lang"), "source": own.column("source"), "term": term.take(pa.array(cell // names.num_rows)),
        "n": pa.array(np.bincount(back, n).astype(np.int64)), "docs": pa.array(np.bincount(back).astype(np.int64)),
    })


def _merge(tables: list[pa.Table]) -> pa.Table:
    merged = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return merged.rename_columns(["lang", "source", "term", "n", "docs"])


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.Table] = []
    rows = 0
    for batch in batches:
        pairs = pa.table({"lang": batch.column("lang").cast(pa.string()), "source": batch.column("source").cast(pa.string())})
        names = pairs.group_by(["lang", "source"]).aggregate([])
        number = {pair: i for i, pair in enumerate(zip(names.column("lang").to_pylist(), names.column("source").to_pylist()))}
        group = np.fromiter((number[p] for p in zip(pairs.column("lang").to_pylist(), pairs.column("source").to_pylist())), np.int64, pairs.num_rows)
        texts = batch.column("text").cast(pa.large_string())
        tops = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        for a, b in _runs(tops, TOGETHER):
            waiting.append(_count(texts.slice(a, b - a), group[a:b], names))
            rows += waiting[-1].num_rows
            if rows >= MERGE_ROWS:
                waiting = [_merge(waiting)]
                rows = waiting[0].num_rows
                if rows >= MOST_ROWS:
                    yield from waiting.pop().to_batches(max_chunksize=50_000)
                    rows = 0
    if waiting:
        yield from _merge(waiting).to_batches(max_chunksize=50_000)
    release()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term."""
    small_batches(docs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = docs.select(plain("text"), plain("lang"), plain("source")).mapInArrow(_tokenize, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / total), by long division in base 1000."""
    rest = count + SMOOTH
    found = rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // total
        rest = rest % total
    return found + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """One term's part of the triangular discrimination, rounded down."""
    d = p - q
    return d * d // (p + q)


def _row_sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the rows of a CSR matrix; ``begins`` has a further entry at the end."""
    out = np.zeros(begins.size - 1, np.int64)
    full = np.flatnonzero(begins[1:] > begins[:-1])
    if full.size:
        out[full] = np.add.reduceat(values, begins[full])
    return out


PARTS = "lang string, source string, part string, item string, value long"


def _block(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one block of a language's terms: the part of each pair of sources (once, source
    before item), and the terms of each source that stand out most."""
    groups = groups.sort_by("source")
    lang, names = groups.column("lang")[0], groups.column("source").combine_chunks()
    width, totals = groups.column("kept_terms")[0].as_py(), groups.column("group_words").to_numpy() 
    size = totals + SMOOTH * width
    terms = counts.column("term").combine_chunks().dictionary_encode() if counts.num_rows else None
    row = pc.index_in(counts.column("source"), value_set=names).to_numpy().astype(np.int64) if counts.num_rows else np.zeros(0, np.int64)
    at = terms.indices.to_numpy().astype(np.int64) if terms is not None else np.zeros(0, np.int64)
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    n = counts.column("n").to_numpy()[order] if counts.num_rows else np.zeros(0, np.int64)
    begins = np.searchsorted(row, np.arange(len(names) + 1))
    columns = len(terms.dictionary) if terms is not None else 0
    p = shares(n, size[row]) if n.size else n
    none = shares(np.zeros(size.size, np.int64), size) if columns else np.ones(size.size, np.int64)
    left, right, value = [], [], []
    line = np.zeros(columns, np.int64)
    for i in range(len(names) - 1):
        own = slice(begins[i], begins[i + 1])
        others = slice(begins[i + 1], row.size)
        line[:] = none[i]
        line[at[own]] = p[own]
        both = columns * divergence(none[i], none[i + 1 :])  # as if neither had any term
        for a in range(begins[i], begins[i + 1], 4096):
            mine = p[a : min(a + 4096, begins[i + 1]), None]
            both = both + (divergence(mine, none[None, i + 1 :]) - divergence(none[i], none[None, i + 1 :])).sum(0)
        theirs = line[at[others]]
        corrected = divergence(theirs, p[others]) - divergence(theirs, none[row[others]])
        both = both + _row_sums(corrected, begins[i + 1 :] - begins[i + 1])
        left += [i] * both.size
        right += range(i + 1, len(names))
        value.append(both)
    out = [_rows(lang, names.take(pa.array(left, pa.int64())), "pair", names.take(pa.array(right, pa.int64())), np.concatenate(value) if value else np.zeros(0, np.int64))]
    if n.size:
        q = shares(counts.column("lang_n").to_numpy()[order], np.int64(groups.column("lang_words")[0].as_py() + SMOOTH * width))
        over = np.flatnonzero(p > q)
        best = pa.table({"row": row[over], "value": divergence(p[over], q[over]), "term": terms.dictionary.take(pa.array(at[over]))}).sort_by([("row", "ascending"), ("value", "descending"), ("term", "ascending")])
        of = best.column("row").to_numpy()
        place = np.arange(of.size) - np.searchsorted(of, of)
        best = best.filter(pa.array(place < MOST_TERMS))
        out.append(_rows(lang, names.take(best.column("row").combine_chunks()), "term", best.column("term").combine_chunks(), best.column("value").to_numpy()))
    return pa.concat_tables(out)


def _rows(lang: pa.Scalar, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.Table:
    k = len(source)
    return pa.table({"lang": pa.array([lang.as_py()] * k, pa.string()), "source": source, "part": pa.array([part] * k, pa.string()), "item": item, "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups of ``docs`` (text, lang,
    source): ``pair`` rows hold the divergence from each other source of the language,
    ``term`` rows the terms that a source has more of than its language, most divergent
    first, at most ``most_terms`` (up to ``MOST_TERMS``)."""
    if not 1 <= most_terms <= MOST_TERMS:
        raise ValueError(f"the number of terms must be 1-{MOST_TERMS}")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counts = keep(term_counts(docs), "term-counts")
    known = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs")).where(F.col("lang_docs") >= least_docs).drop("lang_docs")
    kept = keep(counts.drop("docs").join(known, ["lang", "term"]), "kept-counts")
    groups = docs.select(plain("lang"), plain("source")).distinct()
    # the distinct terms of a language are those of its sums, so they are counted there
    words = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_words"), F.count(F.lit(1)).alias("entries"))
    langs = words.groupBy("lang").agg(F.sum("group_words").alias("lang_words"), F.sum("entries").alias("entries"))
    width = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept_terms"))
    zero = F.lit(0).cast("long")
    about = groups.select("lang").distinct().join(langs, "lang", "left").join(width, "lang", "left").select(
        "lang", F.coalesce("lang_words", zero).alias("lang_words"), F.coalesce("kept_terms", zero).alias("kept_terms"), F.greatest(F.lit(1), F.ceil(F.coalesce("entries", zero) / BLOCK_ENTRIES)).cast("int").alias("blocks"),
    )
    about = keep(about, "languages")
    sides = keep(groups.join(words.drop("entries"), ["lang", "source"], "left").join(about, "lang").withColumn("group_words", F.coalesce("group_words", zero)), "groups")
    dealt = kept.join(about.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).drop("blocks")
    each = sides.select("lang", "source", "group_words", "lang_words", "kept_terms", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    parts = keep(dealt.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(_block, PARTS), "parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    both = pairs.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    return both.withColumn("rank", F.row_number().over(order)).unionByName(terms)
