"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the values that base patterns find: addresses, network addresses,
card and phone numbers. A term (a word) discloses an entity if it tells enough of the
entity's information content: over the corpus, PMI(entity; term) >= IC(entity) / ALPHA, where
IC = log2(N / n_entity) and PMI = log2(N * n_both / (n_entity * n_term)), counted in
documents. Chance is kept out by two conditions on witnesses, the documents that hold
both: there are at least ``LEAST_WITNESSES``, and witnesses times IC is at least
``LEAST_BITS``. Near copies are one witness: they are told by the least hash of their
five-word shingles. A term that never occurs without the entity is removed; other
disclosing terms are generalised. Both become spans wherever the term occurs.

What is shuffled: words with their document counts, summed in the task first; entities and
distinct words of documents that hold entities, written once; pairs of entities and terms
after three cuts that lose no pair (entities with enough witnesses; terms with enough
documents; terms not too frequent for the document's most frequent entity). Disclosing
terms, and then the documents that hold any, are broadcast while they are at most
``MOST_SENT`` rows, counted first, and joined by key beyond that.

Patterns are written so that a match costs the length of the text: possessive, with a
look-behind that only starts at the beginning of a run (or where the last match ended).

Defined cases: null text is empty, without spans; terms inside base spans are left to
those; repeated rows count as documents of their own, but as one witness; texts below five
words are their own shingle; a text that holds nothing but one entity has no term; empty
tables give empty results; texts of any length are whole; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import keep, quoted, unused
from taxolens.llm.importance import ascii_lower

# The kinds in their order, their patterns, and what a word is.
KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST, _WORD = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text without such a match never has.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
ALPHA, LEAST_WITNESSES, LEAST_BITS = 1.1, 3, 30.0
MOST_SENT = 200_000
TERM, REMOVE, GENERALISE = "term", "remove", "generalise"
#: Steps of a running sum that are appended one by one before they become a block.
_STEP = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the check of card numbers."""
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: d.cast("int"))
    parts = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def find(text: Column, kind: str, pattern: Column, valid: Callable[[Column], Column]) -> Column:
    """The valid matches of a pattern in a text as an array of (kind, start, end, value).

    ``split`` and ``regexp_extract_all`` cut the text at the same matches, so lengths of
    gaps and matches, summed up, are their places. The sum appends to blocks of ``_STEP``,
    so many matches cost no square of their number."""
    cuts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"))
    cuts = F.filter(cuts, lambda c: c.value.isNotNull())  # the last gap has no match
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / _STEP).cast("int")), lambda b: F.slice(cuts, b * _STEP + 1, F.lit(_STEP)))
    one = lambda at, found: F.struct(at.alias("at"), found.alias("found"))

    def step(state, cut):
        start = state.at + F.length(cut.gap)
        end = start + F.length(cut.value)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), cut.value.alias("value"))
        return one(end, F.array_append(state.found, span))

    def block(state, own):
        done = F.aggregate(own, one(state.at, F.array().cast(SPAN)), step)
        return one(done.at, F.array_append(state.found, done.found))

    walked = F.aggregate(blocks, one(F.lit(0), F.array().cast(f"array<{SPAN}>")), block).found
    return F.when(F.size(cuts) > 0, F.filter(F.flatten(walked), lambda s: valid(s.value))).otherwise(F.array().cast(SPAN))


def base_spans(rows: DataFrame, text: str, into: str) -> DataFrame:
    """``rows`` with ``into``: the base spans of each kind, kinds in their order."""
    plain = F.coalesce(F.col(text), F.lit(""))
    each = [F.when(plain.rlike(HINTS[k]), find(plain, k, F.lit(PATTERNS[k]), VALID[k])).otherwise(F.array().cast(SPAN)) for k in KINDS]
    return rows.withColumn(into, F.concat(*each))


def _entity(span) -> Column:
    """What makes two values one entity: an address in lower case, a number's digits."""
    value = F.when(span.kind == "email", F.lower(span.value)).when(span.kind == "ip", span.value).otherwise(_digits(span.value))
    return F.concat(span.kind, F.lit(":"), value)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"{_WORD}+"), F.lit(0))


def _witness(words: Column) -> Column:
    """The least hash of a text's five-word shingles: mostly equal for near copies."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 4))
    return F.array_min(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, 5), " "))))


def _sent(rows: DataFrame) -> DataFrame:
    """``rows``, marked for broadcast if counted to be few."""
    return F.broadcast(rows) if rows.limit(MOST_SENT + 1).count() <= MOST_SENT else rows


def disclosing_terms(docs: DataFrame, text: str = "text", alpha: float = ALPHA, witnesses: int = LEAST_WITNESSES, bits: float = LEAST_BITS) -> DataFrame:
    """(term, action, entities) of all terms of ``docs`` that disclose entities."""
    if alpha < 1:
        raise ValueError("alpha must be at least 1: a term can't tell more than all")
    whole = docs.select(F.coalesce(F.col(quoted([text])[0]), F.lit("")).alias("text"))
    n_docs = whole.count()
    found = base_spans(whole, "text", "spans").where(F.size("spans") > 0)
    found = found.select(F.array_distinct(F.transform("spans", _entity)).alias("entities"), _words(F.col("text")).alias("words"))
    holders = keep(found.select(F.monotonically_increasing_id().alias("row"), "entities", F.array_distinct("words").alias("terms"), _witness(F.col("words")).alias("witness")), "holders")
    listed = holders.select("row", "witness", F.explode("entities").alias("entity"))
    known = listed.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.count_distinct("witness").alias("w")).where(F.col("w") >= witnesses).drop("w")
    held = keep(listed.join(known, "entity"), "held")
    # the most documents a term can have and still disclose the document's likeliest entity
    most = held.groupBy("row").agg(F.max("n_entity").alias("top")).select(F.col("row").alias("own"), (F.pow("top", F.lit(1 / alpha)) * F.pow(F.lit(float(max(1, n_docs))), F.lit(1 - 1 / alpha)) * (1 + 1e-9)).alias("most"))
    terms = holders.join(most, F.col("row") == F.col("own")).select("row", "most", F.explode("terms").alias("term"))
    all_terms = whole.select(F.explode_outer(F.array_distinct(_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("word").isNotNull() & (F.col("n_term") >= witnesses))
    rare = terms.join(all_terms, F.col("term") == F.col("word")).where(F.col("n_term") <= F.col("most")).select("row", "term", "n_term")
    pairs = rare.join(held, "row").groupBy("entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_both"), F.count_distinct("witness").alias("w"))
    content = F.log2(F.lit(float(max(1, n_docs))) / F.col("n_entity"))
    told = F.log2(F.lit(float(max(1, n_docs))) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    strong = pairs.where((F.col("w") >= witnesses) & (told * alpha >= content) & (F.col("w") * content >= bits))
    action = F.when(F.max(F.col("n_both") == F.col("n_term")), REMOVE).otherwise(GENERALISE)
    return strong.groupBy("term").agg(action.alias("action"), F.count(F.lit(1)).alias("entities"))


def _keys(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("2"), text).alias("h2")]


def assess(docs: DataFrame, text: str = "text", into: str = "spans", **limits) -> DataFrame:
    """``docs`` with ``into``: an array of (kind, start, end, value, action), base spans
    first, then the spans of disclosing terms, each kind by start, in code points."""
    own = unused(docs.columns, "plain")
    listed = keep(disclosing_terms(docs, text, **limits), "disclosing")
    whole = docs.select(F.coalesce(F.col(quoted([text])[0]), F.lit("")).alias("text"))
    words = whole.select(*_keys(F.col("text")), F.explode_outer(F.array_distinct(_words(F.col("text")))).alias("word"))
    met = words.join(_sent(listed.select("term", "action")), F.col("word") == F.col("term"))
    # equal texts meet the same terms, so a set is what each would have
    hits = keep(met.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("term", "action"))).alias("terms")), "hits")
    h1, h2, terms, base = (unused([*docs.columns, own, into], c) for c in ("h1", "h2", "terms", "base"))
    keyed = docs.withColumn(own, F.coalesce(F.col(quoted([text])[0]), F.lit("")))
    key = _keys(F.col(own))
    keyed = keyed.withColumns({h1: key[0], h2: key[1]})
    sent = _sent(hits.select(F.col("h1").alias("hit1"), F.col("h2").alias("hit2"), F.col("terms").alias(terms)))
    rows = base_spans(keyed.join(sent, (keyed[h1] == sent["hit1"]) & (keyed[h2] == sent["hit2"]), "left"), own, base)
    pattern = F.concat(F.lit(f"(?<!{_WORD})(?:"), F.array_join(F.transform(terms, lambda t: t.term), "|"), F.lit(f")(?!{_WORD})"))
    found = F.when(F.size(terms) > 0, find(ascii_lower(F.col(own)), TERM, pattern, lambda v: F.lit(True))).otherwise(F.array().cast(SPAN))
    free = F.filter(found, lambda s: ~F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end)))
    action = F.map_from_entries(terms)
    acted = lambda s, what: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value"), what.alias("action"))
    spans = F.concat(F.transform(base, lambda s: acted(s, F.lit(REMOVE))), F.transform(free, lambda s: acted(s, F.element_at(action, s.value))))
    return rows.withColumn(into, spans).select(*[F.col(c) for c in quoted(docs.columns)], into)


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the counts of base kinds, the hash of base spans and
    all spans; columns of these names are replaced."""
    own = unused(docs.columns, "found")
    rows, found = assess(docs, text, own), F.col(f"`{own}`")
    base = F.filter(found, lambda s: s.kind != TERM)
    count = lambda k: F.size(F.filter(found, lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    new = [*[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans")]
    names = {text.lower(), *[f"n_{k}" for k in KINDS], "base_sha256", "spans"}
    return rows.select(*[F.col(c) for n, c in zip(docs.columns, quoted(docs.columns)) if n.lower() not in names], *new)


def sanitise(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``docs`` with spans taken out of the text: base values and disclosing terms that are
    removed leave their kind in brackets or nothing; generalised terms become ``[number]``
    or ``[word]``. Spans that overlap are one."""
    own = unused(docs.columns, "spans")
    rows = assess(docs, text, own, **limits)
    plain, name = F.col(quoted([text])[0]), f"`{own}`"
    order = F.array_sort(F.transform(name, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), s.value.alias("value"), s.action.alias("action"))))
    label = lambda s: F.when(s.kind != TERM, F.concat(F.lit("["), s.kind, F.lit("]"))).when(s.action == REMOVE, "").when(s.value.rlike("[0-9]"), "[number]").otherwise("[word]")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    step = lambda a, s: F.when(s.start >= a.at, state(s.end, F.concat(a.out, F.substring(plain, a.at + 1, s.start - a.at), label(s)))).otherwise(state(F.greatest(a.at, s.end), a.out))
    done = F.aggregate(order, state(F.lit(0), F.lit("")), step, lambda a: F.concat(a.out, F.substring(plain, a.at + 1, F.length(plain))))
    return rows.withColumn(text, F.when(F.size(name) > 0, done).otherwise(plain)).drop(own)
