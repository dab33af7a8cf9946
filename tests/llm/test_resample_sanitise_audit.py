"""Importance resampling, sanitisation and the source audit: brute force and defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolens.llm import disclosure, divergence, importance, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, `text.x` string"


def say(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéßÀ") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    rows = []
    for i in range(150):
        text = say(rng, vocabulary, rng.choice([0, 1, 2, 3, 19, 20, 25, 60])).replace(" ", rng.choice([" ", ", ", "-", "\n"]))
        rows.append((i, rng.choice([str.upper, str.title, str])(text), rng.choice(["en", "de", None]), rng.choice(["s0", "s1", "s2", None, ""]), "x"))
    rows += [(3, rows[3][1], "en", "s0", "x"), (3, rows[3][1], "en", "s0", "x"), (None, say(rng, vocabulary, 30), "en", "s1", "x"), (900, None, "fr", "lonely", "x"), (901, "", "fr", None, "x")]
    rows += [(902, say(rng, vocabulary, 40_000), "en", "s0", "x"), (903, "Y" * 300_000, "de", "s9", None), (904, "İstanbul ΣΑΣ K ÉÀ I", "de", "s9", None)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- 11


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_ranks(rows, target):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for x in target:
        t.update(features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((n + 1) * (all_t + 10_000)))) for b, n in s.items()}
    out = []
    for r in rows:
        w, f = features(r[1])
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for place, x in enumerate(fit[: 5 * len(fit) // 100], 1):
        x[4] = place
    return sorted((tuple(x[:5]) for x in out), key=str)


def test_ranks_equal_brute_force(spark, docs, none):
    rng = random.Random(3)
    target = [say(rng, [w for r in ROWS[:20] for w in (r[1] or "").split()], 30), None, ""]
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    found = importance.rank(importance.weigh(docs, goal))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in found.collect()), key=str) == brute_ranks(ROWS, target)
    assert importance.rank(importance.weigh(none, goal)).isEmpty()
    no_goal = importance.rank(importance.weigh(docs, goal.limit(0)))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in no_goal.collect()), key=str) == brute_ranks(ROWS, [])
    drawn = importance.resample(docs, goal)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {r[0] for r in brute_ranks(ROWS, target) if r[4]}
    with pytest.raises(ValueError):
        importance.weigh(docs, goal, buckets=0)


def test_only_ascii_is_lower_cased(spark):
    texts = ["AbÇ", "ABC", "İ ΣΑΣ", "ǅ", "ÄZ", "äZ", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", importance.ascii_lower(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [t and t.translate(LOW) for t in texts[:-1]] + [None]


# ---- 12

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", " -"),
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def right(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute_base(text):
    return [(k, m.start(), m.end(), m[0]) for k, p in RAW.items() for m in re.finditer(p, text or "") if right(k, m[0])]


def brute_terms(texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [set(word.findall((t or "").translate(LOW))) for t in texts]
    held = []
    for t in texts:
        held.append({k + ":" + (v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)) for k, _, _, v in brute_base(t)})
    n_term, n_entity = Counter(x for s in terms for x in s), Counter(x for s in held for x in s)
    found = {}
    for e, ne in n_entity.items():
        rows = [i for i, s in enumerate(held) if e in s]
        for t, both in Counter(x for i in rows for x in terms[i]).items():
            # texts here share no five-word run, so witnesses are distinct texts
            w = len({texts[i] for i in rows if t in terms[i]})
            content, told = math.log2(len(texts) / ne), math.log2(len(texts) * both / (ne * n_term[t]))
            if w >= 3 and told * disclosure.ALPHA >= content - 1e-12 and w * content >= disclosure.LEAST_BITS:
                found[t] = "remove" if both == n_term[t] or found.get(t) == "remove" else "generalise"
    return found


def brute_spans(text, terms):
    base, low = brute_base(text), (text or "").translate(LOW)
    extra = [("term", m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low) if m[0] in terms and not any(a < m.end() and m.start() < b for _, a, b, _ in base)]
    return base + extra


def private_texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijkéß") for _ in range(5)) for _ in range(3000)]
    noise = lambda: say(rng, vocabulary, 30)
    texts = [noise() for _ in range(5000)]
    for i in range(6):  # one person: the name and the town give the address away, the common word does not
        texts.append(f"{noise()} Vorlak {noise()} Mail VORLAK.{7}@Mail.example.com {noise()} common")
    texts += [f"{noise()} vorlak Xanten {noise()} vorlak.7@mail.example.com 10.20.30.40" for _ in range(4)]
    texts += [f"{noise()} xanten" for _ in range(2)] + [f"{noise()} common" for _ in range(200)]
    copied = f"{noise()} Zebulon zeb@copy.example.org {noise()}"
    texts += [copied] * 40  # copies are one witness: nothing is disclosed
    return texts


HARD = [
    "a@b.c d.e-f@x-y.z.w@q.r %%@a.b a@b a@-.- a..@b..c +-@1.2.3.4 é@b.cé", "1.2.3.4.5.6.7.8 256.1.1.1 0255.00.1.249 1.2.3 999999999999.1.1.1 1..2.3.4 10.0.0.1.",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111 5 - 5 4111  1111 1111 1111 1- 4111111111111111 4111111111111111-4", "+1 (017) 555-7713 +49.30.123456 +1 ) 2 + +12 +1234567890123456 ++123456789 +1-800-555-0199 ext 4",
    "\U0001F600 x@y.zz \U0001F600 4111111111111111", "@" * 3000, "1" * 20_000, "1 " * 9000, "a" * 50_000 + "@b.c", ".1" * 20_000, "+1 " * 5000, None, "", "x@y.zz " * 700,
]


def test_base_spans_equal_plain_search(spark):
    rng = random.Random(8)
    texts = HARD + ["".join(rng.choice("a1.@+-( )%2é45") for _ in range(rng.randint(5, 120))) for _ in range(400)]
    rows = disclosure.base_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "s").collect()
    for r in rows:
        assert [tuple(s) for s in r.s] == brute_base(r.text), (r.text or "")[:200]


def test_terms_that_disclose(spark):
    texts = private_texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(5)
    want = brute_terms([t for i, t in enumerate(texts) if i < len(texts) - 39])  # without further copies, which only dilute
    found = {r.term: r.action for r in disclosure.disclosing_terms(docs).collect()}
    assert {"vorlak", "xanten"} & set(found) == {"vorlak"} or found["xanten"] == "generalise"
    assert found["vorlak"] == "remove" and "zebulon" not in found and "common" not in found
    exact = {r.term: r.action for r in disclosure.disclosing_terms(docs.where(f"doc_id < {len(texts) - 39}")).collect()}
    assert exact == want
    got = {r.doc_id: r for r in disclosure.digest(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base, spans = brute_base(t), brute_spans(t, found)
        line = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in s)
        assert got[i].spans == line(spans) and got[i].base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == kind for k, *_ in base) for kind in disclosure.KINDS)
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert "orlak" not in clean[5003].lower() and "[email]" in clean[5003] and clean[5003].endswith("common") and clean[0] == texts[0]


@pytest.mark.parametrize("sent", [200_000, 0])
def test_sanitising_by_join_and_of_nothing(spark, none, monkeypatch, sent):
    monkeypatch.setattr(disclosure, "MOST_SENT", sent)
    texts = private_texts()[4000:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert disclosure.digest(docs).where("spans like '%term%'").count() == 12  # ten with the name, two with the town alone
    assert disclosure.digest(none).isEmpty() and disclosure.disclosing_terms(none).isEmpty()
    odd = spark.createDataFrame([(1, None), (1, None), (None, "a@b.cc"), (2, "x " * 100_000)], "doc_id long, text string")
    assert sorted(r.spans for r in disclosure.digest(odd).collect()) == ["", "", "", "email:0:6"]
    with pytest.raises(ValueError):
        disclosure.disclosing_terms(docs, alpha=0.5)


# ---- 13


def brute_audit(rows, least):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    n, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        terms = word.findall((text or "").translate(LOW))
        groups.add((lang or "", source or ""))
        n.update(((lang or "", source or ""), t) for t in terms)
        docs.update((lang or "", t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (g, t), c in docs.items() if g == lang and c >= least)
        own = [g for g in groups if g[0] == lang]
        share = lambda count, total: 1 + 10**9 * (count + 2) // (total + 2 * len(kept))
        total = {g: sum(n[g, t] for t in kept) for g in own}
        p = {g: [share(n[g, t], total[g]) for t in kept] for g in own}
        q = [share(sum(n[g, t] for g in own), sum(total.values())) for t in kept]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in own:
            pairs = sorted((-sum(map(f, p[g], p[h])), h[1]) for h in own if h != g)
            terms = sorted((-f(a, b), t.encode(), t) for a, b, t in zip(p[g], q, kept) if n[g, t] and a > b)[:10]
            out |= {(*g, "pair", h, -v, i) for i, (v, h) in enumerate(pairs, 1)} | {(*g, "term", t, -v, i) for i, (v, _, t) in enumerate(terms, 1)}
    return out


@pytest.mark.parametrize(("least", "block", "together"), [(10, 1 << 17, 4 << 20), (1, 50, 2000), (10**6, 1, 1)])
def test_divergences_equal_brute_force(docs, monkeypatch, least, block, together):
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", block)
    monkeypatch.setattr(divergence, "TOGETHER", together)
    found = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, least).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_audit(ROWS, least)


def test_audit_of_nothing(none):
    assert divergence.audit(none).isEmpty()


def test_slices_that_share_a_hash_are_told_apart():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(500)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends = divergence.boundaries(data, np.array([0, data.size]))
    raw = data.tobytes()
    for digest in (lambda b: len(b) % 2, lambda b: 7, divergence.xxhash.xxh3_64_intdigest):
        first, kind = divergence.group_slices(data, starts, ends, digest)
        assert [raw[starts[first[k]] : ends[first[k]]] for k in kind] == words
        assert len(first) >= len(set(words)) and len(set(kind.tolist())) == len(set(words))


def test_counts_are_merged_within_bounds(docs, monkeypatch):
    want = {tuple(r) for r in divergence.term_counts(docs).collect()}
    monkeypatch.setattr(divergence, "MERGE_ROWS", 20)
    monkeypatch.setattr(divergence, "MOST_ROWS", 10)
    monkeypatch.setattr(divergence, "TOGETHER", 300)
    assert {tuple(r) for r in divergence.term_counts(docs).collect()} == want


def test_shares_beyond_64_bits():
    counts, total = np.array([0, 5, 9 * 10**14]), np.array([10**15, 7 * 10**14, 10**15])
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(counts, total)]


def test_queries_are_registered():
    assert {"op11_importance_resample", "op12_sanitise", "op13_source_divergence"} <= set(queries.queries())
