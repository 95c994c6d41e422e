"""Cross-tokenizer alignment, toxicity and ranked search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n long, id string, pair string, score double, item string"


@pytest.fixture(scope="module")
def ready(spark):
    from tagwright.llm.queries import prepare

    prepare(spark)
    return spark


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 0.5, "z") for i, t in rows], SCHEMA)


# --- cross-tokenizer alignment ---------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    from tagwright.llm.pieces import tokenizer_path

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def byte_alphabet():
    """Bytes of the characters of byte-level entries."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_align(libraries, text):
    """Ids with byte ranges of both, by whole-text encoding; None without tokens."""
    a, b = libraries
    if not text:
        return None
    data = (" " + text).encode()
    alphabet = byte_alphabet()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)
    a_parts = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in a_ids]
    b_parts = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_parts) != data or b"".join(b_parts) != data:
        return None

    def ranges(ids, parts):
        at, out = 0, []
        for i, p in zip(ids, parts):
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    return ranges(a_ids, a_parts), ranges(b_ids, b_parts)


def brute_documents(libraries, rows):
    aligned = [brute_align(libraries, t) for _, t in rows]
    links = []
    for x in aligned:
        links.append([(i, j) for i, s, e in x[0] for j, u, v in x[1] if s < v and u < e] if x else [])
    counts = Counter(p for own in links for p in set(own))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for (doc_id, _), x, own in zip(rows, aligned, links):
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for *_, e in x[0]} & {e for *_, e in x[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in x))
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        n_best = sum(counts[p] == best[p[0]] for p in own)
        out.append((doc_id, len(x[0]), len(x[1]), len(groups), len(own), n_best, sum(counts[p] for p in own), digest))
    return sorted(out, key=str), counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    rng = random.Random(5)
    parts = ["the", "Word", "é", "日本", " ", "  ", "\n", " \n ", "\t", "'s", "12", "!", "<|endoftext|>", "<s>", "\x00", "\xa0", "🙂", "naïve", "<0x0A>", "."]
    fixed = [None, "", " ", "a", "a ", " a", "a  b", "\n", "x▁y", "ﬁ ①", "\x1c a", "ab " * 50, "日" * 300, "same text", "same text", " " * 40 + "z"]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(150)]


def test_alignment_matches_brute_force(ready, libraries):
    from tagwright.llm.tokenizer_align import align_tokenizers, tokenizer_align_query
    from tagwright.llm.pieces import tokenizer_path

    rows = [(i if i != 7 else None, t) for i, t in enumerate(odd_texts())] + [(3, "repeated id")]
    expected, counts = brute_documents(libraries, rows)
    docs = table(ready, rows)
    got = tokenizer_align_query(docs).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected
    files = (tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))
    out, pairs = align_tokenizers(docs, *files, pairs_per_block=400, pairs_per_bucket=50)  # many buckets in many blocks
    assert sorted(map(tuple, out.select(*COLUMNS).collect()), key=str) == expected
    assert {(r["a"], r["b"]): r["n_docs"] for r in pairs.collect()} == dict(counts)


def test_alignment_of_a_very_long_text(ready, libraries):
    from tagwright.llm.tokenizer_align import aligner
    from tagwright.llm.pieces import tokenizer_path

    text = ("some words of a long text, " * 4000) + "日本語" * 20_000 + " " * 30_000 + "end"
    own = aligner(tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))
    (parts,) = own.documents([text], True)
    a, b = libraries
    assert sum(p[1] for p in parts) == len(a.encode(" " + text, add_special_tokens=False).ids)
    assert sum(p[2] for p in parts) == len(b.encode(text))
    blank = " " * 300_000 + "x"
    assert sum(p[1] for p in next(own.documents([blank], False))) == len(a.encode(" " + blank, add_special_tokens=False).ids)


def test_alignment_of_an_empty_table(ready):
    from tagwright.llm.tokenizer_align import tokenizer_align_query

    assert tokenizer_align_query(table(ready, [])).count() == 0
    assert [tuple(r) for r in tokenizer_align_query(table(ready, [(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_perfect_hash_numbers_keys_and_rejects_others():
    from tagwright.llm.tokenizer_align import PairTable, build_hash

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 31, 20_000).astype(np.uint32))
    rows = []
    for bucket in range(7):
        own = keys[(keys >> 16) % 7 == bucket]
        sizes, bits, ordered = build_hash(own)
        rows.append((bucket, len(own), sizes, np.packbits(bits).tobytes(), ordered.astype("<u4").tobytes()))
    pairs = PairTable(7, rows)
    at = pairs.numbers(keys)[1]
    assert sorted(at.tolist()) == list(range(len(keys)))
    strange = np.setdiff1d(rng.integers(0, 1 << 31, 500).astype(np.uint32), keys)
    for k in strange[:50]:
        with pytest.raises(ValueError):
            pairs.numbers(np.array([k], np.uint32))
    part = PairTable(7, rows[2:4])
    own, _ = part.numbers(np.concatenate([keys, strange[(strange >> 16) % 7 == 0]]))
    assert set(((keys[own] >> 16) % 7).tolist()) == {2, 3}


def test_vectors_are_summed_up_a_tree(ready):
    from tagwright.llm.common import cut_lineage, tree_sum

    rng = np.random.default_rng(1)
    rows = [(b, p, rng.integers(0, 99, 10).astype("<i8")) for b in range(3) for p in range(0, 2500, 1 + b)]
    frame = cut_lineage(ready.createDataFrame([(b, p, v.tobytes()) for b, p, v in rows], "bucket long, part long, vector binary"))
    got = {r["bucket"]: np.frombuffer(r["vector"], "<i8").tolist() for r in tree_sum(frame, "<i8", 2500).collect()}
    assert got == {b: sum(v for x, _, v in rows if x == b).tolist() for b in range(3)}


# --- toxicity ----------------------------------------------------------------------


def test_gradient_is_that_of_the_noisy_or_likelihood():
    import pandas as pd

    from tagwright.llm.toxicity import likelihood

    rng = np.random.default_rng(2)
    bags = []
    for toxic in (0, 1, 1, 0, 1):
        sizes = rng.integers(1, 4, rng.integers(0, 4))
        bags.append((toxic, int(rng.integers(1, 5)), [rng.choice(6, n, replace=False) for n in sizes]))
    frame = pd.DataFrame(
        [(y, n, np.array([len(x) for x in s], "<u4").tobytes(), np.concatenate([*s, []]).astype("<u2").tobytes()) for y, n, s in bags],
        columns=["toxic", "n_plain", "sizes", "at"],
    )
    w = rng.normal(size=7)

    def chances(w):
        out = []
        for _, plain, own in bags:
            z = [w[-1]] * plain + [w[-1] + sum(w[i] for i in s) for s in own]
            out.append(1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z))
        return np.array(out)

    def loss(w):
        return -sum(math.log(p if b[0] else 1 - p) for p, b in zip(chances(w), bags))

    got = likelihood(w, frame)
    assert math.isclose(got[0], loss(w), rel_tol=1e-9)
    steps = np.eye(7) * 1e-5
    slopes = np.array([(chances(w + s) - chances(w - s)) / 2e-5 for s in steps])
    p = chances(w)
    for i in range(7):
        assert math.isclose(got[1 + i], (loss(w + steps[i]) - loss(w - steps[i])) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)
    assert np.allclose(got[8:].reshape(7, 7), (slopes / (p * (1 - p))) @ slopes.T, rtol=1e-4)


def toxic_rows(n=900):
    rng = random.Random(8)
    names = ["".join(rng.choice("aeioklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        said = [" ".join(rng.choice(names) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 12))]
        toxic = rng.random() < 0.25
        if toxic:
            k = rng.randrange(len(said))
            said[k] += " " + rng.choice(["grumblefoot", "Snotgoblin", "wretchling"])
        rows.append((i, ". ".join(said) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_sentences_are_found_from_document_labels(ready):
    from tagwright.llm.toxicity import toxicity_query

    rows, labels = toxic_rows()
    truth = {i: t for i, _, t in labels}
    rows += [(None, "nobody. wretchling"), (5000, None), (5001, ""), (5002, "... 12!"), (5003, "x" * 300_000), (5003, "SNOTGOBLIN")]
    labels = [(i, q, t) for i, q, t in labels if i % 3 or t] + [(3, 1, None), (None, 0, 1), (99_999, 0, 1), (1, 1, 0)]
    docs = table(ready, rows)
    out = toxicity_query(docs, ready.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = out.collect()
    assert len(got) == len(rows)
    texts = dict(rows[:900])
    for r in got:
        if r["doc_id"] in truth:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
            assert r["predicted"] == truth[r["doc_id"]], r
            offending = [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["offending"]]
            assert len(offending) == truth[r["doc_id"]]
            assert all(re.search("grumblefoot|Snotgoblin|wretchling", s) for s in offending)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 5003}
    assert by_id[5000]["score"] == by_id[5001]["score"] == by_id[5002]["score"] == 0.0
    assert by_id[None]["predicted"] == 1
    assert sorted(r["predicted"] for r in got if r["doc_id"] == 5003) == [0, 1]  # upper case is the same word


def test_held_out_documents_of_the_given_table(ready):
    from tagwright.llm.toxicity import toxicity_query

    docs, labels = (ready.read.parquet(f"{SF_LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity_query(docs, labels).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    pos = [r["score"] for r in rows if r["toxic"] == 1]
    neg = [r["score"] for r in rows if r["toxic"] == 0]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert auc >= 0.9
    assert sum(q >= 0.7 for q in neg) <= 0.02 * len(neg)


def test_toxicity_without_labels_or_documents(ready):
    from tagwright.llm.toxicity import toxicity_query

    none = ready.createDataFrame([], "doc_id long, toxic int")
    docs = table(ready, [(1, "some words"), (2, None)])
    assert [(r["score"], r["predicted"]) for r in toxicity_query(docs, none).collect()] == [(0.0, 0)] * 2
    one = ready.createDataFrame([(i, i % 1) for i in range(40)], "doc_id long, toxic int")
    only_clean = toxicity_query(table(ready, [(i, f"text number {i}. more") for i in range(40)]), one).collect()
    assert all(r["predicted"] == 0 for r in only_clean)
    assert toxicity_query(table(ready, []), one).count() == 0


def test_unfinished_fit_raises():
    from tagwright.llm.toxicity import fisher_scoring

    def bowl(w, information):
        return float((w**4).sum()), 4 * w**3, np.diag(12 * w**2 + 1e-9)

    assert np.abs(fisher_scoring(bowl, np.ones(3), 1e-9, 100)).max() < 0.02
    with pytest.raises(RuntimeError):
        fisher_scoring(bowl, np.ones(3), 1e-12, 2)


# --- ranked search -------------------------------------------------------------------


def brute_search(rows, items, top=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if t else []

    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        q = terms(text)
        scored = []
        for doc_id, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in q)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, r, d, -s) for r, (s, _, d) in enumerate(scored[:top], 1)]
    return out


def search_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["É", "é", "ñandú", "ÀB", "ab", "日本", "x_y", "q" * 200]
    weights = [1 / (1 + i) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 60, 400])))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "-- !"), (1003, "w1 " * 5000 + "w7"), (1004, "Ab aB, AB"), (None, "w5 w6 ab"), (7, "w5 w6 ab"), (8, "w5 w6 ab")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 15, 60])))) for i in range(30)]
    items += [(100, None), (101, "?!"), (102, "nowhere"), (103, "W1 w1 w1 nowhere"), (104, "w5 w6 ab"), (104, "w5 w6 ab"), (None, "É 日本")]
    return rows, items


def test_search_matches_brute_force(ready):
    from tagwright.llm.lexical_search import search

    rows, items = search_rows()
    expected = sorted(brute_search(rows, dict.fromkeys(items)), key=str)
    docs = table(ready, rows).repartition(5)
    queries = ready.createDataFrame([(i, t, 0.5) for i, t in items], "item_id long, text string, score double")
    for size in (1 << 20, 300):  # one block of items, then many
        got = search(docs, queries, item_bytes=size).select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(map(tuple, got), key=str) == expected
    assert search(docs, queries, top=3, seeds=1).count() == len(brute_search(rows, dict.fromkeys(items), 3))


def test_sketches_bound_every_score():
    from tagwright.llm.lexical_search import LEVELS, Items, sketch, terms_of

    rows, items = search_rows()
    docs = [t for _, t in rows if terms_of(t)]
    block = Items([t for _, t in items if terms_of(t)])
    counts = [Counter(terms_of(t)) for t in docs]
    total = sum(sum(c.values()) for c in counts)
    block.weigh(len(docs), total, np.array([sum(t in c for c in counts) for t in block.terms]))
    ns = np.array([sum(c.values()) for c in counts])
    bounds = block.bounds(ns, [sketch(c) for c in counts])
    exact = np.array([block.score(int(n), t) for n, t in zip(ns, docs)])
    assert (bounds >= exact).all()
    assert (bounds == exact).mean() > 0.5  # and mostly tightly
    assert (np.diff(LEVELS) > 0).all() and len(LEVELS) == 256


def test_search_of_empty_tables(ready):
    from tagwright.llm.lexical_search import lexical_search_query

    none = ready.createDataFrame([], "item_id long, text string")
    some = ready.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search_query(table(ready, [(1, "a")]), none).count() == 0
    assert lexical_search_query(table(ready, []), some).count() == 0
    assert lexical_search_query(table(ready, [(1, None)]), some).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_oracle(ready, duck):
    from tagwright.llm.lexical_search import LEXICAL_SEARCH_SQL
    from tagwright.llm.queries import QUERIES

    got = QUERIES["op13_lexical_search"](ready, SF).collect()
    expected = duck.execute(LEXICAL_SEARCH_SQL).fetchall()
    assert len(expected) > 100
    assert sorted(map(tuple, got)) == sorted(expected)


def test_padded_address_parts_do_not_end_the_job():
    from tagwright.llm.privacy import base_spans

    text = "0" * 5000 + "1.2.3.4 and " + "0" * 5000 + "256.2.3.4 and " + "9" * 5000 + ".1.1.1"
    assert [(a, b) for a, kind, b in base_spans(text) if kind == 1] == [(0, 5007)]
