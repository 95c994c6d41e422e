"""Line deduplication, quality rules, personal data and token counts against
plain Python on small tables with the awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, id string, words string"


@pytest.fixture(scope="module")
def ready(spark):
    from tagwright.llm.queries import prepare

    prepare(spark)
    return spark


def table(spark, texts, extra="x"):
    """Documents with further columns whose names clash with inner ones."""
    rows = [(i, t, "en", "s", 0, extra, extra, extra) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


SHARED = "this line is shared by very many documents of the corpus"
AWKWARD = [
    (1, None), (2, ""), (3, "\n"), (4, f"{SHARED}\nown line one"), (5, f"  {SHARED.upper()} \nx"),
    (6, f"{SHARED}\n{SHARED}"), (7, f"a\n{SHARED}\t\nb"), (8, f"{SHARED}"), (8, f"{SHARED}\nagain"), (9, "É" * 45),
    (10, "é" * 45), (None, SHARED), (11, "short\nshort"), (12, "w " * 30_000),
]


def brute_lines(rows):
    holders = defaultdict(set)
    keys = {}

    def key(line):
        if line not in keys:
            keys[line] = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))
        return keys[line]

    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [
            x for x in lines if i is None or len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i
        ]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup_matches_brute_force(ready):
    from tagwright.llm.line_dedup import dedup_lines, line_dedup_query

    docs = table(ready, AWKWARD)
    assert Counter(map(tuple, line_dedup_query(docs).collect())) == brute_lines(AWKWARD)
    full = dedup_lines(docs)
    assert set(docs.columns) < set(full.columns) and full.count() == len(AWKWARD)
    assert line_dedup_query(docs.limit(0)).collect() == []


def test_line_dedup_oracle(ready, duck):
    from tagwright.llm.line_dedup import LINE_DEDUP_SQL, line_dedup_query

    docs = ready.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, line_dedup_query(docs).collect())) == sorted(duck.execute(LINE_DEDUP_SQL).fetchall())


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(WS):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_measures_match_brute_force(ready):
    from tagwright.llm.quality_rules import base_measures

    rng = random.Random(5)
    rows = [(i, t) for i, t in AWKWARD if i is not None]
    rows += [(100 + k, "".join(rng.choice(["a ", "b ", "c\n", "#", "é ", "\t", "d e f "]) for _ in range(rng.randint(0, 60)))) for k in range(200)]
    got = Counter(
        (r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        for r in base_measures(table(ready, rows)).collect()
    )
    assert got == Counter((i, *brute_base(t)) for i, t in rows)


def labelled(spark, n=600):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80)]
        bad = i % 6 == 0
        if bad:
            words = [w + "%%%" if rng.random() < 0.8 else w for w in words]
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            marks.append((i, 0 if bad else 1))
    return table(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int"), rows


def test_quality_rules_learn_the_planted_rule(ready):
    from tagwright.llm.quality_rules import quality_rules

    docs, labels, rows = labelled(ready)
    out, found = quality_rules(docs, labels)
    assert found.rules and "symbol_share" in str(found)
    wrong = [r["id"] for r in out.collect() if r["kept"] == (r["id"] % 6 == 0)]
    assert not wrong


def test_quality_rules_without_labels_or_documents(ready):
    from tagwright.llm.quality_rules import quality_rules_query

    docs, labels, _ = labelled(ready, 60)
    nothing = labels.limit(0)
    out = quality_rules_query(docs, nothing).collect()
    assert all(r["kept"] != r["base_failed"] for r in out)
    assert quality_rules_query(docs.limit(0), labels).collect() == []
    one_class = labels.withColumn("quality", F.lit(1))
    assert all(r["kept"] for r in quality_rules_query(docs, one_class).collect())
    short = quality_rules_query(table(ready, [(1, None), (2, "two words")]), labels).collect()
    assert all(r["base_failed"] and not r["kept"] for r in short)


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if k == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if k == 2:
                doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    from tagwright.llm.privacy import base_spans

    rng = random.Random(2)
    parts = [*"1234567890" * 2, *"+@.- ()a_%", "1.2.3.4", "a@b.c", "4111 1111 1111 1111", "+1 555 123-4567", "٣", "0" * 12]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == brute_spans(text), text
    assert base_spans("a" * 300_000 + "@") == []
    assert base_spans("1" * 300_000) == []


def test_disclosing_terms_are_marked_and_masked(ready):
    from tagwright.llm.privacy import find_personal_data, privacy_query

    rows = [(i, f"note {i % 7} the visitor zebrafish wrote from kim@site.org on day number{'abcdefgh'[i]} again") for i in range(6)]
    rows += [(100 + i, f"the visitor wrote on day {i} again and nothing else was there to see") for i in range(60)]
    rows += [(200, None), (201, ""), (202, "zebrafish")]
    out = {r["doc_id"]: r for r in find_personal_data(table(ready, rows)).collect()}
    assert len(out) == len(rows)
    for i in range(6):
        text = rows[i][1]
        spans = out[i]["spans"].split(",")
        marked = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in spans) if k == "term"}
        assert "zebrafish" in marked and "visitor" not in marked
        assert "<EMAIL>" in out[i]["sanitised"] and "zebrafish" not in out[i]["sanitised"]
    assert all(out[i]["spans"] == "" and out[i]["sanitised"] is None for i in (100, 200, 201, 202))
    digest = {r["doc_id"]: r for r in privacy_query(table(ready, rows)).collect()}
    assert digest[200]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    a = rows[0][1].index("kim@")
    assert digest[0]["base_sha256"] == hashlib.sha256(f"email:{a}:{a + 12}".encode()).hexdigest()
    assert privacy_query(table(ready, rows).limit(0)).collect() == []


def test_copies_of_one_passage_are_one_observation(ready):
    from tagwright.llm.privacy import find_personal_data

    rows = [(i, "unusual quokka asked kim@site.org about it") for i in range(9)] + [(50 + i, "plain words here") for i in range(40)]
    assert all("term" not in r["spans"] for r in find_personal_data(table(ready, rows)).collect())


ALPHABET = [
    "a", "B", "é", " ", "  ", "\n", " \n", "\t", "'s", "12", "!", "<|endoftext|>", "<|startoftext|>", "́", "İ", "Σ",
    "日", "​", "\x1c", "'", "\r", "_",
]


def test_token_counts_equal_the_library():
    from tagwright.llm.pieces import WordCounter, tokenizer_path
    from tagwright.llm.token_counts import count_huge

    counter = WordCounter(tokenizer_path("word_bpe_49k.json"), generation=50)
    rng = random.Random(1)
    short = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert [counter.count(t) for t in short] == counter.library(short)
    long = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(100, 600))) for _ in range(300)]
    long += ["x" * 500, "ab " * 200, "y" * 90 + " " + "z" * 200, " " * 300]
    assert [count_huge(t, counter, chunk=40, overlap=6) for t in long] == counter.library(long)


def test_token_counts_query(ready):
    from tagwright.llm.pieces import WordCounter, tokenizer_path
    from tagwright.llm.token_counts import token_counts_query

    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "word " * 20_000), (5, "q" * 70_000), (None, "x")]
    got = Counter(map(tuple, token_counts_query(table(ready, rows)).collect()))
    lib = WordCounter(tokenizer_path("word_bpe_49k.json")).library([t or "" for _, t in rows])
    assert got == Counter((i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, lib))
    assert token_counts_query(table(ready, rows).limit(0)).collect() == []
