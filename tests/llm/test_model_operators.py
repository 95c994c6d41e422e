"""Packing, language identification, page text, neighbours, near duplicates,
mixing and the pipeline on small tables with the awkward rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, cls string, arrival string"


@pytest.fixture(scope="module")
def ready(spark):
    from tagwright.llm.queries import prepare

    prepare(spark)
    return spark


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 0, 0.5, "x", "y") for i, t, lang, src in rows], SCHEMA)


def plain(spark, texts):
    return table(spark, [(i, t, "en", "s") for i, t in texts])


# --- packing ---------------------------------------------------------------


def test_byte_ids_equal_the_library():
    from tokenizers import Tokenizer

    from tagwright.llm.pieces import ByteIds, tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(4)
    parts = ["a", "B", "é", " ", "  ", "\n", " \n", "\t", "'s", "12", "!", "<|endoftext|>", "日", "\x1c", "_", "\r"]
    for segment in (100_000, 20):
        ids = ByteIds(tokenizer_path("byte_bpe_50k.tiktoken"), segment=segment)
        for _ in range(800):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
            assert ids.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    blank = " " * 400_000 + "a"
    assert ids.ids(blank).tolist() == library.encode(blank, add_special_tokens=False).ids


def test_pieces_hold_every_id_once(ready):
    from tagwright.llm.packing import packing_query
    from tagwright.llm.pieces import byte_ids, tokenizer_path

    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdef \n") for _ in range(rng.randint(0, 9_000)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "x" * 9_000), (7, "again"), (7, "again"), (None, "no id")]
    out = packing_query(plain(ready, rows)).collect()
    ids = byte_ids(tokenizer_path("byte_bpe_50k.tiktoken"))
    want = Counter()
    for i, t in rows:
        seq = np.append(ids.ids(t or ""), 1).astype("<u4")
        want[i, len(seq)] += len(seq)
        assert any(
            r["doc_id"] == i and r["start"] == 0 and r["ids_crc32"] == zlib.crc32(seq[: r["length"]].tobytes()) for r in out
        )
    got = Counter()
    windows = defaultdict(list)
    for r in out:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing_query(plain(ready, rows).limit(0)).collect() == []


def test_sum_of_squares_choice_is_the_smallest():
    from tagwright.llm.packing import SumOfSquares, pack_lengths

    rng = random.Random(11)
    size = 12
    packer = SumOfSquares(size)
    levels = Counter()
    for _ in range(500):
        s = rng.randint(1, size)
        options = {}
        for h in [0, *[x for x in levels if levels[x] and x + s <= size]]:
            after = levels.copy()
            if h:
                after[h] -= 1
            if h + s < size:
                after[h + s] += 1
            options[h] = sum(n * n for n in after.values())
        _, level = packer.place(s)
        assert options[level] == min(options.values())
        if level:
            levels[level] -= 1
        if level + s < size:
            levels[level + s] += 1
    lengths = np.array([rng.randint(1, 2048) for _ in range(3000)])
    window, offset = pack_lengths(lengths, 2048)
    fill = np.bincount(window, weights=lengths)
    # uniform lengths waste about sqrt(n) windows' worth; first fit, which may look at every open window, is the yardstick
    first_fit: list[int] = []
    for s in lengths.tolist():
        k = next((k for k, room in enumerate(first_fit) if room >= s), None)
        if k is None:
            first_fit.append(2048 - s)
        else:
            first_fit[k] -= s
    assert fill.max() <= 2048 and len(fill) <= len(first_fit)


# --- language --------------------------------------------------------------


def brute_bits(rows, langs, text):
    counts = defaultdict(Counter)
    for t, lang in rows:
        b = b"\0\0\0" + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                counts[lang, b[i - k : i]][b[i]] += 1
    out = []
    for lang in langs:
        b, total = b"\0\0\0" + text.encode(), 0.0
        for i in range(3, len(b)):
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    total += 8
                    break
                c = counts.get((lang, b[i - k : i]))
                if c is None:
                    continue
                n, q = sum(c.values()), len(c)
                if b[i] in c:
                    total -= math.log2(c[b[i]] / (n + q))
                    break
                total -= math.log2(q / (n + q))
        out.append(total)
    return out


LEARN = [
    ("the cat sat on the mat and the dog", "en"), ("there is nothing in the house", "en"), ("der hund und die katze", "de"),
    ("das haus ist groß und schön", "de"), ("", "de"), ("le chat est sur la table", "fr"),
]


def test_code_lengths_match_brute_force(ready):
    from tagwright.llm.language_id import fit

    trees = fit(ready.createDataFrame(LEARN, "text string, lang string"))
    trees.prepare()
    texts = ["", "a", "the house", "Hello wörld 日本", "\x00\x01the", LEARN[3][0] * 3]
    want = np.array([brute_bits(LEARN, trees.langs, t) for t in texts])
    assert trees.langs == ["de", "en", "fr"]
    assert np.abs(trees.lengths(texts) - want).max() < 1e-3


def test_language_query(ready):
    from tagwright.llm.language_id import language_id_query

    docs = ready.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r for r in language_id_query(docs).collect()}
    for r in docs.select("doc_id", "lang").collect():
        assert out[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [(r["lang"], out[r["doc_id"]]["lang_pred"]) for r in docs.collect() if out[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    odd = [(None, "the cat", "en", "s"), (1, None, "en", "s"), (2, "", None, "s"), (3, "12 !?", "en", "s"), (4, "the " * 40_000, "en", "s")]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id_query(table(ready, odd)).collect()]
    assert (1, "und", 0.0) in got and (2, "und", 0.0) in got and (3, "und", 0.0) in got and (4, "en", 1.0) in got
    assert language_id_query(table(ready, odd).limit(0)).collect() == []
    unlearned = table(ready, [(1, "words", None, "s")])
    assert [r["lang_pred"] for r in language_id_query(unlearned).collect()] == ["und"]


# --- page text -------------------------------------------------------------


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    from tagwright.llm import html_text

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(3)
    for bits in (1 << 26, 8):
        monkeypatch.setattr(html_text, "_TABLE_BITS", bits)
        for _ in range(400):
            a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
            shared = sorted(html_text.shared_lines(a, b))
            rest = iter(b)
            assert len(shared) == length(a, b) and all(any(a[i] == y for y in rest) for i in shared)


def test_reading_of_markup():
    from tagwright.llm.html_text import read_lines

    page = (
        "<head><title>t</title></head><nav><ul><li>menu<li>more</ul></nav><!-- no --><div class='ad'>buy</div>"
        "<script>var a='</p>';</script><article><header><h1>T &amp; x</h1></header><p>a<b>b</b> c<br>d<p>e\n f"
        "<div class='share-box'>s</div><section id=comments><p>no</p></section><aside>side</aside>"
        "<form><p>mail</p></form><ul><li>one<li>two</ul></article><footer>f</footer>"
    )
    assert [t for t, kind in read_lines(page) if kind == 1] == ["T & x", "ab c d", "e f", "one", "two"]
    assert read_lines("") == []
    assert read_lines("3 < 4 <unclosed") == [("3 < 4 <unclosed", 0)]


def test_pages_without_article_are_differenced(ready):
    from tagwright.llm.html_text import html_text_query

    def page(k):
        own = "".join(f"<div>own {k} line {j}</div>" for j in range(6))
        return f"<div>Home News</div>{own}<div>All rights of this site</div>"

    rows = [(k, f"http://h.example/a/{k}", page(k)) for k in range(5)]
    rows += [(10, None, None), (11, "", ""), (12, "http://alone.example/", "<p>only page"), (13, "http://h.example/a/1", page(1))]
    rows += [(14, "http://g.example/x", f"<article><p>{'long ' * 30_000}</p></article>")]
    df = ready.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, path string")
    out = {r["page_id"]: r["text"] for r in html_text_query(df).collect()}
    for k in (0, 1, 2, 3, 4, 13):
        own = 1 if k == 13 else k
        assert out[k] == "\n".join(f"own {own} line {j}" for j in range(6))
    assert out[10] == out[11] == "" and out[12] == "only page" and out[14] == ("long " * 30_000).strip()
    assert html_text_query(df.limit(0)).collect() == []


def test_article_text_is_the_documents_text(ready):
    from tagwright.llm.html_text import html_text_query

    pages = ready.read.parquet(f"{SF}/pages.parquet")
    docs = {r["doc_id"]: r["text"] for r in ready.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for r in html_text_query(pages).collect():
        number = "".join(c for c in r["url"].split("example.")[1].split("?")[0].split("#")[0] if c.isdigit())
        text = docs.get(int(number))
        if text:
            lines = [" ".join(x.split()) for x in text.split("\n") if x.strip()]
            assert r["text"].split("\n")[1:] == lines and r["n_chars"] == len(r["text"])
            seen += 1
    assert seen > 10


# --- neighbours ------------------------------------------------------------


def brute_nearest(rows, q, n):
    vectors = {i: np.array(v, dtype=float) for i, v in rows}
    scores = sorted(((-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q))
    return [i for _, i in scores[:n]]


def test_recall_and_scores(ready):
    from tagwright.llm.nearest import nearest_query

    table = ready.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    vectors = {i: np.array(v, dtype=float) for i, v in rows}
    got = defaultdict(list)
    for r in nearest_query(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
        assert abs(r["score"] - float((vectors[r["query_id"]] * vectors[r["vec_id"]]).sum())) < 1e-12
    assert set(got) == {i for i, _ in rows if i % 20 == 0} and all(len(v) == 20 for v in got.values())
    hits = sum(len(set(v) & set(brute_nearest(rows, q, 20))) for q, v in got.items())
    assert hits >= 0.9 * 20 * len(got)


def test_unequal_norms_ties_and_unusable_vectors(ready):
    from tagwright.llm.nearest import nearest_query

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 5)]) for i in range(60)]
    rows += [(60 + i, rows[5][1]) for i in range(20)]
    odd = [(100, None), (120, [0.0] * 6), (140, [None] * 6), (160, [float("nan")] * 6), (180, [float("inf")] + [0.0] * 5), (200, [1.0, 2.0])]
    df = ready.createDataFrame([(i, v, 0, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, label int, key string")
    got = defaultdict(list)
    for r in nearest_query(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {0, 20, 40, 60}
    hits = sum(len(set(v) & set(brute_nearest(rows, q, 20))) for q, v in got.items())
    assert hits >= 0.9 * 80
    for v in got.values():
        copies = [x for x in v if x == 5 or 60 <= x < 80]
        assert copies == sorted(copies)
    few = ready.createDataFrame([(i, v) for i, v in rows[:5]], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in nearest_query(few).orderBy("rank").collect()] == brute_nearest(rows[:5], 0, 20)
    assert nearest_query(df.limit(0)).collect() == []


# --- near duplicates -------------------------------------------------------


def brute_groups(rows):
    from tagwright.llm.order_minhash import text_words

    def labelled(words):
        k = min(5, len(words))
        seen, out = Counter(), []
        for i in range(len(words) - k + 1 if words else 0):
            g = tuple(words[i : i + k])
            out.append((g, seen[g]))
            seen[g] += 1
        return out

    def similar(a, b):
        at = {g: j for j, g in enumerate(b)}
        tails = []
        for g in a:
            if g in at:
                p = at[g]
                k = next((i for i, t in enumerate(tails) if t >= p), len(tails))
                tails[k : k + 1] = [p]
        return len(tails) / (len(a) + len(b) - len(tails)) >= 0.8

    seqs = [(i, labelled(text_words(t or ""))) for i, t in rows]
    root = list(range(len(seqs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(seqs)):
        for y in range(x):
            if seqs[x][1] and seqs[y][1] and find(x) != find(y) and similar(seqs[x][1], seqs[y][1]):
                root[find(x)] = find(y)
    group = defaultdict(list)
    for x, (i, _) in enumerate(seqs):
        group[find(x)].append(i)
    return [(i, min(group[find(x)])) for x, (i, _) in enumerate(seqs)]


def near_rows():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(40)]
    rows = []
    for base in range(12):
        words = [word() for _ in range(rng.choice([4, 8, 20, 60, 200]))]
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    for _ in range(20):
        rows.append((len(rows), " ".join([word() for _ in range(30)] + passage)))
    rows += [(len(rows) + k, "One two, three") for k in range(3)]
    rows += [(900, None), (901, ""), (902, "!!! ..."), (903, "!!! ..."), (904, "yes " * 3_000), (905, "yes " * 3_001)]
    return rows


def test_groups_match_brute_force(ready):
    from tagwright.llm.order_minhash import near_duplicates_query

    rows = near_rows()
    got = {r["doc_id"]: r for r in near_duplicates_query(plain(ready, rows)).collect()}
    assert {i: r["group_id"] for i, r in got.items()} == dict(brute_groups(rows))
    assert got[902]["class_id"] == 902 and got[903]["group_id"] == 903
    assert near_duplicates_query(plain(ready, rows).limit(0)).collect() == []


def test_one_of_each_group_stays(ready):
    from tagwright.llm.order_minhash import keep_one

    rows = [*near_rows(), (3, near_rows()[3][1]), (3, near_rows()[3][1]), (None, "one two three"), (902, "!!! ...")]
    docs = plain(ready, rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    roots = {g for i, g in brute_groups([r for r in rows if r[0] is not None])}
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert set(ids) == roots | {None} and ids[902] == 2 and all(n == 1 for i, n in ids.items() if i != 902)


def test_groups_that_only_blocks_can_join(ready):
    """A chain of texts, each similar to the next only: leaders alone cannot join it."""
    from tagwright.llm.order_minhash import near_duplicates

    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(30):
        rows.append((k, " ".join(words)))
        for j in range(2):
            words[(7 * k + 150 * j) % 300] = f"x{k}{j}"
    groups = near_duplicates(plain(ready, rows), leader_rounds=1)
    assert {r["group_id"] for r in groups.collect()} == set(dict(brute_groups(rows)).values())


# --- mixing ----------------------------------------------------------------


def test_schedule_stays_within_a_block():
    from tagwright.llm.mixing import schedule, whole_slots

    slots = whole_slots({"a": 5.0, "b": 3.0, "c": 1.0, "d": 0.001}, 64)
    assert sum(slots.values()) == 64 and min(slots.values()) == 1
    done = Counter()
    for k, j, t, release, deadline in schedule(slots):
        assert release <= t < deadline and j == done[k]
        done[k] += 1
        assert all(abs(done[s] - (t + 1) * slots[s] / 64) < 1 for s in slots)
    assert done == slots
    with pytest.raises(ValueError):
        whole_slots({str(i): 1.0 for i in range(9)}, 8)


def test_mix_keeps_all_rows_near_their_weights(ready):
    from tagwright.llm.mixing import mix, mixing_query

    rng = random.Random(8)
    rows = [(i, "t", "en", rng.choice(["a"] * 6 + ["b", "b", None])) for i in range(3_000)]
    rows += [(None, "t", "en", "a"), (None, "t", "en", "a"), (5, "t", "en", "b"), (5, "t", "en", "b")]
    docs = table(ready, rows)
    weights = {"a": 0.5, "b": 0.25, None: 0.25}
    out = mix(docs, weights, block_rows=4, period=64).orderBy("mix_position").collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((i, s) for i, _, _, s in rows)
    assert len({r["mix_position"] for r in out}) == len(rows)
    limit = min(Counter(s for *_, s in rows)[s] / w for s, w in weights.items())  # until a source runs out
    seen = Counter()
    for n, r in enumerate(out[: int(limit) - 8], 1):
        seen[r["source"]] += 1
        if n % 4 == 0:
            assert all(abs(seen[s] - w * n) < 4 + 1e-9 for s, w in weights.items())
    for r in out:
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
    assert mixing_query(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mix(docs, {"a": 1.0})


# --- pipeline --------------------------------------------------------------


def test_pipeline_stages(ready):
    import corpus_pipeline

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in ready.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(9_000, None, "en", "s"), (9_001, "", None, None), (9_002, "123 456", "en", "src0")]
    docs = table(ready, rows)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(ready, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
        docs = corpus_pipeline.cut_lineage(out)
        counts.append(docs.count())
    kept = {r[0] for r in rows} - {9_000, 9_001, 9_002}
    assert counts[0] == len(kept) and counts[1] == counts[0] and counts[2] == counts[3] < counts[1]
    assert docs.select("doc_id").distinct().count() == counts[3]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_on_an_empty_table(ready):
    import corpus_pipeline

    docs = table(ready, [(1, "a", "en", "s")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(ready, docs, SF))
    assert docs.count() == 0
