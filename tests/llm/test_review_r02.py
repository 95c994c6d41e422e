"""Findings of the second review: whole results where a part was left out."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def ready(spark):
    from tagwright.llm.queries import prepare

    prepare(spark)
    return spark


def test_packing_follows_the_mix_over_files_of_unequal_size(ready):
    import corpus_pipeline
    from tagwright.llm.mixing import mix

    rng = random.Random(31)
    # every document fills a window of its own first, so sequence numbers show the order of arrival
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, text(9_000), "en", "hot") for i in range(400)] + [(1_000 + i, text(2_100), "en", "cold") for i in range(100)]
    docs = ready.createDataFrame(rows, SCHEMA).repartition(4)
    written = corpus_pipeline.cut_lineage(corpus_pipeline.mixing(ready, docs, ""))
    assert len(written.inputFiles()) > 1
    packed = corpus_pipeline.packing(ready, written, "").where("start = 0")
    got = [r["doc_id"] for r in packed.orderBy("sequence_id").collect()]
    want = [r["doc_id"] for r in mix(docs).orderBy("mix_position").collect()]
    assert got == want


def test_weights_hold_at_any_length(ready):
    from tagwright.llm.mixing import mix

    rows = [(i, "t", "en", "abc"[i % 3]) for i in range(15_000)] + [(20_000 + i, "t", "en", "rare") for i in range(3)]
    weights = {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3, "rare": 1e-4}
    out = mix(ready.createDataFrame(rows, SCHEMA), weights, block_rows=1).select("source", "mix_slot").collect()
    total, seen = sum(weights.values()), Counter()
    for n, r in enumerate(sorted(out, key=lambda r: r["mix_slot"])[:14_900], 1):
        assert r["mix_slot"] == n - 1
        seen[r["source"]] += 1
        assert all(abs(seen[s] - w / total * n) < 1 for s, w in weights.items())
    assert len(out) == len(rows)


def test_more_sources_than_slots_of_a_period(ready):
    from tagwright.llm.mixing import mix

    rows = [(i, "t", "en", f"s{i % 4_200}") for i in range(4_300)]
    out = mix(ready.createDataFrame(rows, SCHEMA)).select("doc_id", "mix_slot", "mix_position").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(4_300))
    assert len({r["mix_position"] for r in out}) == 4_300 and len({r["mix_slot"] for r in out}) == 4_200


def test_large_slot_tables_are_joined(ready, monkeypatch):
    from tagwright.llm import mixing

    docs = ready.createDataFrame([(i, "t", "en", "abc"[i % 7 % 3]) for i in range(900)], SCHEMA)
    small = {tuple(r) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert {tuple(r) for r in mixing.mix(docs).collect()} == small


def marked_terms(rows, out):
    text = dict(rows)
    return {
        (r["doc_id"], text[r["doc_id"]][int(a) : int(b)].lower())
        for r in out for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"
    }


def test_terms_of_entities_seen_once_are_marked_over_whole_documents(ready):
    from tagwright.llm.privacy import find_personal_data

    filler = " ".join(f"common{'abcdefgh'[i % 8]}" for i in range(60))
    rows = [(i, f"plain note number {i} {filler}") for i in range(300)]
    rows += [(900, f"write to ann@site.org {filler} axolotl"), (901, f"write to ann@site.org {filler} axolotl")]
    rows += [(910, f"plain bob@site.org {filler} quagga"), (911, f"plain quagga here {filler}"), (912, f"the quagga there {filler}")]
    docs = ready.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA)
    marked = marked_terms(rows, find_personal_data(docs).collect())
    # sixty words from its only mention (900 and 901 are one document), too frequent beside one mention
    assert {(900, "axolotl"), (901, "axolotl")} <= marked
    assert not {t for _, t in marked} & {"quagga", "plain", "commona"}


def test_counts_match_brute_force(ready, monkeypatch):
    import math

    from tagwright.llm import privacy

    rng = random.Random(12)
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "abcde"]
    rows = []
    for i in range(200):
        text = [rng.choice(words[: rng.randint(2, 40)]) for _ in range(12)]
        text[5:5] = [f"{rng.choice('klm')}@x.org" for _ in range(rng.randint(0, 2))] if i % 3 else []
        rows += [(len(rows) + j, " ".join(text)) for j in range(rng.choice([1, 1, 3]))]
    texts = {t: (set(privacy._TERM.findall(" ".join(w for w in t.split() if "@" not in w))), {w for w in t.split() if "@" in w}) for _, t in rows}
    p = lambda keep: sum(1 for v in texts.values() if keep(*v)) / len(texts)
    want = set()
    alpha = 0.2
    for e in ("k@x.org", "l@x.org", "m@x.org"):
        pe = p(lambda _, es: e in es)
        for w in words:
            both, n = (len(texts) * p(lambda ts, es: w in ts and (e in es or not x)) for x in (1, 0))
            if n and both and math.log2((both + 0.5 * pe) / (n + 0.5) / pe) >= -alpha * math.log2(pe):
                want |= {(i, w) for i, t in rows if e in texts[t][1] and w in texts[t][0]}
    assert want
    docs = ready.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA)
    for share in (1_000, 10):  # all terms frequent, few of them
        monkeypatch.setattr(privacy, "HOT_SHARE", share)
        assert marked_terms(rows, privacy.find_personal_data(docs, alpha=alpha).collect()) == want


def test_disclosing_terms_are_marked_without_their_entity(ready, monkeypatch):
    from tagwright.llm import privacy

    rows = [(i, f"note {i % 7} the visitor zebrafish wrote from kim@site.org on day {i} again") for i in range(6)]
    rows += [(100 + i, f"the visitor wrote on day {i} again") for i in range(60)] + [(202, "a zebrafish"), (203, "a zebrafish"), (204, None)]
    docs = ready.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA)
    for share in (1_000, 2):  # frequent and rare terms
        monkeypatch.setattr(privacy, "HOT_SHARE", share)
        out = {r["doc_id"]: r["spans"] for r in privacy.privacy_query(docs).collect()}
        assert out[202] == out[203] == "term:2:11" and out[100] == out[204] == ""
        masked = {r["doc_id"]: r["sanitised"] for r in privacy.find_personal_data(docs, everywhere=True).collect()}
        assert masked[202] == masked[203] == "a <TERM>" and masked[100] is None and "zebrafish" not in masked[0]


def test_teaser_articles_do_not_hide_the_text(ready):
    from tagwright.llm.html_text import html_text_query

    def page(k):
        own = "".join(f"<div>long own paragraph {k} line {j} of the text</div>" for j in range(6))
        return f"<div>Home News</div>{own}<article><h2>Read {k} next</h2></article><div>All rights of this site</div>"

    rows = [(k, f"http://h.example/a/{k}", page(k), "x", "y") for k in range(5)]
    df = ready.createDataFrame(rows, "page_id long, url string, html string, host string, path string")
    for r in html_text_query(df).collect():
        k = r["page_id"]
        assert r["text"].split("\n") == [f"long own paragraph {k} line {j} of the text" for j in range(6)] + [f"Read {k} next"]


def test_pruned_nodes_still_count_for_shorter_contexts(ready):
    import numpy as np

    from tagwright.llm.language_id import fit

    rng = random.Random(6)
    learn = [("".join(rng.choice(letters) for _ in range(400)), lang) for lang, letters in (("a", "abcd efg"), ("b", "hijklmnop")) for _ in range(6)]
    learn += [("xyz " * 10, "rare")]
    rows = ready.createDataFrame(learn, "text string, lang string")
    full, cut = fit(rows), fit(rows, max_nodes=200)
    assert len(cut.n3) < len(full.n3)
    for name in ("one", "n2", "two", "escape2"):
        assert np.array_equal(getattr(full, name), getattr(cut, name)), name
    # every language keeps nodes of its own
    cut.prepare()
    assert np.isfinite(cut.three[1:]).all() and cut.lengths(["xyz xyz", "abcd", "hijk"]).argmin(axis=1).tolist() == [2, 0, 1]
