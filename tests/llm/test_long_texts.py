"""Long and odd texts: no quadratic work, unchanged results."""

from __future__ import annotations

import random
import time
from collections import Counter

from .test_text_operators import AWKWARD, brute_base, brute_lines, ready, table  # noqa: F401


def test_windows_with_equal_prefixes_are_told_apart(ready, monkeypatch):  # noqa: F811
    from tagwright.llm import quality_rules as qr

    # four hash bits are left, so that nearly every text has clashing windows
    monkeypatch.setattr(qr, "_PREFIX", ~((1 << 60) - 1))
    rng = random.Random(6)
    rows = [(i, t) for i, t in AWKWARD if i is not None and i != 12]
    rows += [(100 + k, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 90)))) for k in range(150)]
    rows.append((900, " ".join(str(rng.randrange(3000)) for _ in range(60_000))))
    began = time.time()
    got = Counter((r["id"], r["n_words"], r["n_repeat_words"]) for r in qr.base_measures(table(ready, rows)).collect())
    assert got == Counter((i, brute_base(t)[0], brute_base(t)[4]) for i, t in rows)
    assert time.time() - began < 60


def test_many_shared_lines_in_few_documents(ready):  # noqa: F811
    from tagwright.llm.line_dedup import line_dedup_query

    lines = [f"shared line number {i} of a text that is copied as a whole" for i in range(30_000)]
    rows = [(i, "\n".join([f"own {i}", *lines, "", f"end {i}"])) for i in range(6)]
    rows += [(7, lines[5]), (7, f"x\n{lines[5]}\n{lines[5]}"), (8, None), (9, "\n")]
    began = time.time()
    got = Counter(map(tuple, line_dedup_query(table(ready, rows)).collect()))
    assert time.time() - began < 60
    assert got == brute_lines(rows)


def test_texts_without_spaces_are_spliced_in_bounded_chunks():
    from tagwright.llm.pieces import WordCounter, tokenizer_path
    from tagwright.llm.token_counts import count_huge

    counter = WordCounter(tokenizer_path("word_bpe_49k.json"))
    longest = 0

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode(self, text, **options):
            nonlocal longest
            longest = max(longest, len(text))
            return self.inner.encode(text, **options)

    rng = random.Random(2)
    kinds = {
        "ideographs": lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)),
        "base64": lambda n: "".join(rng.choice("ABCDEFabcdefghij0123456789+/") for _ in range(n)),
        "letters": lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n)),
        "symbols": lambda n: "".join(rng.choice("./-_='") for _ in range(n)),
        "mixed": lambda n: "".join(
            rng.choice(["a", "if", "(", "=", "'s", "'", "<|endoftext|>", "é", "é", "한", "하", "1", "٣", "ß"])
            for _ in range(n)
        ),
    }
    counter_watched = WordCounter(tokenizer_path("word_bpe_49k.json"))
    counter_watched.tokenizer = Watched(counter_watched.tokenizer)
    for make in kinds.values():
        for chunk, overlap in ((40, 8), (97, 20)):
            texts = [make(rng.randrange(1, 500)) for _ in range(60)]
            assert [count_huge(t, counter, chunk, overlap) for t in texts] == counter.library(texts)
        text = make(150_000)
        longest = 0
        assert count_huge(text, counter_watched, 8192, 512) == counter.library([text])[0]
        assert longest <= 2 * (8192 + 512)
