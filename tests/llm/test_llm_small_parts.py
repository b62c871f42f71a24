"""Parts that need no session: words, winnowing, filters, suffix arrays, the transducer, networks."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from seqframe.llm import common, decontaminate, html_extract, license_scan, minhash, quality_cnn, sais, substring_dedup
from seqframe.llm.bpe import Tokenizer, Transducer, Utf8Machine
from seqframe.llm.cuckoo import CuckooFilter
from seqframe.llm.decontaminate import union, winnow
from seqframe.llm.words import owner, words


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@given(st.lists(st.text("aB9é .\n", max_size=12), max_size=6))
@settings(deadline=None)
def test_words(texts):
    w = words(*packed(texts))
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(fold)) for t in texts]
    got = [w.text(a, b).decode().split(" ") if b > a else [] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == want
    seen = {}
    for word, h in zip((x for t in want for x in t), w.hashes.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 5), max_size=30), st.integers(1, 6))
@settings(deadline=None)
def test_winnow(values, window):
    h = np.array(values, np.uint64)
    kept = set(winnow(h, np.zeros(len(h), np.int64), window).tolist())
    want = set()
    for i in range(len(values) - window + 1):
        part = values[i : i + window]
        want.add(i + max(j for j in range(window) if part[j] == min(part)))
    assert kept == want


def test_union():
    assert union([(3, 5), (0, 2), (4, 9), (2, 3)]) == [0, 9] and union([]) == []


def test_repeated_words_against_repeated_words():
    """One word 20,000 times in text and item: linear, not their product."""

    text = "again " * 20_000
    items = decontaminate.Items([1, 2, 3], [text, "again and " * 3, "again " * 4])
    w = words(*packed([text, "and again " * 5]))
    began = time.process_time()
    hits = list(items.hits(w, owner(w.first)))
    assert time.process_time() - began < 5
    assert {h[2] for h in hits if h[0] < 20_000} == {0, 2} and {h[2] for h in hits if h[0] >= 20_000} == {1}
    assert decontaminate.union([h[:2] for h in hits if h[0] < 20_000]) == [0, 20_000]


def test_cuckoo():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 20000, dtype=np.uint64))
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all() and f.contains(rng.integers(1 << 62, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.002
    f.delete(keys[:10000])
    assert f.contains(keys[10000:]).all() and f.contains(keys[:10000]).mean() < 0.002
    f.insert(keys[:10000])
    assert CuckooFilter.from_bytes(f.to_bytes()).contains(keys).all()
    assert not CuckooFilter.of(keys[:0]).contains(keys[:5]).any()
    small = CuckooFilter(4)
    with pytest.raises(Exception):
        small.insert(keys[:100])


@given(st.lists(st.integers(1, 4), max_size=60), st.booleans())
@settings(max_examples=150, deadline=None)
def test_suffix_array(values, blockwise):
    s = np.array([*values, 0])
    before, sais.BLOCKWISE = sais.BLOCKWISE, 1 << 10 if blockwise else 0
    order = sais.suffix_array(s, 5).tolist()
    sais.BLOCKWISE = before
    text = s.tolist()
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = sais.permuted_lcp(s, np.array(order), 1)
    for a, b in zip(order[1:], order[:-1], strict=True):
        n = 0
        while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n] and text[a + n] > 1:
            n += 1
        assert lcp[a] == n


def test_segments_cover_all_windows():
    texts = ["abcdefgh" * 9, "short", "", "xyz" * 30]
    f, text, start, runs = substring_dedup.segments(*packed(texts), 20, 5)
    for i, t in enumerate(texts):
        covered = sorted(x for a, n in zip(start[text == i].tolist(), runs[text == i].tolist(), strict=True) for x in range(a, a + n))
        assert covered == list(range(max(0, len(t.encode()) - 19)))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 3000, 400)]
    for edits in (5, 20, 40):
        other = list(base)
        for i in rng.integers(0, 400, edits):
            other[i] = f"x{i}"
        e = minhash.elements(words(*packed([" ".join(base + base[:60]), " ".join(other + other[:30])])))
        marks = minhash.signatures(*e, 2, 2000)
        first = e[0] == 0
        exact = minhash.similarity((e[1][first], e[2][first]), (e[1][~first], e[2][~first]))
        assert abs((marks[0] == marks[1]).mean() - exact) < 0.04


def test_poisson():
    u = (np.arange(100000) + 0.5) / 100000
    for mean in (0.01, 0.5, 7.0, 500.0):
        n = minhash.poisson(u, mean)
        assert abs(n.mean() - mean) < 0.02 * mean + 1e-3 and abs(n.var() - mean) < 0.05 * mean + 1e-3


TOY = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"aa": 259, b"aaaa": 260, b" a": 261, b"cab": 262, b"aab": 263, b"bca": 264}


def by_definition(ranks, piece):
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@given(st.text("abc ", max_size=40), st.sampled_from([2, 10, 10000]))
@settings(max_examples=300, deadline=None)
def test_transducer(text, states):
    machine = Transducer(TOY, states)
    piece = text.encode()
    assert machine.encode(piece) == by_definition(TOY, piece) == machine.encode(piece)


@given(st.lists(st.text("abc ", max_size=12), max_size=80), st.sampled_from([2, 100, 10000]))
@settings(max_examples=100, deadline=None)
def test_transducer_reads_many_pieces_at_once(texts, states):
    machine = Transducer(TOY, states)
    pieces = [t.encode() for t in texts]
    ids, sizes = machine.encode_many(pieces)
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [by_definition(TOY, p) for p in pieces]


@pytest.mark.parametrize("states", [10, 10000])
def test_transducer_emits_early(states):
    """On a long piece no byte waits for more than two of the longest tokens, however few states are kept."""
    rng = random.Random(1)
    piece = bytes(rng.choice(b"aaabbc ") for _ in range(20 * states if states > 10 else 10_000))
    machine, read, given_, longest = Transducer(TOY, states), 0, 0, max(map(len, TOY))
    for emitted in machine.stream(piece):
        read += 1
        given_ += sum(machine.size[t] for t in emitted)
        assert read - given_ <= 2 * longest or read > len(piece)
    assert given_ == len(piece) and len(machine.states) <= states
    assert (machine.drops > 0) == (states == 10)


@given(st.text(max_size=40), st.lists(st.integers(0, 160), max_size=6))
@settings(deadline=None)
def test_utf8_machine(text, cuts):
    raw = text.encode()
    cuts = sorted({0, len(raw), *(c for c in cuts if c < len(raw))})
    machine = Utf8Machine()
    out = [machine.feed(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert "".join(out) + machine.close() == text


def test_utf8_machine_on_what_is_none():
    machine = Utf8Machine(strict=False)
    assert machine.feed(b"a\xff\xc3") + machine.feed(b"") + machine.close() == "a\ufffd\ufffd"
    with pytest.raises(UnicodeDecodeError):
        Utf8Machine().feed(b"\xff a")


TIKTOKEN_TEXTS = ["", " ", "  a", "a  \n\t b ", "it's we'll 12 ９", "ß日本語 \u00a0x\x85\x1c!", "a" * 500, "ththatn ingthe" * 30, "\n\n  \n x \n"]


def test_against_tiktoken():
    P = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    rng = random.Random(3)
    texts = TIKTOKEN_TEXTS + ["".join(rng.choice(rng.choice(["abcdefghij", "the inged", "äöüß日本", "  \n\t a.", "!?#'s't 12", "\r\n\x85\u3000\xa0"])) for _ in range(rng.choice((3, 40, 200)))) for _ in range(400)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want, ours = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.open(path, P.PATTERN)
    texts += [" ".join(rng.choice(["x", "yz" * 40, "the", "\u00e9\u00e8"]) for _ in range(20_000)), "abcdefgh" * 40_000]
    few = Tokenizer(ranks, P.PATTERN)
    few.machine = Transducer(ranks, 1000)
    assert [x.tolist() for x in few.encode_many(texts)] == [want.encode_ordinary(t) for t in texts] and few.machine.drops
    for t in texts:
        ids = ours.encode(t).tolist()
        assert ids == want.encode_ordinary(t) and ours.decode(ids) == t.encode() and "".join(ours.decode_stream(ids, 2)) == t
    with pytest.raises(KeyError):
        ours.decode([50256])


def test_chunks_cover_every_byte():
    for size in (0, 1, 7, 8, 9, 255, 256, 257, 300, 1000):
        data = np.arange(size, dtype=np.uint64).astype(np.uint8)
        made, used, first = quality_cnn.chunks(data, np.array([0, size]))
        seen = set()
        for i, n in enumerate(used.tolist()):
            for w in range(n):
                at = i * quality_cnn.WINDOWS * quality_cnn.STEP + w * quality_cnn.STEP
                seen |= set(range(at, at + quality_cnn.WIDTH))
                assert (made[i, w * quality_cnn.STEP : w * quality_cnn.STEP + quality_cnn.WIDTH][: max(0, size - at)] == data[at : at + quality_cnn.WIDTH]).all()
        assert set(range(size)) <= seen and first[-1] == len(made)


def test_quality_net_learns():
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "and", "there", "on"]) for _ in range(rng.randint(1, 200))).encode() for _ in range(120)]
    bad = [" ".join(rng.choice(["the!!", "AND!!", "there%%", "on##"]) for _ in range(rng.randint(1, 200))).encode() for _ in range(120)]
    texts, labels = good + bad, np.array([1] * 120 + [0] * 120)
    net = quality_cnn.QualityNet.train(texts, labels, 0.5)
    data = np.frombuffer(b"".join(texts), np.uint8)
    score = net.score(data, np.cumsum([0, *map(len, texts)]))
    assert ((score > 0.5) == labels).mean() > 0.97
    # A document's score does not depend on what it is scored with.
    assert np.allclose(score[:3], [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts[:3]])
    flat = quality_cnn.QualityNet.train(texts[:5], labels[:5], 0.8)
    assert np.allclose(flat.score(data[:10], np.array([0, 10])), 0.8)


def test_labeller_gradients():
    rng = np.random.default_rng(1)
    made = [html_extract.made_page(rng) for _ in range(4)]
    read = [html_extract.Blocks(p) for p, _ in made]
    net = html_extract.Labeller(3)
    net.params = [p.astype(np.float64) for p in net.params]
    labels = np.concatenate([np.array(x, float) for _, x in made])
    assert len(labels) == sum(len(b.texts) for b in read)

    def loss():
        s = np.concatenate(net.score(read))
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean()

    for k, grad in enumerate(net.gradients(html_extract.features(read), labels)):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = net.params[k][at]
        ends = []
        for step in (1e-4, -1e-4):
            net.params[k][at] = kept + step
            ends.append(loss())
        net.params[k][at] = kept
        assert grad[at] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=0.02)


LINES = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}


@pytest.mark.parametrize("line, name", [*LINES.items(), ("licensed under the apache license version 2.0", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0")])
def test_licenses(line, name):
    text = "Plain words before it. " * 40 + line + "\n" + "and words after it " * 40
    ((got, first, last, *_),) = license_scan.Scanner().scan(text)
    assert got == name and text[first:last] == line.rstrip(".")


def test_license_blocks():
    text = "a\n" + " " * 200000 + "\nb copyright\nc\n\n\n" + "\t" * 200000
    assert [[text[a:b] for a, b in x] for x in license_scan.Scanner().blocks(text)] == [["b", "copyright", "c"]]


def test_licenses_that_are_none():
    scan = license_scan.Scanner().scan
    for text in ("Released under the BSD License.", "The license was MIT-like.", "Permission to park is granted.", "", "\n \n", "copyright " * 500):
        assert scan(text) == []
    assert [x[0] for x in scan("\n".join(LINES))] == list(LINES.values())
    text = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ((name, *_, differences),) = scan(text)
    assert name == "ISC" and differences == ["or -> "]


def test_licenses_in_other_words():
    scanner = license_scan.Scanner()
    for line, name in {
        "This project is licensed under the terms of the MIT license.": "MIT", "This work is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
        "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "CC-BY-NC-ND-4.0", "SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1", "This code is licensed under the GNU General Public License v3": "GPL-3.0",
    }.items():
        assert [x[0] for x in scanner.scan("Plain words before it.\n" + line + "\nand words after it")] == [name], line


@pytest.mark.parametrize("name", sorted(license_scan.TEXTS))
def test_license_texts_in_paragraphs(name):
    scanner = license_scan.Scanner()
    text = next(x[1] for x in license_scan.all_templates()[::-1] if x[0] == name)
    ((got, first, last, _, coverage, differences),) = scanner.scan("Some words here.\n\n" * 400 + text + "\n\nMore words here." * 300)
    assert (got, coverage, differences) == (name, 1.0, [])


def test_license_headers_in_paragraphs():
    scanner = license_scan.Scanner()
    for name, wording, _ in license_scan.NOTICES[:8]:
        text = wording.replace(". ", ".\n\n * ").replace("This program", "Foo")
        assert [x[0] for x in scanner.scan("Words.\n\n" * 50 + text + "\n\nwords\n" * 50)] == [name]


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>A title of it</h1><p>One &amp; two\n three.<p>Four words are here.</p></article><footer>&copy; 2020 Foot</footer></body></html>", "A title of it\nOne & two three.\nFour words are here."),
    ("", ""), ("   ", ""), ("<script>var a='<p>x</p>';", ""), ("<!-- never closed <p>text</p>", ""),
]


def test_html():
    net = html_extract.trained()
    for page, want in PAGES:
        blocks = html_extract.Blocks(page)
        (marks,) = net.score([blocks])
        assert "\n".join(t for t, p in zip(blocks.texts, marks, strict=True) if p > 0.5) == want
    rng, right, n = np.random.default_rng(99), 0, 0
    for _ in range(150):
        page, labels = html_extract.made_page(rng)
        blocks = html_extract.Blocks(page)
        assert len(blocks.texts) == len(labels)
        if labels:
            right += int(((net.score([blocks])[0] > 0.5) == np.array(labels)).sum())
            n += len(labels)
    assert right / n > 0.98


def test_hostile_html():
    for page in ("<a \"" * 3000, "<div>" * 20000 + "x", "</b>" * 20000, "<p" * 20000, "&#" * 1000, "<" * 50000, "<p" * 300000, "<!" * 300000, "<!--" * 100000 + ">", "x" * 300000):
        html_extract.Blocks(page)
    assert html_extract.Blocks("a<br>b  c&nbsp;d<div>e").texts == ["a b c d", "e"]


def test_html_long_attribute_values():
    for quote, other in ("\"'", "'\""):
        for n in (10, 9_999, 10_000, 200_000):
            page = f"<p>one</p><div data-x={quote}{'j' * n}<p>LEAK {other}</p> a > b{quote} class=main>two</div>"
            assert html_extract.Blocks(page).texts == ["one", "two"]
    assert html_extract.Blocks("<p title='a>b>c</p>").texts == ["b>c"]  # unclosed: the first > ends the tag
    for hostile in ("<a \"'>", "<a x=\">'", "<a '>\"<b \">'", "<a \"\"'> "):
        began = time.perf_counter()
        html_extract.Blocks(hostile * 40_000 + "'\"" + "<p>")
        assert time.perf_counter() - began < 10


def test_tokenizer_forgets_when_idle():
    tokenizer = Tokenizer(TOY, r"\S+|\s+")
    with tokenizer.task(idle=0.2):
        before = [x.tolist() for x in tokenizer.encode_many(["abcab aab", "a bca"])]
        time.sleep(0.4)
        assert len(tokenizer.machine.states) > 1
    time.sleep(0.6)
    assert len(tokenizer.machine.states) == 1 and not tokenizer.chunks
    assert [x.tolist() for x in tokenizer.encode_many(["abcab aab", "a bca"])] == before


def test_tasks_give_memory_back():
    """At a task's end, also one that fails or is left early, neither Arrow nor the C library keeps what was freed; the rows are unchanged."""
    own = lambda: sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon"))

    def run(batches):
        for batch in batches:
            held = [b"x" * 60_000 for _ in range(2_000)]  # 120 MB, none large enough for a mapping of its own
            yield batch.slice(0, len(held))

    batches = [pa.record_batch({"a": [1, 2, 3]}) for _ in range(2)]
    assert list(run(iter(batches))) == list(common.trimmed(run)(iter(batches))) == batches
    before = own()
    keeper = [list(common.trimmed(run)(iter(batches))), bytearray(100)]
    assert own() - before < 30_000 and keeper
    with pytest.MonkeyPatch.context() as p:
        seen = []
        p.setattr(common, "trim", lambda: seen.append(1))
        left = common.trimmed(run)(iter(batches))
        next(left)
        left.close()
        with pytest.raises(ZeroDivisionError):
            list(common.trimmed(lambda batches: (1 // 0 for _ in batches))(iter(batches)))
        assert seen == [1, 1]


def test_html_of_many_blocks():
    """A page of 50,000 blocks beside tiny ones takes memory in proportion; empty inline parts take time in proportion."""
    import tracemalloc

    pages = [html_extract.Blocks("<ul>" + "<li>one more" * 50_000 + "</ul>"), *(html_extract.Blocks("<p>short") for _ in range(63))]
    net = html_extract.Labeller()
    tracemalloc.start()
    scores = net.score(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(s) for s in scores] == [50_000] + [1] * 63 and peak < 200 << 20
    assert np.allclose(scores[1], net.score([pages[1]])[0]) and np.allclose(scores[0], net.score([pages[0]])[0])
    began = time.process_time()
    assert html_extract.Blocks("<p>" + "<b> </b>" * 20_000 + "<b>x</b>" * 20_000).texts == ["x" * 20_000]
    assert time.process_time() - began < 5
