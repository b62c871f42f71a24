"""Operators on DataFrames against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from seqframe.llm import bpe, decontaminate, html_extract, license_scan, line_dedup, minhash, quality_cnn, quality_rules, substring_dedup, url_filter
from seqframe.llm.components import components
from seqframe.llm.common import Scratch

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fold_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def made_rows(seed=1, n=60):
    """Texts with exact and near copies, shared lines and passages, empty and null ones, a long one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4)))
    line = "This very line is found in many of the documents, as it is"
    rows = []
    for i in range(n):
        k = rng.random()
        if rows and k < 0.2:
            rows.append((i, rng.choice(rows)[1]))
        elif rows and k < 0.4:
            near = (rng.choice(rows)[1] or "x").split(" ")
            near[rng.randrange(len(near))] = word()
            rows.append((i, " ".join(near)))
        else:
            parts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 5))]
            if rng.random() < 0.5:
                parts.insert(rng.randrange(len(parts) + 1), rng.choice(["  ", "\t"]) + line.upper())
            rows.append((i, "\n".join(parts)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "é" * 90), (n + 3, " ".join(word() for _ in range(20000))), (n + 4, "a b"), (n + 5, "!!! ???")]


# MinHash near-dedup


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = fold_words(t)
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter({("", t or ""): 1}))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = sum((sets[a] & sets[b]).values())
            if shared and shared / (sum(sets[a].values()) + sum(sets[b].values()) - shared) >= threshold:
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(x for x in (least.get(find(i)), d) if x is not None) if d is not None or least.get(find(i)) is not None else None
    return [(d, least[find(i)]) for i, (d, _) in enumerate(rows)]


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("crowd", [2, 64])
def test_minhash(spark, monkeypatch, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)  # at 2 every bucket goes through the prefix filter
    rows = made_rows()
    got = minhash.classes(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_classes(rows), key=key)


@pytest.mark.parametrize("crowd", [2, 64])
def test_minhash_chain_without_a_hub(spark, monkeypatch, crowd):
    """Neighbours are similar, ends are not: one class; a star of copies around a base that are unlike each other, too."""
    monkeypatch.setattr(minhash, "CROWD", crowd)
    words_ = [f"w{i}" for i in range(100)]
    chain = [(i, " ".join(words_[:100] if i == 0 else words_[5 * i :] + [f"x{j}" for j in range(5 * i)])) for i in range(8)]
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    star = [(100, " ".join(base))]
    for i in range(101, 121):
        copy = list(base)
        for j in rng.sample(range(200), 4):
            copy[j] = f"y{i}_{j}"
        star.append((i, " ".join(copy)))
    rows = chain + star
    got = minhash.classes(docs(spark, rows)).collect()
    want = brute_classes(rows)
    assert len({c for d, c in want if d >= 100}) == 1
    assert sorted(map(tuple, got)) == sorted(want)


def test_minhash_edges(spark):
    assert minhash.classes(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, None), (5, ""), (None, "zz")]
    got = sorted(map(tuple, minhash.classes(docs(spark, rows)).collect()), key=key)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (4, 4), (5, 4), (None, None)], key=key)
    clash = docs(spark, [(1, "a b c"), (2, "a b c")]).withColumn("node", F.lit(1)).withColumn("band", F.lit(2)).withColumn("class_id", F.lit(3))
    assert [r["doc_id"] for r in minhash.keep_one(clash).collect()] == [1] and minhash.keep_one(clash).columns == clash.columns


def test_keep_one_of_rows(spark):
    x, y = "a b c d e f g", "h i j k l m n"
    kept = lambda rows: sorted(((r["doc_id"], r["text"]) for r in minhash.keep_one(docs(spark, rows)).collect()), key=key)
    assert kept([(1, x), (1, x), (1, x)]) == [(1, x)]
    assert kept([(None, x), (None, x), (None, y), (7, y)]) == sorted([(None, x), (7, y)], key=key)
    assert kept([(1, x), (2, x), (2, y)]) == [(1, x), (2, y)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 440)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u int, v int"), Scratch(spark)).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# Decontamination


def brute_hits(rows, items):
    windows = {}
    for i, t in items:
        w = fold_words(t)
        for k in range(max(0, len(w) - 9) or bool(w)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w = fold_words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("parts", [2_000_000, 40])
def test_decontaminate(spark, parts):
    rows = made_rows(3, 40)
    long = fold_words(rows[0][1] + " " + rows[5][1])
    items = [(1, " ".join(long[3:30]).upper()), (2, "a b"), (10, " ".join(long[3:20])), (11, None), (12, ""), (13, "!!"), (2, " ".join(long[40:52])), (None, "th er"), (15, "a " * 30)]
    rows += [(90, "x a b y a, b"), (91, "a " * 11), (None, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find_spans(docs(spark, rows), bench, broadcast_grams=parts)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_hits(rows, items), key=key)


def test_decontaminate_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.find_spans(docs(spark, [(1, "a b")]), none)).first()["contaminated"] is False
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0
    clash = docs(spark, [(1, "x a b"), (2, "c")]).withColumn("spans", F.lit(1)).withColumn("items", F.lit("x"))
    kept = decontaminate.decontaminate(clash, bench)
    assert kept.columns == clash.columns and [r["doc_id"] for r in kept.collect()] == [2]


# Line dedup


def brute_lines(rows, least=5):
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(norm(x)) >= 40 and d is not None:
                holders[norm(x)].add(d)
    out = []
    for d, t in rows:
        kept = [x for x in (t or "").split("\n") if len(holders.get(norm(x), ())) < least or max(holders[norm(x)]) == d]
        n = (t or "").count("\n") + 1
        out.append((d, "\n".join(kept), n, n - len(kept)))
    return out


@pytest.mark.parametrize("budget", [32 << 20, 0])
def test_line_dedup(spark, budget):
    line = "The line that is in every document, forty characters"
    rows = made_rows(7) + [(200 + i, f"a\n {line}\t\n{line.upper()}\nb") for i in range(6)] + [(205, line), (None, line + "\nx"), (210, "é" * 39 + "\n" + "É" * 40)] + [(300 + i, "É" * 40 + "\n" + "é" * 39) for i in range(5)]
    source = docs(spark, rows).withColumn("key", F.lit(1))
    got = line_dedup.LineIndex.count_only(source).apply(source, broadcast_bytes=budget)
    assert got.columns == [*source.columns, "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=key) == sorted(brute_lines(rows), key=key)


def test_line_index_is_reversible(spark):
    line = "x" * 45
    base, more = [(i, f"{line}\n{i}") for i in range(4)], [(i, f"{line}\n{'y' * 50}") for i in range(4, 12)]
    everything = docs(spark, base + more)
    index = line_dedup.LineIndex(spark)
    index.insert(docs(spark, base))
    assert index.apply(everything).agg(F.sum("n_dropped")).first()[0] == 0
    index.insert(docs(spark, more))
    got = sorted(map(tuple, index.apply(everything).select("doc_id", "text", "n_lines", "n_dropped").collect()))
    assert got == sorted(brute_lines(base + more))
    index.delete(docs(spark, more[4:]))
    left = base + more[:4]
    assert sorted(map(tuple, index.apply(docs(spark, left)).select("doc_id", "text", "n_lines", "n_dropped").collect())) == sorted(brute_lines(left))
    index.delete(docs(spark, more))
    assert index.apply(docs(spark, base)).agg(F.sum("n_dropped")).first()[0] == 0 and index.hot.count() == 0
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# Substrings


def brute_substrings(rows, n=100):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), []
    for d, t in order:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            w = raw[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000, "hot_bytes": 4000, "broadcast_rows": 0}, {"shard_bytes": 3000, "hot_bytes": 0, "broadcast_rows": 0}, {"hot_bytes": 1 << 40, "seed": 20}])
def test_substrings(spark, options):
    rng = random.Random(4)
    base = "".join(rng.choice("abcde é") for _ in range(600))
    rows = [r for r in made_rows(9, 40) if r[0] < 40]
    for i in range(100, 220):
        k = rng.random()
        if k < 0.3:
            t = "ab" * rng.randint(0, 300)
        elif k < 0.8:
            a = rng.randint(0, 400)
            t = "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30))) + base[a : a + rng.randint(50, 200)] + "".join(rng.choice("xyz") for _ in range(30))
        else:
            t = base[:300] * 2
        rows.append((i, t))
    rows += [(300, None), (301, ""), (302, "é" * 50), (303, "é" * 60)]
    got = substring_dedup.remove_repeats(docs(spark, rows), **options).collect()
    assert sorted((*r[:4], bytes(r[4])) for r in got) == sorted(brute_substrings(rows))


def test_substrings_edges(spark):
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefg") for _ in range(150))
    rows = [(None, text), (1, text), (1, text), (2, text[:120])]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect())
    assert got == [(False, 1, 0), (False, 1, 150), (False, 2, 120), (True, 0, 150)]


# URLs


def brute_url(url, rules=url_filter.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(FOLD)
    fits = [(len(h + p), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_urls(spark, broadcast):
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "x://example.net/en/a?b#c", "x://example.net/en", "x://m.example.net/en/", "x://notexample.net/en/", "x://example.com/de/", "x://a.b.org/fr/q", "x://org/fr", "x://org.net/fr/#/", "x://a?b/c://net/", "x://.net/", "x://net./", "x://é.NET/é", "x://a.b.c.d.e.f.net/1/2/3/4/5", "x://a.net\n/", "x://example.net/en/", "x://example.net/en/"]
    rules = [*url_filter.RULES, ("net", "/x", "allow"), ("net", "/x", "block"), ("b.org", "", "block"), ("c.d.e.f.net", "/1/2/3", "allow"), (None, "/", "block")]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("digest", F.lit(2))
    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = url_filter.filter_urls(pages, table, broadcast_rules=broadcast)
    want = [(i if i != 3 else None, *brute_url(u, rules[:-1])) for i, u in enumerate(urls)]
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=key) == sorted(want, key=key)
    assert url_filter.filter_urls(pages.limit(0), table).count() == 0 and url_filter.filter_urls(pages, table.limit(0)).filter("rule is not null").count() == 0


# Quality


def test_quality_rules(spark):
    rows = made_rows(11, 50) + [(80, "a b c d e f g a b c d e f g h i j k"), (81, "x " * 50), (82, "l 1 2\nl 1 2\n \n \nl 1 2"), (83, "#a $$ b|c\u00a0d\x0be")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, rows + [(None, "q")]).withColumn("stratum", F.lit("x")), labels).collect()}
    for d, t in rows:
        w, n = re.findall(r"[^\x20\x09-\x0D]+", t or ""), collections.Counter()
        for i in range(len(w) - 4):
            n[tuple(w[i : i + 5])] += 1
        repeated = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated), len(w) < 10 or 100 * len(repeated) > 20 * len(w))
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert r["kept"] == (not want[-1] and not r["reasons"])
    assert quality_rules.judge(docs(spark, []), labels).count() == 0
    assert quality_rules.judge(docs(spark, rows), labels.limit(0)).filter("size(reasons) > 0").count() == 0


def tail(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(min(k, n) + 1))


def test_thresholds(spark):
    cells = [(k, float(n)) for n in (10, 200, 3000, 70000) for k in (0, 1, 5, int(n * 0.04), int(n * 0.05), n)]
    got = spark.createDataFrame(cells, "k int, n double").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.05)).collect()
    want = [1 if r["k"] >= 0.05 * r["n"] else tail(r["k"], int(r["n"]), 0.05) for r in got]
    assert all(w - 1e-9 <= r["p"] <= w * (1 + 1e-6) + 1e-9 for r, w in zip(got, want, strict=True))
    rng = random.Random(1)
    rows = [("en", 100, 100 * rng.choice([4, 5, 6]), rng.choice([0] * 30 + [3, 12, 50]), 0, 0, 1) for _ in range(3000)] + [("de", 100, 500, 0, 0, 0, 1)] * 77 + [("fr", 100, 500, 0, 0, 0, 1)] * 80
    df = spark.createDataFrame(rows, "stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    found = {r["stratum"]: r["step"] for r in quality_rules.thresholds(df).collect()}
    steps = len(quality_rules.GRIDS["symbols"])
    assert all(list(g) == sorted(g, reverse=True) and len(g) == steps for g in quality_rules.GRIDS.values())
    for stratum in ("en", "de", "fr"):
        mine, best = [r for r in rows if r[0] == stratum], None
        for i in range(steps):
            cut = {name: grid[i] for name, grid in quality_rules.GRIDS.items()}
            k = sum(r[3] / r[1] > cut["symbols"] or r[2] / r[1] > cut["long_words"] or 1 / r[1] > cut["few_words"] for r in mine)
            if tail(k, len(mine), quality_rules.RISK) > quality_rules.ALPHA / 3:
                break
            best = i + 1
        assert found.get(stratum) == best
    assert found["fr"] == steps and "de" not in found  # 80 good texts are enough for three strata, 77 are not


def test_binomial_tail_of_many(spark):
    """Bounded work for any count, never less than the true value, and none where no test can hold."""
    n = 10**10
    cells = [(k, n) for k in (10**8, 499_000_000, 499_990_000, 500_000_000, n)]
    got = [r["p"] for r in spark.createDataFrame(cells, "k long, n long").select(quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect()]
    assert got[0] == 0 and got[1] < 1e-200 and got[3:] == [1, 1]
    normal = 0.5 * math.erfc(10_000 / math.sqrt(2 * n * 0.05 * 0.95))
    assert normal * 0.99 < got[2] <= 1


def test_false_rejection_stays_under_the_risk(spark):
    """Of 300 strata whose good texts break a rule a little more often than RISK allows, hardly any gets that rule."""
    rng = random.Random(5)
    rows = [(str(s), 100, 500, 100 * (rng.random() < 0.051), 0, 0, 1) for s in range(300) for _ in range(400)]
    df = spark.createDataFrame(rows, "stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    steps = {r["stratum"]: r["step"] for r in quality_rules.thresholds(df, alpha=0.05 * 300).collect()}  # 0.05 for each
    assert sum(step > 1 for step in steps.values()) <= 30  # symbols for a word are 1: over each cutoff but the first


def test_labels_count_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text + f" {i}") for i in range(60)]
    source, once = docs(spark, rows), [(i, 1, 0) for i in range(60)]
    schema = "doc_id long, quality int, toxic int"
    bad = docs(spark, [(1000, " ".join("#" * i for i in range(1, 16)) + " " + text)])
    kept = lambda labels: quality_rules.judge(source.union(bad), spark.createDataFrame(labels, schema)).filter("doc_id = 1000").first()["kept"]
    assert not kept(once) and kept(once[:30] * 3) and kept(once + [(i, 0, 0) for i in range(30)])


def test_quality_classifier(spark):
    import zlib

    rng = random.Random(2)
    rows = []
    for i in range(300):
        good = i % 3 > 0
        rows.append((i, " ".join(rng.choice(["the", "and", "there"]) if good else rng.choice(["THE!!", "x%%%", "###"]) for _ in range(rng.randint(1, 80)))))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    source = docs(spark, rows + [(None, "the and"), (400, None), (401, ""), (401, "the " * 40000)])
    got = quality_cnn.classify(source, labels).collect()
    assert len(got) == 304
    out = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    # Labels of held-out rows do not matter.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality_cnn.classify(source.limit(300), turned).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got if r["doc_id"] is not None and r["doc_id"] < 300)
    clash = source.withColumn("score", F.lit("x")).withColumn("held_out", F.lit("y"))
    kept = quality_cnn.keep_good(clash, labels)
    assert kept.columns == clash.columns and kept.filter("doc_id < 300 and doc_id % 3 = 0").count() < 10
    assert quality_cnn.classify(docs(spark, []), labels).count() == 0
    assert quality_cnn.classify(source, labels.limit(0)).first()["score"] == pytest.approx(0.5)


# Tokens, licenses, pages


def test_bpe(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [(1, "Hello  world\n\n é日本"), (2, None), (3, ""), (None, "a"), (3, "the " * 5000)]
    source = docs(spark, rows).withColumn("ids", F.lit("clash"))
    encoded = bpe.encode(source, path, P.PATTERN)
    back = sorted(map(tuple, bpe.decode(encoded, path, P.PATTERN).collect()), key=key)
    assert back == sorted([(i, t or "") for i, t in rows], key=key)
    ids = {(r["doc_id"], len(r["ids"])): r["ids"] for r in encoded.collect()}
    for r in bpe.round_trip(source, path, P.PATTERN, with_ids=True).collect():
        want = ids[r["doc_id"], r["n_tokens"]]
        assert r["ids"] == want and r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    digests = {r["decoded_sha256"] for r in bpe.round_trip(source, path, P.PATTERN).collect()}
    assert digests == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert bpe.round_trip(docs(spark, []), path, P.PATTERN).count() == 0


def test_license_scan(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, None), (3, ""), (None, "Licensed under CC BY-NC 4.0."), (1, "x\nReleased under the MIT License.\ny"), (5, "word " * 50000)]
    got = license_scan.scan(docs(spark, rows).withColumn("found", F.lit(1))).collect()
    assert sorted(((r["doc_id"], ",".join(f["license"] for f in r["found"])) for r in got), key=key) == sorted([(1, "MIT"), (1, "MIT"), (2, ""), (3, ""), (5, ""), (None, "CC-BY-NC-4.0")], key=key)
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_html_extract(spark):
    page = "<body><nav><a href='/'>Home</a></nav><article><h1>Title of it here</h1><p>Some words &amp; more.</p></article><footer>&copy; x</footer>"
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (1, "u", page), (3, "u", page.replace("</article>", "<p>word word word.</p>" * 3000 + "</article>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5))
    got = html_extract.extract(pages).collect()
    assert sorted(((r["page_id"], r["n_chars"]) for r in got), key=key) == sorted([(1, 35), (1, 35), (2, 0), (None, 0), (3, 35 + 3000 * 16)], key=key)
    assert {r["text"] for r in got if r["page_id"] == 1} == {"Title of it here\nSome words & more."}
    assert html_extract.extract(pages.limit(0)).count() == 0
