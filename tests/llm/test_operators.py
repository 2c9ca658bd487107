"""The ten operators against brute force on small tables, and on rows that are null, empty, long, repeated or oddly named."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import linerules
from corpusloom.llm.classifier import classify_quality, keep_quality
from corpusloom.llm.kneserney import discounts, score_documents
from corpusloom.llm.linededup import dedup_lines, without_repeated_lines
from corpusloom.llm.mixing import mix_sources, mixed_documents
from corpusloom.llm.ngramjoin import drop_near_duplicates, ngram_jaccard_pairs, similar_documents
from corpusloom.llm.packing import best_fit_decreasing, pack_documents
from corpusloom.llm.suffixes import repeat_occurrences, repeated_passages
from corpusloom.llm.topk import exact_top_k
from corpusloom.llm.urlrules import apply_url_rules, surt

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i * i % 9973}" for i in range(60_000))
EDGE = [
    (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, " \n \t"), (None, "x y z w v u t"), (5, LONG), (6, "a b c d e f g"),
    (7, "word " * 3000), (8, "one.\n\none.\nÀ côté, ça va ?\r\n"), (None, None),
]


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    """Null, empty, blank, repeated and long rows, with extra columns whose names clash."""
    rows = [(i, t, None, None if k % 3 else "s", None, k, "k", "t") for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, DOCS + ", TEXT int, key string, __c0 string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def words_of(texts, n):
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(n)]
    return [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, texts))) for _ in range(60)]


def test_empty_tables(spark, empty):
    for made in (mix_sources, mixed_documents, pack_documents, score_documents, repeated_passages, ngram_jaccard_pairs, drop_near_duplicates, dedup_lines, without_repeated_lines, linerules.clean_lines):
        assert made(empty).collect() == [], made.__name__
    assert classify_quality(empty, labels_of(spark, [])).collect() == []
    assert exact_top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []
    rules = spark.createDataFrame([], "rule_id string, pattern string, action string")
    assert apply_url_rules(spark.createDataFrame([], "page_id bigint, url string"), rules).collect() == []


def test_mixing(spark, edge):
    assert sum(r.copies for r in mix_sources(edge).collect()) == len(EDGE)
    mixed = mixed_documents(edge)
    assert mixed.columns == edge.columns and mixed.count() == len(EDGE)
    texts = ["x" * (10 + i % 90) for i in range(3000)]
    sources = ["hot" if i % 10 else "rare" for i in range(3000)]
    d = docs_of(spark, texts, sources)
    got = mix_sources(d, weights={"hot": 0.5, "rare": 0.5}, total=1000).collect()
    by = Counter()
    for r in got:
        by[r.source] += r.copies
    assert by == {"hot": 500, "rare": 500}
    # whole copies are certain; what is drawn beside them is one more at most
    assert all(r.certain <= r.copies <= r.certain + 1 for r in got)
    # 300 rare rows share 500 draws: each has its whole copies, so all that expect one are there
    m = [round(math.sqrt(1 + len(t)) * 1e6) for t, s in zip(texts, sources, strict=True) if s == "rare"]
    assert sum(r.source == "rare" for r in got) >= sum(500 * x / sum(m) >= 1 for x in m)
    # the same draw again, and the hot rows by brute force
    u = {r.doc_id: r.u for r in d.select("doc_id", __import__("corpusloom.llm.mixing", fromlist=["uniform"]).uniform(F.col("doc_id"), 17).alias("u")).collect()}
    hot = {i: round(math.sqrt(1 + len(texts[i])) * 1e6) for i in range(3000) if sources[i] == "hot"}
    p = {i: 500 * x / sum(hot.values()) for i, x in hot.items()}
    best = sorted(p, key=lambda i: (u[i] / (1 - u[i]) * ((1 - p[i]) / p[i]), i))[:500]
    assert {r.doc_id for r in got if r.source == "hot"} == set(best)


def test_packing(spark, edge):
    rows = pack_documents(edge).collect()
    assert all(r.used == sum(r.lengths) <= 2048 for r in rows)
    got = Counter()
    for r in rows:
        for i, n in zip(r.doc_ids, r.lengths, strict=True):
            got[i] += n
    want = Counter()
    for i, t in EDGE:
        want[i] += len((t or "").split())
    assert got == +want
    lengths = np.sort(np.random.default_rng(1).integers(1, 101, 2000))[::-1]
    bins, _ = best_fit_decreasing(lengths, 100)
    room: list[int] = []
    for n in lengths.tolist():  # the tightest open bin, by search
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(100 - n)
    assert sorted(100 - np.bincount(bins, lengths).astype(int)) == sorted(room)


def test_packing_in_shards(spark):
    """Shards lose no word and need few more bins than one packing."""
    rnd = random.Random(4)
    d = docs_of(spark, ["w " * rnd.randint(1, 100) for _ in range(2000)])
    whole, parts = (pack_documents(d, 100, n).collect() for n in (250_000, 500))
    count = lambda rows: sum((Counter(dict(zip(r.doc_ids, r.lengths, strict=True))) for r in rows), Counter())
    assert count(whole) == count(parts) and all(r.used <= 100 for r in parts)
    assert len(whole) <= len(parts) <= 1.05 * len(whole)


def brute_kneser_ney(texts):
    tri, words = Counter(), []
    for t in texts:
        w = (t or "").split()
        words.append([(a, b, c) for a, b, c in zip(["<", "<", *w], ["<", *w], w, strict=False)])
        tri.update(words[-1])
    pair = Counter((v, w) for _, v, w in tri)
    one = Counter(w for _, w in pair)
    orders = [tri, pair, one]
    d = [discounts([sum(c == k for c in o.values()) for k in (1, 2, 3, 4)]) for o in orders]
    contexts = [defaultdict(list) for _ in orders]
    for k, o in enumerate(orders):
        for g, c in o.items():
            contexts[k][g[:-1] if k < 2 else ()].append(c)

    def p(k, g):
        low = 1 / (len(one) + 1) if k == 2 else p(k + 1, g[1:] if k == 0 else g[-1])
        counts = contexts[k].get(g[:-1] if k < 2 else ())
        if not counts:
            return low
        c, cut = orders[k][g], [d[k][min(x, 3)] for x in counts]
        return (max(c - d[k][min(c, 3)], 0) + sum(cut) * low) / sum(counts)

    return [sum(math.log(p(0, g)) for g in w) for w in words]


def test_kneser_ney(spark, edge):
    assert score_documents(edge).count() == len(EDGE)
    texts = [*words_of(60, 40), None, "", "v1 v2 never"]
    got = {r.doc_id: r for r in score_documents(docs_of(spark, texts)).collect()}
    for i, want in enumerate(brute_kneser_ney(texts)):
        assert got[i].n_tokens == len((texts[i] or "").split())
        assert got[i].log_prob == pytest.approx(want, abs=2e-3)
    assert got[60].perplexity is None


def passages(docs, least=50):
    """{(words, occurrences)} of repeated_passages, written out; and checks that its rows agree."""
    found = repeated_passages(docs, least).cache()
    by = defaultdict(list)
    for r in repeat_occurrences(found).collect():
        by[r.group_id, r.first, r.last, r.words, r.n].append((r.doc_id, r.start))
    rows = found.collect()
    assert len(by) == sum(r.kind == "repeat" for r in rows)
    assert all(len(x) == n >= 2 for (_, _, _, _, n), x in by.items())
    longest = defaultdict(int)
    for (_, _, _, words, _), x in by.items():
        for o in x:
            longest[o] = max(longest[o], words)
    assert {(r.doc_id, r.start): r.words for r in rows if r.kind == "occurrence"} == longest
    assert all((r.doc_id, r.start) in by[r.group_id, r.first, r.last, r.words, r.n] for r in rows if r.kind == "repeat")
    got = [(words, tuple(sorted(x, key=repr))) for (_, _, _, words, _), x in by.items()]
    assert len(set(got)) == len(got)
    return set(got)


def test_repeats(spark, edge):
    rows = repeated_passages(edge).collect()
    # the word 3000 times, and squares modulo 9973, which come again
    assert Counter((r.doc_id, r.words, r.n) for r in rows if r.kind == "repeat") == Counter([(7, w, 3001 - w) for w in range(50, 3000)] + [(5, 60_000 - 9973 * k, k + 1) for k in range(1, 7)])
    rnd = random.Random(5)
    fresh = lambda n: [f"q{rnd.randrange(10**9)}" for _ in range(n)]
    shared = fresh(60)
    parts = [[*fresh(30), *shared, *fresh(20)], [*fresh(7), *shared, *fresh(90)], [*shared, *fresh(3), *shared[:40]], fresh(200)]
    parts.append([*fresh(5), *parts[0][20:95], *fresh(4)])
    parts += [parts[0], parts[2], parts[2], shared, shared]  # copies
    texts = [" ".join(p) for p in parts]
    got = passages(docs_of(spark, texts))
    assert (75, ((0, 20), (4, 5), (5, 20))) in got
    assert got == {(w, tuple(sorted(x, key=repr))) for w, x in brute_repeats(parts, 50)}
    docs = spark.createDataFrame([(None, texts[0], 1), (None, texts[0], 2), (9, texts[1], 3)], "doc_id bigint, text string, TEXT int")
    assert (110, ((None, 0), (None, 0))) in passages_listed(docs)


def passages_listed(docs):
    by = defaultdict(list)
    for r in repeat_occurrences(repeated_passages(docs)).collect():
        by[r.group_id, r.first, r.last, r.words].append((r.doc_id, r.start))
    return {(k[3], tuple(sorted(x, key=repr))) for k, x in by.items()}


def test_repeats_with_lefts_that_share_bits(spark):
    """In two map blocks, two left words whose hashes agree in the top 16 bits still differ."""
    from corpusloom.llm.kernels import span_hash

    words = [f"k{i}" for i in range(2000)]
    ends = np.cumsum([len(w) for w in words])
    top = span_hash(np.frombuffer("".join(words).encode(), np.uint8), ends - [len(w) for w in words], ends) >> np.uint64(48)
    order = np.argsort(top, kind="stable")
    same = np.flatnonzero(top[order[1:]] == top[order[:-1]])[0]
    shared = " ".join(f"m{i}" for i in range(60))
    texts = [(k, f"{words[order[k]]} {shared} z{k}") for k in (int(same), int(same) + 1)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(texts, 2), "doc_id bigint, text string")
    assert passages(docs) == {(60, tuple(sorted(((k, 1) for k, _ in texts), key=repr)))}


def brute_repeats(parts, least):
    """{(words, occurrences)} of all maximal repeats: every run of words that comes twice, with differing words on both sides."""
    out, length = set(), least
    while True:
        at = defaultdict(list)
        for i, p in enumerate(parts):
            for s in range(len(p) - length + 1):
                at[tuple(p[s : s + length])].append((i, s))
        again = [x for x in at.values() if len(x) > 1]
        if not again:
            return out
        for x in again:
            before = {parts[i][s - 1] if s else (i, s) for i, s in x}
            after = {parts[i][s + length] if s + length < len(parts[i]) else (i, s) for i, s in x}
            if len(before) > 1 and len(after) > 1:
                out.add((length, tuple(x)))
        length += 1


def test_repeats_of_periodic_text(spark):
    line, shared = [f"l{i}" for i in range(30)], [f"s{i}" for i in range(400)]
    rnd = random.Random(8)
    loose = [[rnd.choice("ab") for _ in range(rnd.randint(1, 6))] * rnd.randint(2, 30) + [rnd.choice("abc") for _ in range(rnd.randint(0, 20))] for _ in range(12)]
    for parts, least in (([line * 5], 50), ([line * 5 + shared, line * 4 + shared], 50), ([["w"] * 200], 50), (loose, 6)):
        assert passages(docs_of(spark, [" ".join(p) for p in parts]), least) == {(w, tuple(sorted(x, key=repr))) for w, x in brute_repeats(parts, least)}


def test_ngram_join(spark, edge):
    pairs = {(r.doc_a, r.doc_b) for r in ngram_jaccard_pairs(edge).collect()}
    assert (1, 1) in pairs and (1, 6) in pairs and not any(x in (2, 3, 4) for p in pairs for x in p)
    rnd = random.Random(9)
    texts = words_of(50, 300)
    for _ in range(60):
        w = rnd.choice(texts[:60]).split()
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(9)}"
        texts.append(" ".join(w))

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}

    sets = [grams(t) for t in texts]
    want = {}
    for a in range(len(sets)):
        for b in range(a):
            x = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if x >= 0.5:
                want[b, a] = round(x, 6)
    d = docs_of(spark, texts)
    assert {(r.doc_a, r.doc_b): r.jaccard for r in ngram_jaccard_pairs(d).collect()} == want
    root = list(range(len(texts)))
    for _ in root:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    kept = drop_near_duplicates(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in enumerate(root) if i == r}


def test_url_rules(spark):
    urls = ["https://A.example.net:443/x#y", "http://example.net", "example.net.evil.org/", "http://b.a.example.net/p/q?z=1", None, " ", "http://example.networks/", "http://a.example.net/xy"]
    rules = [("r1", "example.net", "block"), ("r2", "a.example.net", "keep"), ("r3", "a.example.net/x", "block"), ("r4", "a.example.net/x", "keep"), ("r5", None, "block"), ("r6", "example.net/", "keep")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule_id, r.action, r.depth) for r in apply_url_rules(pages, spark.createDataFrame(rules, "rule_id string, pattern string, action string")).collect()}
    assert got[0] == ("r4", "keep", 4) and got[7] == ("r4", "keep", 4)
    assert got[1] == ("r6", "keep", 2)
    assert got[3] == ("r2", "keep", 2)
    assert all(got[k] == (None, "keep", 0) for k in (2, 4, 5, 6))
    assert pages.where("page_id = 0").select(surt(F.col("url"))).first()[0] == "net,example,a,)/x"


def test_line_rules(spark, edge):
    assert linerules.clean_lines(edge).count() == len(EDGE)
    text = "A fine sentence ends here.\n\nHome | About | Contact | Help\nAll rights reserved.\nno end mark\nIt goes on, and on and\nyes yes yes yes yes yes yes yes yes.\nWow!! no."
    r = linerules.clean_lines(docs_of(spark, [text, None, ""])).orderBy("doc_id").collect()
    assert r[0].text == "A fine sentence ends here.\n\nIt goes on, and on and" and r[0].removed == 5
    lines = [x.strip(" ") for x in text.split("\n")]
    kept = [x for x in lines if x == "" or x.startswith(("A fine", "It goes"))]
    assert r[0].kept_share == pytest.approx(sum(map(len, kept)) / sum(map(len, lines))) and not r[0].keep
    assert [x.keep for x in r[1:]] == [False, False] and re.search(linerules.TERMINAL, "end.”")


def test_line_dedup(spark, edge):
    assert dedup_lines(edge).count() == len(EDGE)
    base = "The quick brown fox jumps over the lazy dog while the old farmer watches from the porch and waits for rain"
    near = base.replace("lazy", "hazy")
    texts = [f"{base}\nonly here", f"  {base} \nalso mine", f"{near}\nand this", "something else entirely, with no twin at all in the table", base, None, ""]
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "also mine", 2: "and this", 3: texts[3], 4: "", 5: None, 6: ""}
    left = without_repeated_lines(docs_of(spark, texts))
    assert {r.doc_id: r.n_chars for r in left.where("doc_id < 5").collect()} == {0: len(texts[0]), 1: 9, 2: 8, 3: len(texts[3])}
    # recall of the banding over pairs at the threshold or above
    rnd = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    originals = ["".join(rnd.choice(letters) for _ in range(200)).strip() for _ in range(300)]
    changed = [x[:150] + "#" + x[151:] for x in originals]
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(spark, originals + changed)).collect()}
    shingles = lambda x: {x[i : i + 8] for i in range(len(x) - 7)}
    similar = [i for i, (x, y) in enumerate(zip(originals, changed, strict=True)) if len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y))]
    assert len(similar) > 250 and sum(got[300 + i] == "" for i in similar) >= 0.9 * len(similar)
    assert all(got[i] == x for i, x in enumerate(originals))


def test_line_dedup_finds_planted_edits(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    originals, changed = [], []
    for n in [*range(33, 80), *range(80, 400, 5)] * 2:  # one character
        x = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 2))
        x, at = f"x{x}x", rnd.randrange(1, n - 1)
        originals.append(x)
        changed.append(x[:at] + "#" + x[at + 1 :])
    small = sum(len(x) < 80 for x in originals)
    for _ in range(100):  # four words of forty
        w = [word() for _ in range(40)]
        originals.append(" ".join(w))
        for at in rnd.sample(range(40), 4):
            w[at] = word()
        changed.append(" ".join(w))
    n = len(originals)
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(spark, originals + changed)).collect()}
    assert all(got[i] == x for i, x in enumerate(originals))
    found = [got[n + i] == "" for i in range(n)]
    short = [f for f, x in zip(found, originals, strict=True) if len(x) < 80]
    assert len(short) == small and sum(short) >= 0.95 * small
    assert sum(found) >= 0.95 * n and sum(found[-100:]) >= 95


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 40)).astype(np.float32)
    x[7] = x[8]
    x[100:130] = x[99]  # ties across blocks
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(900, None, 0), (901, [], 0), (902, [1.0], 0), (None, x[0].tolist(), 0), (903, [float("nan")] * 40, 0)]
    rows += [(5, [9.0] * 40, 0), (1000, [1.0, 2.0], 0), (1001, [1.0, 2.5], 0)]  # a repeated id, vectors of another length
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, VEC_ID int")
    y = x.astype(np.float64)
    if [9.0] * 40 < x[5].tolist():
        y[5] = 9.0
    for every in (1, 50):
        got = defaultdict(list)
        for r in exact_top_k(vectors, 10, every, block=64).collect():
            got[r.vec_id].append((r["rank"], r.neighbor_id, r.distance))
        assert set(got) == {i for i in [*range(300), 1000, 1001] if i % every == 0}
        for i in range(0, 300, every):
            dist = np.sqrt(((y - y[i]) ** 2).sum(1)).round(9)
            best = sorted((d, j) for j, d in enumerate(dist.tolist()) if j != i)[:10]
            assert [(k, j) for k, j, _ in sorted(got[i])] == [(k + 1, j) for k, (_, j) in enumerate(best)]
        assert got[1000] == [(1, 1001, 0.5)]


def test_quality(spark, edge):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = classify_quality(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right, n, clean, kept = scored.agg(F.sum((F.col("keep") == (F.col("quality") == 1)).cast("int")), F.count("*"), F.sum("quality"), F.sum(F.when(F.col("keep"), F.col("quality")).otherwise(0))).first()
    assert right >= 0.9 * n and kept >= 0.95 * clean
    assert classify_quality(edge, labels_of(spark, [])).where("keep").count() == len(EDGE)
    kept = keep_quality(edge, labels)
    assert kept.columns == edge.columns
    kept.collect()


def test_pipeline(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    from corpus_pipeline import STAGES, run

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{k}")
        then, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(STAGES) - 1:
            assert now.columns == docs.columns, name
        if k < 3:
            assert now.count() <= then.count(), name
    words = then.select(F.explode(F.split("text", "[ \\t\\n\\x0B\\f\\r]+")).alias("w")).where("w != ''").count()
    assert now.agg(F.sum("used")).first()[0] == words
    assert sorted(map(repr, now.collect())) == sorted(map(repr, run(spark, sf).collect()))
