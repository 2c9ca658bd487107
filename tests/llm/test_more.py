"""Cases of shards, repeats, nulls and clashing names, each against a brute-force version."""

import os
import random
import re
import resource
import subprocess
import sys
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import classifier, kernels, kneserney, linededup, linerules, ngramjoin, shared, urlrules
from corpusloom.llm.mixing import mix_sources, mixed_documents
from corpusloom.llm.packing import best_fit_decreasing, pack_documents
from corpusloom.llm.shared import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    """rows of (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def test_mixed_documents_tell_rows_of_one_id_apart(spark):
    rows = [(1, "a" * 10_000), (1, "b"), *((i, "c" * 40) for i in range(2, 40)), (None, "d" * 900), (None, "e")]
    d = frame(spark, rows)
    drawn = Counter()
    for r in mix_sources(d, total=100).collect():
        drawn[r.doc_id] += r.copies
    mixed = Counter((r.doc_id, r.text[0]) for r in mixed_documents(d, total=100).collect())
    assert sum(mixed.values()) == 100 and sum(drawn.values()) == 100
    m = [round((1 + len(t)) ** 0.5 * 1e6) for _, t in rows]
    for (i, t), x in zip(rows, m, strict=True):
        lam = 100 * x / sum(m)
        assert int(lam) <= mixed[i, t[0]] <= int(lam) + 1 or (i, t[0]) not in {(1, "a"), (1, "b"), (None, "d"), (None, "e")}
    assert mixed[1, "a"] >= 20 and mixed[1, "b"] <= 1
    clash = d.withColumnRenamed("lang", "SRC").withColumn("copies", F.lit(7))
    assert mixed_documents(clash, total=100).columns == clash.columns


def test_packing_of_repeats_in_shards(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 2, 3, None]), "w " * rnd.choice([3, 50, 120, 250])) for _ in range(400)] + [(i, "w " * rnd.randint(1, 99)) for i in range(10, 200)]
    for shard_pieces in (100_000, 100):
        made = pack_documents(frame(spark, rows).withColumn("shard", F.lit("x")), 100, shard_pieces).collect()
        assert len({r.bin_id for r in made}) == len(made)
        got = Counter((i, s, n) for r in made for i, s, n in zip(r.doc_ids, r.starts, r.lengths, strict=True))
        want = Counter()
        for i, t in rows:
            n = len(t.split())
            want.update((i, k, 100) for k in range(0, n - n % 100, 100))
            if n % 100:
                want[i, n - n % 100, n % 100] += 1
        assert got == want and all(r.used == sum(r.lengths) <= 100 for r in made)
        shards = {r.bin_id.split(".")[0] for r in made if r.bin_id[0] == "s"}
        assert len(shards) == (1 if shard_pieces > 1000 else -(-len(rows) // shard_pieces))
        for s in shards:  # each shard is the packing that best-fit decreasing gives for its pieces
            mine = [r for r in made if r.bin_id.split(".")[0] == s]
            bins, _ = best_fit_decreasing(np.sort([n for r in mine for n in r.lengths])[::-1], 100)
            assert len(mine) == bins.max() + 1


def test_kneser_ney_in_shards(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    results = []
    for entries in (10_000_000, 3_000):
        scratch = Scratch(spark, "kn-test")
        model = kneserney.train(d, scratch, entries)
        assert (model.bits > 3 and len(model.hot) > 0) == (entries == 3_000)
        results.append(sorted((r.doc_id, r.n_tokens, r.log_prob) for r in kneserney.score(d, model).collect()))
    assert results[0] == results[1]


def test_partners_are_verified_at_once(tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    whole = [np.sort(rng.choice(90, int(rng.integers(5, 60)), replace=False)).astype(np.uint64) for _ in range(12)]
    whole += [np.sort(rng.permutation(w)[: int(len(w) * rng.uniform(0.5, 1)) + 1]) for w in whole for _ in range(4)]
    name = shared.save_arrays(str(tmp_path), {"order": np.concatenate(whole)})
    rid = np.cumsum([0, *(len(w) for w in whole[:-1])])
    t = 0.5
    rows = [(g, r, len(w), k) for w, r in zip(whole, rid.tolist(), strict=True) for k, g in enumerate(w.tolist()[: int(ngramjoin._prefix(np.int64(len(w)), np.int64(len(w)), 2 * t / (1 + t)))])]
    rows.sort()
    gram, r, size, pos = (np.array(x) for x in zip(*rows, strict=True))
    grams, start, count = np.unique(gram.astype(np.uint64), return_index=True, return_counts=True)
    index = shared.save_arrays(str(tmp_path), {"gram": grams, "start": start, "count": count, "rid": r, "size": size, "kept": size, "pos": pos})
    order = sorted(range(len(whole)), key=lambda k: (len(whole[k]), rid[k]))
    want = {}
    for at, x in enumerate(order):
        for y in order[:at]:
            both = len({*whole[x].tolist()} & {*whole[y].tolist()})
            if both >= t * (len(whole[x]) + len(whole[y]) - both):
                want[int(rid[x]), int(rid[y])] = both / (len(whole[x]) + len(whole[y]) - both)
    assert len(want) > 30
    sets = ngramjoin._Sets(str(tmp_path), [name])
    for checked in (1_000_000, 70):
        monkeypatch.setattr(ngramjoin, "CHECKED", checked)
        probe = ngramjoin._Probe(sets, str(tmp_path), {0: index}, 0, t)
        got = {(int(a), b): x for a, w in zip(rid, whole, strict=True) for b, x in probe.partners(int(a), len(w), len(w), 0, int(a))}
        assert got == pytest.approx(want)


def test_ngrams_are_counted_in_ranges(tmp_path):
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 43, 300_000, dtype=np.uint64)
    parts = [np.unique(rng.choice(pool, 10_000), return_counts=True) for _ in range(40)]
    blobs = [ngramjoin.pack_sorted(*p) for p in parts]
    rows = ngramjoin._placed(str(tmp_path), np.zeros(len(blobs), np.int64), blobs)
    assert rows.get_total_buffer_size() < 6000 < sum(map(len, blobs)) // 50  # the bytes stay out of the shuffle
    back = [(k, c.copy()) for k, c in map(ngramjoin.unpack_sorted, shared.load_blobs(str(tmp_path), pa.Table.from_batches([rows])))]
    tracemalloc.start()
    keys, counts = ngramjoin._repeated(back)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * sum(len(k) for k, _ in parts)  # 41 bytes for each entry if all are merged at once
    want = Counter()
    for k, c in parts:
        want.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {k: c for k, c in want.items() if c > 1}
    same = [(np.array([7], np.uint64), np.array([1])), (np.array([7], np.uint64), np.array([2]))]
    assert [x.tolist() for x in ngramjoin._repeated(same)] == [[7], [3]] and not len(ngramjoin._repeated(same[:1])[0])


def test_mapped_files_are_not_kept_open(tmp_path):
    rng = np.random.default_rng(4)
    arrays = [{"a": rng.integers(0, 9, k, dtype=np.uint8), "b": rng.integers(0, 2**40, (k % 3, 2)), "c": np.arange(k, dtype=np.uint16)} for k in range(60)]
    plain = [f"{tmp_path}/{shared.save_arrays(str(tmp_path), x)}" for x in arrays]
    packed = [f"{tmp_path}/{shared.save_packed(str(tmp_path), x)}.packed" for x in arrays]
    assert len(list(tmp_path.iterdir())) == 4 * len(arrays)
    limit, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    maps, one = shared.Maps(), shared.Maps(shared.unpacked)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 20, hard))
    try:
        got = [({k: maps.get(f"{p}.{k}.npy") for k in x}, one.get(q)) for x, p, q in zip(arrays, plain, packed, strict=True)]
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (limit, hard))
    for x, both in zip(arrays, got, strict=True):
        for y in both:
            assert y.keys() == x.keys()
            for k in x:
                assert y[k].dtype == x[k].dtype and np.array_equal(y[k], x[k])


def test_kneser_ney_lookups(tmp_path, monkeypatch):
    rng = np.random.default_rng(12)
    for n in (0, 1, 5, 40, 3000):
        # whole hashes, and some that crowd in one bucket
        keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1), np.arange(n // 4, dtype=np.uint64) << np.uint64(36)]))
        values = rng.integers(1, 30, (len(keys), 4))
        path = f"{tmp_path}/{shared.save_packed(str(tmp_path), kneserney._table('t', keys, values))}"
        asked = np.concatenate([keys, rng.integers(0, 1 << 63, 2000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        found = kneserney._Mapped(path, shared.Maps(shared.unpacked)).find("t", asked)
        # a table keeps the first bits of a key only
        bits = min(16, max(0, len(keys).bit_length() - 5)) + 29
        want = {k >> 64 - bits: tuple(v) for k, v in zip(keys.tolist(), values.tolist(), strict=True)}
        assert [tuple(x) for x in found.tolist()] == [want.get(k >> 64 - bits, (0,) * 4) for k in asked.tolist()]
    # a word is looked up once for all its positions
    model = kneserney.KneserNey("", 2, {}, 1, np.array([7], np.uint64), np.array([[3, 1, 1, 1]]), [np.array([0, 0.5, 1, 1.5])] * 3, 9, 3)
    model.n_unigram = [1, 1, 1]
    asked = []
    monkeypatch.setattr(kneserney.KneserNey, "_lookup", lambda self, kind, table, shard, keys, width: asked.append((kind, table, len(keys))) or np.ones((len(keys), width), np.int64))
    names, u, v, w = np.array([3, 5, 7], np.uint64), np.array([0, 0, 1] * 50), np.array([0, 1, 2] * 50), np.array([1, 2, 1] * 50)
    assert len(model.log_probabilities(names, u, v, w)) == 150
    assert asked == [("one", "one", 3), ("main", "word", 2), ("main", "pair", 100), ("hot", "pair", 50), ("main", "context", 150), ("main", "triple", 150)]


def test_kneser_ney_blobs():
    rng = np.random.default_rng(5)
    names = np.unique(rng.integers(0, 1 << 48, 400, dtype=np.uint64))
    u, v, w = (rng.integers(0, len(names), 900) ** 2 % len(names) for _ in range(3))
    c = rng.integers(1, 2000, 900)
    got, (gu, gv, gw, gc) = kneserney._decode(kneserney._encode(names, u, v, w, c))
    assert Counter(zip(names[u], names[v], names[w], c, strict=True)) == Counter(zip(got[gu], got[gv], got[gw], gc, strict=True))


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def test_similar_documents(spark, monkeypatch):
    rnd = random.Random(19)
    base = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(40)) for _ in range(rnd.randint(1, 40))) for _ in range(40)]
    texts = list(base)
    for _ in range(120):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = "z"
        texts.append(" ".join(w))
    rows = [*enumerate(texts), (3, texts[5]), (None, texts[0]), (None, texts[0]), (900, None), (901, " "), (902, "")]
    sets = [grams(t or "") for _, t in rows]
    near = {(a, b): len(x & y) / len(x | y) for a, x in enumerate(sets) for b, y in enumerate(sets) if a != b and x and y and len(x & y) >= 0.5 * len(x | y)}
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    members = defaultdict(list)
    for k, r in enumerate(root):
        members[r].append(rows[k][0])
    want = Counter()
    for k, (i, _) in enumerate(rows):
        mine = [x for (a, _), x in near.items() if a == k]
        if mine:
            want[i, min((m for m in members[root[k]] if m is not None), default=None), len(mine), round(max(mine), 6)] += 1
    d = frame(spark, rows).withColumn("class_id", F.lit(1)).withColumn("root", F.lit(2))
    for entries in (4_000_000, 200):
        monkeypatch.setattr(ngramjoin, "SHARD_ENTRIES", entries)
        monkeypatch.setattr(ngramjoin, "FLUSH", entries)
        assert Counter(map(tuple, ngramjoin.similar_documents(d).collect())) == want


def test_url_rules_by_brute_force(spark, monkeypatch):
    rnd = random.Random(23)
    hosts = ["example.org", "a.example.org", "b.a.example.org", "example.com", "xn--p.example.net", "org"]
    paths = ["", "/", "/a", "/a/b", "/a/b?q=1", "/ab", "?q", "/é/x"]
    urls = [f"{rnd.choice(['http://', 'https://u@', ''])}{rnd.choice(hosts)}{rnd.choice(['', ':80', '.'])}{rnd.choice(paths)}{rnd.choice(['', '#f'])}" for _ in range(300)]
    urls += ["http://example.org/" + "x" * 20_000, None, "", "  "]
    pages = [(rnd.choice([None, *range(50)]), u, 1) for u in urls]
    rules = [(f"r{i:02d}", rnd.choice(hosts) + rnd.choice(["", *paths[1:6]]), rnd.choice(["keep", "block"]), 2) for i in range(60)] + [("r99", " ", "block", 2), (None, "org", "block", 2)]
    p = spark.createDataFrame(pages, "page_id bigint, url string, KEY int")
    r = spark.createDataFrame(rules, "rule_id string, pattern string, action string, ACTION int")
    keys = [x.k for x in p.select(urlrules.surt(F.col("url")).alias("k")).collect()]
    known = [(x.rule_id, x.action, x.p) for x in r.select("rule_id", F.col("action"), urlrules.rule_prefix(F.col("pattern")).alias("p")).collect()] if False else []
    plain = spark.createDataFrame([t[:3] for t in rules], "rule_id string, pattern string, action string")
    known = [(x.rule_id, x.action, x.p) for x in plain.select("rule_id", "action", urlrules.rule_prefix(F.col("pattern")).alias("p")).collect() if x.p is not None]
    want = Counter()
    for (i, u, _), k in zip(pages, keys, strict=True):
        held = sorted(((len(q), n is not None, n, a) for n, a, q in known if k is not None and k.startswith(q)), key=lambda t: (t[0], t[1], t[2] or ""))
        want[(i, u, held[-1][2], held[-1][3], len(held)) if held else (i, u, None, "keep", 0)] += 1
    for size in (200_000, 20):
        monkeypatch.setattr(urlrules, "BUCKET_PAGES", size)
        assert Counter(map(tuple, urlrules.apply_url_rules(p, plain).collect())) == want
    assert urlrules.apply_url_rules(p, plain.limit(0)).where("depth = 0").count() == len(pages)


def test_line_rules_by_brute_force(spark):
    rnd = random.Random(29)
    parts = ["A good line.", "no end", "Home | About | Us", "click here", "!!", "word word word word word word word word", "It goes on, and on", "\t", "\r", " \x0b ", "", "Straße endet hier.", "«Oui.»", "x" * 5000 + ".", "a, b"]
    texts = ["\n".join(rnd.choice(["", " ", "\t"]) + rnd.choice(parts) + rnd.choice(["", "\r", "  "]) for _ in range(rnd.randint(0, 12))) for _ in range(200)] + [None, ""]
    ws = " \t\x0b\x0c\r"

    def fails(t):
        words = t.split(" ")
        return (
            (len(words) >= linerules.REPEAT_WORDS and len(set(words)) < len(words) * linerules.REPEAT_SHARE) or re.search(linerules.BOILERPLATE, t.lower()) or re.search(linerules.NAVIGATION, t)
            or re.search(linerules.SYMBOLS, t) or (not re.search(linerules.TERMINAL.replace("$", r"\Z"), t) and not re.search(linerules.PROSE, t))
        )

    d = frame(spark, list(enumerate(texts))).withColumn("keep", F.lit(1))
    for r in linerules.clean_lines(d).collect():
        lines = (texts[r.doc_id] or "").split("\n")
        kept = [x for x in lines if not x.strip(ws) or not fails(x.strip(ws))]
        n, k = (sum(len(x.strip(ws)) for x in xs) for xs in (lines, kept))
        assert (r.text, r.n_lines, r.removed) == ("\n".join(kept), len(lines), len(lines) - len(kept))
        assert r.kept_share == pytest.approx(k / n if n else 0.0) and r.keep == (r.kept_share >= linerules.MIN_KEPT)


def test_grouping_of_buckets():
    rng = np.random.default_rng(1)
    agree = linededup._least_agreement(0.7)
    for _ in range(30):
        n = int(rng.integers(1, 200))
        key = np.sort(rng.integers(0, rng.integers(1, 40), n)).astype(np.uint32)
        sketch = rng.integers(0, 2**63, 20, dtype=np.uint64)[rng.integers(0, 20, n)]
        for _ in range(8):
            sketch = sketch ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        sketch = (sketch & linededup._BITS) | (rng.integers(60, 126, n).astype(np.uint64) << np.uint64(linededup.SKETCH))
        root = list(range(n))
        for i in range(n):
            for j in range(i):
                if key[i] == key[j] and linededup._comparable(sketch[i : i + 1], sketch[j : j + 1], 0.7, agree)[0]:
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
        assert linededup._grouped(key, sketch, 0.7).tolist() == root


def test_large_buckets_are_told_apart():
    rng = np.random.default_rng(2)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    many = linededup.SMALL_BUCKET + 200
    texts = [bytearray(letters[rng.integers(0, 26, 120)].tobytes()) for _ in range(many)]
    for k in range(0, many, 4):  # the next two are one byte away from it, or from one another
        texts[k + 1] = bytearray(texts[k])
        texts[k + 1][60] = ord("#")
        texts[k + 2] = bytearray(texts[k + 1])
        texts[k + 2][20] = ord("%")
    ends = np.cumsum([len(x) for x in texts])
    _, sketch, fine = linededup.signatures(np.frombuffer(b"".join(texts), np.uint8), ends - 120, ends)
    got = linededup._grouped(np.zeros(many, np.uint32), sketch, 0.7, fine)
    assert got.tolist() == [k - k % 4 if k % 4 < 3 else k for k in range(many)]


def test_arrow_gives_memory_back():
    assert pa.default_memory_pool().backend_name == "system"


def test_collection_gives_memory_back():
    """Memory that is free between arrays still in use goes back to the system when a worker collects its garbage, as it does after each task."""
    code = """
import gc, re
import numpy as np
from corpusloom.llm import kernels
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
arrays = [np.ones(8000) for _ in range(2000)]
arrays = arrays[::40]
before = held()
gc.collect()
print(before - held())
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=60, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert float(got.stdout) > 80


def test_temporaries_of_statistics_and_signatures_stay_small(monkeypatch):
    rnd = random.Random(47)
    texts = ["\n".join(" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) + str(rnd.randrange(99)) for _ in range(12)) for _ in range(rnd.randint(1, 60))) for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(texts)], ["doc_id", "text"])

    def signed():
        return [x for data, s, e, h, n, d in linededup._each_slice(batch) for x in zip(d.tolist(), n.tolist(), h.tolist(), linededup.signatures(data, s, e)[1].tolist(), strict=True)]

    classifier.statistics(batch.column(1))  # powers that the worker keeps
    for work, most in ((lambda: classifier.statistics(batch.column(1)), 20 << 20), (lambda: sum(len(linededup.signatures(x[0], x[1], x[2])[1]) for x in linededup._each_slice(batch)), 40 << 20)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most
    small = classifier.statistics(batch.column(1)), signed()
    for module in (classifier, linededup):
        monkeypatch.setattr(module, "NARROW", 1 << 30)
    assert (classifier.statistics(batch.column(1)) == small[0]).all() and signed() == small[1]


def test_file_names_are_numbered_without_python_workers(spark):
    known = shared.name_numbers(spark, ["x", "y"], pa.int64())
    assert known.dtypes == [("name", "string"), ("file", "bigint")] and sorted(map(tuple, known.collect())) == [("x", 0), ("y", 1)]
    assert "LocalTableScan" in known._jdf.queryExecution().executedPlan().toString()
    assert shared.name_numbers(spark, [], pa.int32()).collect() == []


def test_small_batches():
    rows = [(k, None if k % 7 == 3 else "x" * (k * 37 % 900)) for k in range(500)]
    whole = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    parts = list(kernels.small_batches([whole, whole.slice(0, 0)], 1, 4000))
    assert [tuple(r.values()) for b in parts for r in b.to_pylist()] == rows
    assert len(parts) > 40 and max(sum(len(t or "") for t in b.column(1).to_pylist()) for b in parts) <= 4000


def test_line_components_by_brute_force(spark, monkeypatch):
    rnd = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    lines = []
    for _ in range(40):
        x = "".join(rnd.choice(letters) for _ in range(rnd.randint(4, 160))).strip() or "x"
        lines.append(x)
        for _ in range(rnd.randint(0, 5)):  # chains of small edits
            at = rnd.randrange(len(x))
            x = x[:at] + rnd.choice("#%&") + x[at + 1 :]
            lines.append(x)
    rnd.shuffle(lines)
    docs, at = [], 0
    while at < len(lines):
        n = rnd.randint(1, 6)
        docs.append("\n".join(rnd.choice(["", " "]) + x + rnd.choice(["", "\t"]) for x in lines[at : at + n]))
        at += n
    rows = [*enumerate(docs), (7, docs[7]), (None, docs[3]), (None, docs[3])]
    flat = [(i, k, x.strip()) for i, t in dict(rows).items() for k, x in enumerate(t.split("\n")) if x.strip()]
    texts = sorted({x for _, _, x in flat})
    shingles = {x: {x[k : k + 5] for k in range(len(x) - 4)} or {x} for x in texts}
    near = [(x, y) for k, x in enumerate(texts) for y in texts[:k] if len(shingles[x] & shingles[y]) >= 0.7 * len(shingles[x] | shingles[y])]

    def kept(pairs):
        root = {x: x for x in texts}
        for _ in texts:
            for x, y in pairs:
                root[x] = root[y] = min(root[x], root[y])
        best = {}
        for i, k, x in flat:
            at = (i is not None, i or 0, k)
            best[root[x]] = min(best.get(root[x], at), at)
        return {(i, k) for i, k, x in flat if best[root[x]] == (i is not None, i or 0, k)}

    want = kept(near)
    for entries in (600_000, 500):
        monkeypatch.setattr(linededup, "BAND_ENTRIES", entries)
        for r in linededup.dedup_lines(frame(spark, rows)).collect():
            own = dict(rows)[r.doc_id].split("\n")
            stay = [x for k, x in enumerate(own) if (r.doc_id, k) in want]
            assert (r.text, r.removed) == ("\n".join(stay), len(own) - len(stay))


def test_boosting_by_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).round(1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0.5)).astype(float)
    trees = classifier.fit(x, y, trees=6, depth=3)
    # the walk of each row, node by node
    for row, p in zip(x, trees.predict(x), strict=True):
        score = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            score += v[node - len(f)]
        assert p == pytest.approx(1 / (1 + np.exp(-score)))
    # the first split by trying all cuts
    base = y.mean()
    g, h = y - base, np.full(len(y), base * (1 - base))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    cuts = [(k, c) for k in range(4) for c in np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1], method="lower"))]
    best = max(gain(x[:, k] <= c) + gain(x[:, k] > c) for k, c in cuts)
    root = classifier.fit(x, y, trees=1, depth=1)
    k, c = int(root.feature[0][0]), root.threshold[0][0]
    assert gain(x[:, k] <= c) + gain(x[:, k] > c) == pytest.approx(best)
    assert (np.abs(classifier.fit(x, y).predict(x) - y) < 0.5).mean() > 0.98


def test_pipeline_of_odd_tables(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    from corpus_pipeline import STAGES, run

    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = [(1, "a b c. d e f."), (1, "a b c. d e f."), (2, None), (3, ""), (None, "x y z. w v u."), (None, None), (5, " ".join(f"w{i}" for i in range(5000))), (6, "one\ntwo\nthree")]
    for name, r in (("odd", rows), ("empty", [])):
        at = f"{tmp_path}/{name}"
        frame(spark, r).withColumn("__c1", F.lit(1)).withColumn("copies", F.lit("c")).withColumn("src", F.lit("x")).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        packed = run(spark, at).collect()
        assert all(r.used == sum(r.lengths) for r in packed) and bool(packed) == bool(r)
        assert len(STAGES) == 5
