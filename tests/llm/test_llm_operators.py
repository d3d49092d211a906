"""The operators against brute force, on a small corpus and on edge cases."""

import hashlib
import math
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import decontaminate, jaccard, licenses, lm, packing, pii, quality, rans, storage, substring, tokens, warc
from tracewright.llm.tokens import WordEncoder, encoder

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def pairs(df, text="text"):
    return [(r.doc_id, r[text]) for r in df.select("doc_id", text).collect()]


def reference_ids(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


# tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_equals_the_library(name):
    own, want = WordEncoder(name), reference_ids(name)

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.lists(st.sampled_from(["a", "Ba", "é", "'", "'s", " ", "  ", "\n", " \n", ".", "!", "12", "²", "œ", "́", "\t", "\xa0", "İ", "Σ", "　", "don't", "$", "_", "漢", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|"]), max_size=12))
    def check(parts):
        text = "".join(parts)
        assert own.encode(text).tolist() == want(text)

    check()


def test_a_lean_encoder_keeps_only_words_that_come_again():
    lean, want = WordEncoder("word_bpe_49k.json", lean=True), reference_ids("word_bpe_49k.json")
    lean.most = 300
    once, often = [f"w{i}q" for i in range(5000)], ["alpha", "beta,", "gamma"]
    texts = [" ".join([w, *often]) for w in once] + [None, ""]
    got = [ids.tolist() for ids in lean.encode_column(pa.array(texts, pa.string()))]
    assert got == [want(t) for t in texts]
    assert {"alpha", "beta,", "gamma"} <= lean.cache.keys() | lean.older.keys()
    assert len(lean.cache) + len(lean.older) < 100  # 5000 others came once

    more = [ids.tolist() for ids in lean.encode_column(pa.array(texts * 2, pa.string()))]
    assert more == got * 2
    assert len(lean.cache) <= 300 and len(lean.older) <= 300


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_columns_are_encoded_in_slices_of_any_size(size, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", size)
    texts = [None, "", "one two", "a\tb\xa0c", "x" * 100, "", "été 漢字", "last\u3000one", None]
    want = reference_ids("word_bpe_49k.json")
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    assert [ids.tolist() for ids in WordEncoder("word_bpe_49k.json", lean=True).encode_column(column)] == [want(t) for t in texts]


# 1: packing


def check_packed(got, source, max_tokens=2048):
    want, ids_of = Counter(), reference_ids("word_bpe_49k.json")
    for doc, text in source:
        ids = [*ids_of(text), 0]
        for k, start in enumerate(range(0, len(ids), max_tokens)):
            part = ids[start : start + max_tokens]
            want[doc, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_tokens
    return len(sequences), sum(r.length for r in got)


def test_packing(docs):
    n, total = check_packed(packing.pack(docs, "word_bpe_49k.json").collect(), pairs(docs))
    assert n <= 1.05 * math.ceil(total / 2048) + 1


def test_packing_edge_cases(odd, empty):
    check_packed(packing.pack(odd, "word_bpe_49k.json", open_bins=2).collect(), pairs(odd))
    got = packing.pack(odd, "word_bpe_49k.json", max_tokens=64, with_ids=True).collect()
    check_packed(got, pairs(odd), 64)
    assert all(len(r.ids) == r.length for r in got)
    assert packing.pack(empty, "word_bpe_49k.json").collect() == []


@settings(max_examples=200, deadline=None, database=None)
@given(st.lists(st.integers(1, 50)), st.integers(1, 8))
def test_best_fit_places_everything(sizes, open_bins):
    fit, closed = packing.BestFit(50, open_bins), []
    for i, n in enumerate(sizes):
        if done := fit.add(n, (i, n)):
            closed.append(done)
        assert fit.n_open <= open_bins
    closed += fit.left()
    assert sorted(x for items in closed for _, x in items) == list(enumerate(sizes))
    for items in closed:
        at = 0
        for offset, (_, n) in items:
            assert offset == at
            at += n
        assert at <= 50


# 2: archives


def digest(text):
    import base64

    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    data = [(1, "http://a/ b", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 999), (5, "u", "é" * 999), (None, "u", "same")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = storage.scratch(spark, "warc")
    warc.write_warc(pages, path)
    read = warc.read_warc(spark, path, verify="true").cache()
    page = lambda c: int(c.rsplit(":")[-1]) if c and not c.endswith("null") else None
    got = sorted(((page(r.record_id), r.record_type, page(r.refers_to), r.payload_bytes, r.payload_digest) for r in read.collect()), key=repr)
    first = {"same": 1, "": 3, "é" * 999: 5}
    want = []
    for i, _, html in data:
        f = first[html or ""]
        want.append((i, "response" if i == f else "revisit", None if i == f else f, len((html or "").encode()), digest(html)))
    assert got == sorted(want, key=repr)
    assert {bytes(r.payload).decode() for r in read.where("record_type = 'response'").collect()} == {"same", "", "é" * 999}
    only = warc.read_warc(spark, path, payload="false").where("record_type = 'revisit' and payload_digest = '%s'" % digest("same"))
    assert only.count() == 2 and only.where("payload is not null").count() == 0
    assert warc.read_warc(spark, path).where("record_id in ('urn:x-page:5')").count() == 2
    big = storage.scratch(spark, "warc")
    warc.write_warc(pages, big, min_bytes=10)
    assert warc.read_warc(spark, big).where("record_type = 'revisit'").count() == 0
    none = storage.scratch(spark, "warc")
    warc.write_warc(pages.where("page_id > 99"), none)
    assert warc.read_warc(spark, none).count() == 0


# 3: token files


def test_token_files(spark, docs, odd, empty):
    ids_of = reference_ids("byte_bpe_50k.json")
    for df in (docs, odd, empty):
        path = storage.scratch(spark, "tokens")
        rans.write_tokens(df, path, "byte_bpe_50k.json", 2)
        start, want = 0, []
        for doc, text in sorted(pairs(df), key=lambda p: p[0]):
            ids = [*ids_of(text), 2]
            want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert rans.read_tokens(spark, path).orderBy("start").collect() == want


@settings(max_examples=30, deadline=None, database=None)
@given(st.lists(st.lists(st.integers(0, 60_000), max_size=400), max_size=8), st.integers(1, 3))
def test_shards_round_trip(texts, repeat):
    import io

    arrays = [np.array(t * repeat, np.uint32) for t in texts]
    ids = np.concatenate([np.zeros(0, np.uint32), *arrays])
    data = rans.encode_shard(np.arange(len(arrays)), np.array([len(a) for a in arrays], np.int64), ids)
    got = [np.concatenate([np.zeros(0, np.uint32), *parts]).tolist() for _, parts in rans.Shard(io.BytesIO(data)).documents()]
    assert got == [a.tolist() for a in arrays]


def test_damage_is_noticed():
    import io

    ids = np.random.default_rng(0).integers(0, 1000, 50_000).astype(np.uint32)
    data = bytearray(rans.encode_shard(np.arange(1), np.array([len(ids)]), ids))
    shard = rans.Shard(io.BytesIO(bytes(data)))
    assert (shard.blocks(2, 3) == ids[2 * rans.BLOCK_IDS : 3 * rans.BLOCK_IDS]).all()  # one block alone
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.Shard(io.BytesIO(bytes(data))).blocks(0, 4)


# 4: decontamination


def overlaps(source, items, window=10):
    tokens = {i: ALNUM.findall((t or "").translate(LOW)) for i, t in items}
    windows = defaultdict(set)
    for i, w in tokens.items():
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for doc, text in source:
        w, hit, found = ALNUM.findall((text or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), sorted(found)))
    return sorted(out, key=repr)


def test_overlaps(spark, docs, odd, empty):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    short = spark.createDataFrame([("a", "beta gamma"), ("b", "zeta eta theta iota kappa alpha beta gamma delta epsilon zeta"), ("c", None), ("d", "??"), ("b", "two WORDS"), ("e", "kappa alpha beta gamma delta epsilon zeta eta theta iota kappa alpha")], "item_id string, text string")
    for df, items in ((docs, bench), (odd, short), (docs, short), (odd, bench.where("item_id < 0")), (empty, short)):
        got = decontaminate.find_overlaps(df, items).select("doc_id", "n_words", "n_hit", "n_items", "items")
        source = [(f"{r.item_id}", r.text) for r in items.collect()]
        merged = overlaps(pairs(df), source) if len(dict(source)) == len(source) else overlaps_many(pairs(df), source)
        assert rows(got) == merged


def overlaps_many(source, items):
    """Items that share an id: judged one by one, then joined."""
    by_doc = []
    for doc, text in source:
        parts = [overlaps([(doc, text)], [item])[0] for item in items]
        hits = decontaminate_hits(text, items)
        found = sorted({x for p in parts for x in p[4]})
        by_doc.append((doc, parts[0][1], len(hits), len(found), found))
    return sorted(by_doc, key=repr)


def decontaminate_hits(text, items, window=10):
    w, hit = ALNUM.findall((text or "").translate(LOW)), set()
    for _, t in items:
        v = ALNUM.findall((t or "").translate(LOW))
        n = min(len(v), window)
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
    return hit


def test_cleaning(spark, monkeypatch):
    items = spark.createDataFrame([(1, "q r s t u v w x y z")], "item_id long, text string")
    data = [(1, "Keep this. Q r s t u v w x y z! and that"), (2, "q r s t u v w x y z"), (3, "clean")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.clean_text for r in decontaminate.find_overlaps(df, items, clean=True, max_coverage=0.9).collect()}
    assert got == {1: "Keep this. ! and that", 2: None, 3: "clean"}
    whole = decontaminate.find_overlaps(df, items, clean=True, min_span=11).collect()
    assert {r.clean_text for r in whole} == {t for _, t in data}


def test_many_automata_give_the_same(spark, docs, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = rows(decontaminate.find_overlaps(docs, bench).select("doc_id", "n_hit", "items"))
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 2000)
    assert rows(decontaminate.find_overlaps(docs, bench).select("doc_id", "n_hit", "items")) == want


# 5: language model


def test_language_model(docs, odd, empty):
    for df in (docs, odd):
        source = pairs(df)
        tokens = [(i, [*SPACED.findall((t or "").translate(LOW)), None]) for i, t in source]
        c = Counter(x for i, w in tokens if lm.in_four_fifths(i) for x in w)
        n, v = sum(c.values()), len(c)
        want = sorted((i, not lm.in_four_fifths(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in tokens)
        got = sorted(lm.score_texts(df, lm.in_four_fifths).collect(), key=lambda r: (r.doc_id, r.n_tokens))
        for a, b in zip(want, got, strict=True):
            assert a[:5] == tuple(b[:5]) and b.base_score == pytest.approx(a[5])
        if df is docs:
            held = [r for r in got if r.held_out]
            assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score_texts(empty, lm.in_four_fifths).collect() == []
    nothing = lm.score_texts(odd, lambda i: False).collect()
    assert all(r.n_known == 0 and r.score == r.base_score for r in nothing)


def plain_scores(source, trains, rounds=2):
    """The same model, token by token, in plain Python."""
    from tracewright.llm.words import Block

    raw = lambda t: np.frombuffer((t or "").encode(), np.uint8)
    texts = [(i, lm.Tokens(Block(np.array([0]), np.array([True]), raw(t), np.array([0, len(raw(t))])))) for i, t in source]
    counts = Counter(h for i, t in texts if trains(i) for h in t.hashes.tolist())
    n, v = sum(counts.values()), len(counts)
    group = {h: int(g) for _, t in texts for h, g in zip(t.hashes.tolist(), t.groups.tolist())}
    mass = np.full(lm.GROUPS, 1e-9)
    for h, c in counts.items():
        mass[group[h]] += c + 0.5
    share = {}
    for g in range(lm.GROUPS):
        for k in range(3):
            path = g >> (12 - 4 * k), (g >> (8 - 4 * k)) & 15
            share[k, path] = share.get((k, path), 0) + mass[g]
    totals = Counter()
    for (k, (path, c)), m in share.items():
        totals[k, path] += m
    share = {(k, p): m / totals[k, p[0]] for (k, p), m in share.items()}

    def keys(t, at):
        """The three choices of a token, and per choice the rows of its features."""
        prev = lambda b: t.hashes[at - b] if at >= b else lm._END
        f = [lm.mixed(np.array([x], np.uint64))[0] for x in (prev(1), prev(2) ^ np.uint64(0x51ED270B7A1C9E35))]
        with np.errstate(over="ignore"):
            f.append(lm.mixed(np.array([prev(1)], np.uint64) * np.uint64(3) + np.array([prev(2)], np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0])
        g = int(t.groups[at])
        return [(k, g >> (12 - 4 * k), (g >> (8 - 4 * k)) & 15, [(k, j, g >> (12 - 4 * k), int(x) >> (48 + 4 * k)) for j, x in enumerate(f)]) for k in range(3)]

    weight = {}
    held = {i: [keys(t, at) for at in range(len(t.hashes))] for i, (_, t) in enumerate(texts)}
    chances = lambda k, path, rows_: (lambda e: [x / sum(e) for x in e])([math.exp(math.log(share[k, (path, c)]) + sum(weight.get((r, c), 0.0) for r in rows_)) for c in range(16)])
    for _ in range(rounds):
        seen, had = Counter(), Counter()
        for i, (doc, t) in enumerate(texts):
            for choice in held[i] if trains(doc) else []:
                for k, path, c, rows_ in choice:
                    p = chances(k, path, rows_)
                    for r in rows_:
                        seen[r, c] += 1
                        for d in range(16):
                            had[r, d] += p[d]
        for r, c in had:
            s = lm.SMOOTH * share[r[0], (r[2], c)]
            weight[r, c] = weight.get((r, c), 0.0) + lm.RATES[r[1]] * math.log((seen[r, c] + s) / (had[r, c] + s))
    whole = n + 0.5 * (v + 1)
    out = []
    for i, (doc, t) in enumerate(texts):
        total = 0.0
        for at, h in enumerate(t.hashes.tolist()):
            total += math.log10((counts[h] + 0.5) / whole)
            if counts[h]:
                total += sum(math.log10(chances(k, path, rows_)[c]) for k, path, c, rows_ in held[i][at]) + math.log10(whole - 0.5) - math.log10(mass[group[h]])
        out.append((doc, total))
    return out


def test_scores_equal_a_plain_model(spark, odd):
    data = [(i, f"the cat {w} on the {w} mat and the dog {'sat' if i % 2 else 'ran'} {w}") for i, w in enumerate("sat ran hat sat pat ran sat Éte".split())] + [(20, None), (21, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = plain_scores(data, lm.in_four_fifths)
    got = sorted((r.doc_id, r.score) for r in lm.score_texts(df, lm.in_four_fifths).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-4)


def test_scores_do_not_depend_on_partitions(spark, docs):
    few, many = ({r.doc_id: r.score for r in lm.score_texts(docs.repartition(n), lm.in_four_fifths).collect()} for n in (2, 24))
    assert few.keys() == many.keys() and all(few[i] == pytest.approx(many[i], rel=1e-6) for i in few)


def test_sums_are_not_sent_by_every_partition(spark, tmp_path, monkeypatch):
    """Many small partitions are summed in few tasks, large ones in as many as their bytes ask for; scores stay."""
    n = 2 * spark.sparkContext.defaultParallelism + 7
    spark.range(900).selectExpr("id AS doc_id", "concat('w', id % 70, ' x', id % 90, ' y', id % 7, ' ', repeat(concat('z', id % 300, ' '), 4)) AS text").repartition(n).write.parquet(str(tmp_path / "d"))
    docs, seen = spark.read.parquet(str(tmp_path / "d")), []
    kind = type(docs)

    def recorded(self, func, *args, plain=kind.mapInArrow, **kwargs):
        seen.append((func.__name__, self.rdd.getNumPartitions()))
        return plain(self, func, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", recorded)

    def scored():
        seen.clear()
        found = {r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_texts(docs, lm.in_four_fifths).collect()}
        return found, {c for f, c in seen if f not in ("send", "score")}, {c for f, c in seen if f in ("send", "score")}

    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 20))
    try:
        assert docs.rdd.getNumPartitions() == n == len(docs.inputFiles())
        few, sums, others = scored()
        assert sums == {2 * spark.sparkContext.defaultParallelism} and others == {n}
        monkeypatch.setattr(lm, "TASK_BYTES", 1 << 10)
        many, sums, _ = scored()
        assert sums == {n}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert few.keys() == many.keys() == set(range(900))
    assert all(few[i][:3] == many[i][:3] and few[i][3] == pytest.approx(many[i][3], rel=1e-6) for i in few)


def test_class_probabilities_sum_to_one():
    """The groups' probabilities given one history, over all groups."""
    rng = np.random.default_rng(0)
    model = lm.Model(rng.random(lm.GROUPS) + 0.1)
    for w in model.weights:
        w += rng.normal(size=w.shape).astype(np.float32)
    groups = np.arange(lm.GROUPS, dtype=np.int16)
    for seed in range(3):
        history = [np.full(lm.GROUPS, x, np.uint64) for x in np.random.default_rng(seed).integers(0, 1 << 63, 3)]
        assert np.exp(model.log_probability(history, groups)).sum() == pytest.approx(1, abs=1e-4)


# 6: licences


def licence_rows(source):
    """Base places, labels and scores by brute force."""
    texts = [(doc, ALNUM.findall((text or "").translate(LOW))) for doc, text in source]
    telling = {w for w, *_ in licenses.postings()}
    df = Counter(w for _, words in texts for w in set(words) & telling)
    idf = lambda w: math.log((len(texts) + 1) / (df[w] + 1)) + 0.05
    at = lambda w, q: [k for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
    out = []
    for doc, w in texts:
        places, base, labels, best = [], set(), set(), 0.0
        for phrase, label in licenses.BASE:
            here = at(w, phrase.split())
            places += here
            base |= {label} if here else set()
        for label, words, first, key in licenses.TEMPLATES:
            whole = sum(idf(x) for x in words if x not in licenses.STOP)
            for k in at(w, key):
                labels.add(label)
                same = sum(idf(x) for i, x in enumerate(words) if x not in licenses.STOP and 0 <= k - first + i < len(w) and w[k - first + i] == x)
                best = max(best, min(same / whole, 1.0))
        join = lambda x: ",".join(sorted(x))
        out.append((doc, len(w), len(places), min(places, default=None), max(places, default=None), join(base), join(base | labels), best))
    return out


def check_licences(df):
    got = sorted((tuple(r) for r in licenses.scan(df).collect()), key=repr)
    want = sorted(licence_rows(pairs(df)), key=repr)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert [r[7] for r in got] == pytest.approx([r[7] for r in want], abs=1e-6)
    return {r[0]: r for r in got}


def test_licences(spark, docs, odd, empty):
    for df in (docs, odd, empty):
        check_licences(df)
    short = [(1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (2, "free permission to copy software"), (3, "Licensed under CC BY-NC 4.0 \u212a"), (4, "GNU Lesser General Public License"), (5, "gnu lesser general public"), (6, "public license lesser gnu")]
    labels = {i: r[6] for i, r in check_licences(spark.createDataFrame(short, "doc_id long, text string")).items()}
    assert labels == {1: "mit", 2: "", 3: "cc-by,cc-by-nc", 4: "lgpl", 5: "", 6: ""}


def test_licences_of_texts_with_many_licence_words(spark):
    """All passages in one text, with licence words between, and each with its key phrase cut short; other rows change no label."""
    noise = " free source copy terms software person charge domain binary forms permitted modification "
    every = noise.join(text for _, text, _ in licenses.PASSAGES)
    mit, apache, bsd = (next(text for label, text, _ in licenses.PASSAGES if label == x) for x in ("mit", "apache-2.0", "bsd"))
    short = noise.join(" ".join([*words[: first + len(key) - 1], "x", *words[first + len(key) :]]) for label, words, first, key in licenses.TEMPLATES if label in ("mit", "bsd", "zlib", "unlicense", "isc"))
    data = [(1, every), (2, f"{mit}. {apache}"), (3, f"{mit} {noise} {bsd}"), (4, short), (5, noise * 50), (6, f"{mit} {bsd} " + licenses.PASSAGES[13][1])]
    for more in ([], [(100 + i, f"free license granted {i}") for i in range(200)]):
        got = check_licences(spark.createDataFrame(data + more, "doc_id long, text string"))
        assert set(got[1][6].split(",")) >= {label for label, *_ in licenses.PASSAGES} and got[1][7] == 1
        assert got[2][6] == "apache,apache-2.0,mit" and got[3][6] == "bsd,mit" and got[6][6] == "bsd,mit,unlicense"
        assert got[4][6:] == ("", 0.0) and got[5][6:] == ("", 0.0)


# 7: near duplicates


def groups(source, percent=75):
    sets, parent = {}, {}
    for i, t in source:
        w = SPACED.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def test_near_duplicates(spark, docs, odd, empty):
    assert rows(jaccard.linked_components(docs)) == sorted(groups(pairs(docs)), key=repr)
    assert sorted(set(rows(jaccard.linked_components(odd)))) == groups(pairs(odd))
    assert jaccard.linked_components(empty).collect() == []


def test_near_duplicate_chains(spark):
    """A large group where neighbours are linked and ends are not, two groups that share a passage, and exact copies."""
    base = [f"t{i}" for i in range(120)]
    data, texts = [], []
    for k in range(40):
        texts.append(" ".join(base))
        at = (k * 5) % 110
        base = [*base[:at], *(f"k{k}x{j}" for j in range(6)), *base[at + 6 :]]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"d{k}w{i}" for i in range(10 + k)) for k in range(20)] * 2
    data = [(len(texts) - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert rows(jaccard.linked_components(df)) == sorted(groups(data), key=repr)


def test_near_duplicate_families(spark):
    """Near copies of one text with few and many edits, a family of copies of one of these, and strangers that share a passage with all."""
    rng = np.random.default_rng(11)

    def edited(words, n, mark):
        words = list(words)
        for k, at in enumerate(rng.choice(len(words), n, replace=False)):
            words[at] = f"{mark}e{k}"
        return words

    base = [f"b{i}" for i in range(150)]
    texts = [edited(base, int(rng.integers(0, 9)), f"a{k}") for k in range(120)]
    far = edited(base, 14, "far")
    texts += [edited(far, int(rng.integers(0, 6)), f"f{k}") for k in range(60)]
    texts += [base[20:60] + [f"s{k}w{i}" for i in range(k)] for k in range(30)]
    data = [(1000 - i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    want = sorted(groups(data), key=repr)
    assert rows(jaccard.linked_components(df)) == want


def test_blocks_of_the_product(monkeypatch, spark):
    """Blocks of few rows, dense and sparse columns, and sides, against all pairs; then columns dealt over several blocks."""
    rng = np.random.default_rng(3)
    for trial in range(20):
        n, width = int(rng.integers(2, 40)), int(rng.integers(5, 60))
        sets = [np.flatnonzero(rng.random(width) < rng.choice([0.05, 0.8, 0.95])).astype(np.uint64) for _ in range(n)]
        sets = [s if len(s) else np.array([99], np.uint64) for s in sets]
        side = (rng.random(n) < 0.5).astype(np.int8) if trial % 2 else None
        sizes = np.array([len(s) for s in sets])
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        links = set()
        for a in range(n):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 175 * both >= 75 * (sizes[a] + sizes[b]) and (side is None or side[a] != side[b]):
                    links.add((a, b))
                    parent[root(a)] = root(b)
        want = [root(x) for x in range(n)]
        found = jaccard.block_forest(sets, sizes, 75, side)
        assert all((max(p), min(p)) in links for p in found) and len(found) == n - len(set(want))
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    monkeypatch.setattr(jaccard, "CENTRES", 1)
    test_near_duplicate_families(spark)


def test_changed_splits_between_passes(spark, tmp_path):
    """Settings that cut files otherwise, changed after the frame was made, move no row."""
    from tracewright.llm.storage import as_scan

    spark.range(4000).selectExpr("id AS doc_id", "concat('w', id % 70, ' x', id % 90, ' ', repeat(concat('y', id % 3000, ' '), 6)) AS text").repartition(3).write.parquet(str(tmp_path / "d"), mode="overwrite")
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert len(docs.inputFiles()) == 3
    scan = as_scan(docs, "documents", F.col("doc_id"), F.col("text"))
    parts = lambda: {r[0]: r[1] for r in scan.select(F.min("doc_id").over(Window.partitionBy(F.spark_partition_id())), F.spark_partition_id()).distinct().collect()}
    before = parts()
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 20))
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        assert docs.rdd.getNumPartitions() == 1 and parts() == before
    finally:
        for key in ("openCostInBytes", "maxPartitionBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")


def test_small_batches_move_no_block(spark, tmp_path, monkeypatch):
    from tracewright.llm.exchange import numbered
    from tracewright.llm.storage import as_scan

    spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('w', id % 70, ' '), cast(id % 40 AS int)) AS text").repartition(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    def signs(batches):
        for part, number, block in numbered(batches, 4096):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([block.sign()])], names=["part", "number", "sign"])

    scan = lambda **k: as_scan(docs, "documents", F.col("doc_id"), F.col("text"), **k)
    small = [r.n for r in scan(batch_rows=100).mapInArrow(sizes, "n long").collect()]
    assert max(small) == 100 and sum(small) == 3000
    found = [sorted(map(tuple, scan(**k).mapInArrow(signs, "part long, number long, sign long").collect())) for k in ({}, {"batch_rows": 100}, {"batch_rows": 1})]
    assert len(found[0]) > 10 and found[0] == found[1] == found[2]
    monkeypatch.setattr(jaccard, "BATCH_ROWS", 2)
    test_near_duplicate_families(spark)


def test_trimmed_workers_hold_little():
    code = """
import re
import numpy as np, pyarrow as pa
from tracewright.llm.words import trim
held = lambda: int(re.search(r"Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
pa.array(["a"])
before = held()
for _ in range(3):
    parts = [pa.array(["x" * 3000] * 5000) for _ in range(6)]
    whole = pa.concat_arrays(parts)
    del parts, whole
trim()
print(held() - before)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2])
    assert int(got.stdout) < 40, got


def test_other_rows_in_a_later_pass_are_noticed(spark, docs):
    from tracewright.llm import exchange
    from tracewright.llm.words import Block

    place = storage.scratch(spark, "answers")
    block = Block(np.array([1, 2]), np.array([True, True]), np.frombuffer(b"ab", np.uint8), np.array([0, 1, 2]))
    storage.write_file(f"{place}/000000.bin", exchange.pickle.dumps({0: (block.sign(), zlib.compress(bytes([1, 2])))}))
    answers = exchange.Answers(place, 0)
    assert answers.of(0, block, 2).tolist() == [1, 2]
    other = Block(np.array([1, 3]), block.known, block.raw, block.offsets)
    for number, b, n in ((0, other, 2), (0, block, 3), (1, block, 2)):
        with pytest.raises(RuntimeError):
            answers.of(number, b, n)


def test_missing_ids(spark):
    """Rows without an id stay rows without an id, and are linked with nothing."""
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, text), (-1, text), (0, text), (None, None)], "doc_id long, text string")
    assert rows(jaccard.linked_components(df)) == sorted([(None, 76, None), (-1, 76, -1), (0, 76, -1), (None, 0, None)], key=repr)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect()), key=repr)
    assert got == sorted([(None, 80, 0), (-1, 80, 0), (0, 80, 80), (None, 0, 0)], key=repr)
    assert sorted((r.doc_id for r in lm.score_texts(df, lm.in_four_fifths).collect()), key=repr) == [-1, 0, None, None]


# 8: quality


def test_quality(spark, docs, odd, empty):
    for df in (docs, odd, empty):
        want = []
        for doc, text in pairs(df):
            t = text or ""
            w = SPACED.findall(t)
            grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
            counts, covered = Counter(grams), set()
            for k, g in enumerate(grams):
                covered |= {k, k + 1, k + 2} if counts[g] > 1 else set()
            lines = [x for x in t.split("\n") if SPACED.search(x)]
            want.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
        got = quality.quality(df).withColumn("failed", quality.base_failed(F.col("_q"))).collect()
        assert sorted((r.row.doc_id, r._q.n_words, r._q.word_chars, r._q.n_symbols, r._q.n_dup_lines, r._q.n_repeat_words, r.failed) for r in got) == sorted(want)
        assert not any(r.failed and r._kept for r in got)


def test_outliers_are_rejected_and_clean_texts_kept(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    data = []
    for i in range(400):
        words = [word() for _ in range(int(rng.integers(60, 200)))]
        if i % 10 == 0:
            words = [w.upper() + "!!***" for w in words]
        data.append((i, " ".join(words), "en", "s"))
    got = {r.row.doc_id: r._kept for r in quality.quality(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, kept in got.items() if not kept and i % 10] == [] and not any(got[i] for i in range(0, 400, 10))


def test_table_junk_is_rejected(spark):
    """Texts with about one symbol to two words, few and many of them, beside clean ones."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    data = []
    for i in range(400):
        words = [word() for _ in range(int(rng.integers(60, 200)))]
        source, every = ("few", 40) if i < 200 else ("many", 5)
        data.append((i, " | ".join(" ".join(words[k : k + 2]) for k in range(0, len(words), 2)) if i % every == 0 else " ".join(words), "en", source))
    junk = {i for i, t, *_ in data if "|" in t}
    got = {r.row.doc_id: r._kept for r in quality.quality(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, kept in got.items() if not kept} == junk


# 9: personal data

FINDERS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    out = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(FINDERS.items()) for m in re.finditer(p, text or "", re.ASCII) if valid(kind, m.group())]
    return sorted(out)


TRICKY = ["a@b.c_d@e.f", "a@b.c.@x.y", "..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "4111-1111 1111-1111 4111 1111 1111 1111", "+1+1 (555) 010-9999 +", "+12345678 9", "4111  1111", "\U0001f600 a@b.co é 10.1.1.1", "9" * 5000, "a" * 5000 + "@", "+1" + "(" * 3000, "1 " * 4000 + "x"]


def test_personal_data(spark, docs, odd, empty):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for df in (docs, odd, extra, empty):
        got = pii.find_pii(df.select("doc_id", "text")).collect()
        want = sorted(((doc, base_spans(t)) for doc, t in pairs(df)), key=repr)
        assert sorted(((r.doc_id, [(s.start, s.kind, s.end) for s in r._pii if s.kind < 4]) for r in got), key=repr) == want


def test_secrets_are_learnt(spark):
    data = [(i, f'word token = "{hashlib.sha1(str(i).encode()).hexdigest()}" then version12345678901234') for i in range(50)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = pii.find_pii(df, keep_text=True)
    got = kept.select(pii.listed(F.col("_pii")).alias("s"), pii.redacted(F.col("text"), F.col("_pii")).alias("t")).collect()
    assert {r.s for r in got} == {"secret:14:54"} and {r.t for r in got} == {'word token = "[SECRET]" then version12345678901234'}


def test_redaction_of_overlaps(spark):
    df = spark.createDataFrame([(1, "a@1.2.3.4 x", [(0, 0, 9), (2, 1, 9)])], "doc_id long, text string, s array<struct<start:bigint,kind:int,end:bigint>>")
    assert df.select(pii.redacted(F.col("text"), F.col("s"))).first()[0] == "[EMAIL] x"


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(3000))
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()._pii
    assert [(s.start, s.kind, s.end) for s in got] == base_spans(text)


# 10: repeated passages


def kept_words(source, window=50):
    first, out = {}, []
    for doc, text in sorted(source, key=lambda p: p[0]):
        w = SPACED.findall(text or "")
        gone, new = set(), []
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if first.get(key, doc) < doc:
                gone.update(range(k, k + window))
            else:
                new.append(key)
        for key in new:
            first.setdefault(key, doc)
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_passages(spark, docs, odd, empty):
    for df in (docs, odd, empty):
        assert rows(substring.remove_repeats(df)) == kept_words(pairs(df))
    rng = np.random.default_rng(2)
    passage = [" ".join(f"p{k}q{i}" for i in range(55)) for k in range(3)]
    data = [(i, " ".join(rng.permutation([*(f"u{i}v{j}" for j in range(20)), passage[i % 3], *(["la"] * 60)]))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert rows(substring.remove_repeats(df, with_text=True).drop("kept_text")) == kept_words(data)
