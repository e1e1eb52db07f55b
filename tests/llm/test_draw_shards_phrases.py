"""Operators 11 to 13 against plain versions, and on nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm import distinct, draw, order, phrases, shards
from llm import textscan as ts
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_crc_of_any_length():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    start = rng.integers(0, 100_000, 300)
    stop = start + np.concatenate([rng.integers(0, 70, 270), rng.integers(60, 90_000, 20), np.arange(60, 70)])
    assert distinct.crc32(data, start, stop).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, stop)]


def test_distinct_survives_colliding_hashes():
    data = np.frombuffer(b"aabbabccab", np.uint8)
    start, stop = np.array([0, 2, 4, 6, 8, 0]), np.array([2, 4, 6, 8, 10, 3])
    one, kind = distinct.distinct(data, np.array([1, 1, 2, 2, 2, 1], np.uint64), start, stop)
    words = [data[a:b].tobytes() for a, b in zip(start, stop)]
    assert [words[one[k]] for k in kind] == words and len(one) == len(set(words))


@pytest.mark.parametrize("longest", [1, 3])
def test_parts_of_a_long_text_have_the_same_features(longest):
    text = " ".join(random.Random(2).choices(["a", "Bc", "déf", "g" * 90, "-", "x1"], k=3000))
    whole = Counter(b for bucket, _, _ in draw.features(pa.array([text, None, "a b"]), longest, 997) for b in bucket.tolist())
    many = list(distinct.parts(pa.array([text]), ts.NON_WORD, longest - 1, 512))
    assert len(many) > 10 and sum(own for *_, own in many) == len(text.encode())
    cut = Counter()
    for _, data, _, own in many:
        found = [(m.start(), m[0]) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(ts.LOWER[data]))]
        cut.update(zlib.crc32(b" ".join(w for _, w in found[i : i + k])) % 997 for i in range(len(found)) if found[i][0] < own for k in range(1, longest + 1) if i + k <= len(found))
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))]
    plain = Counter(zlib.crc32(b" ".join(words[i : i + k])) % 997 for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    short = Counter(zlib.crc32(x) % 997 for x in ([b"a", b"b"] if longest == 1 else [b"a", b"b", b"a b"]))
    assert cut == plain and whole == plain + short


def brute_draw(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in texts for b in runs(x)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in {*s, *t}}
    out = []
    for i, x in docs:
        n, f = runs(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    can = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: percent * sum(r[4] for r in out) // 100]
    return sorted((r[:4] for r in out), key=repr), [(r[0], r[3]) for r in can]


@pytest.mark.parametrize("longest", [1, 2])
def test_draw_matches_plain_version(spark, edge, longest):
    rows = [(r.doc_id, r.text) for r in edge.collect()] + [(100 + i, " ".join(random.Random(i).choices(["red", "Blue", "green", "été", "7"], k=i))) for i in range(60)]
    target = ["blue blue green", None, "", "unseen words"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = draw.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), longest=longest).collect()
    want, drawn = brute_draw(rows, target, longest)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr) == want
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(r.doc_id, r.score) for r in ranked] == drawn and [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))


def test_draw_of_empty_tables(spark, empty, edge):
    none = spark.createDataFrame([], "text string")
    assert draw.resample(empty, none).count() == 0
    rows = draw.resample(edge, none).collect()
    assert len(rows) == edge.count() and all(r.weight == 0 for r in rows if not r.n_features)


def brute_shard(key, weights, seed=shards.SEED):
    costs = []
    for i, w in enumerate(weights):
        u = (int(hashlib.md5(f"{seed}:{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        costs.append((-math.log(u) / w, i))
    return min(costs)[1]


def test_shards_match_plain_version(edge):
    rows = shards.assign(edge, keep=("slot", "key")).collect()
    assert len(rows) == edge.count() and {r.key for r in rows} == {"x"}
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in edge.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    for r in rows:
        key = "" if r.doc_id is None else r.doc_id
        assert (r.law, r.shard, r.grown_shard) == ("key", brute_shard(key, [1] * 16), brute_shard(key, [1] * 17))
        assert r.grown_shard in (r.shard, 16)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_shards_follow_weights_and_move_little(spark, tmp_path):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    weights = (1.0, 2.0, 1.0)
    found = shards.assign(docs, weights=weights, grown=2.0, keep=("text",)).cache()
    sizes = {r.shard: r["count"] for r in found.groupBy("shard").count().collect()}
    assert all(abs(sizes[i] - 6000 * w / 4) < 150 for i, w in enumerate(weights))
    moved = found.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 3").count() == 0 and abs(moved.count() - 2000) < 150
    listed = {r.shard: r for r in shards.manifest(found).collect()}
    shards.write_shards(found, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    for i, n in sizes.items():
        own = back.where(F.col("shard") == i)
        assert (listed[i].rows, listed[i].last_slot) == (n, n - 1) and own.count() == n and own.select("slot").distinct().count() == n
        assert listed[i].bytes == 10 * n


def test_shards_of_empty_table(empty):
    assert shards.assign(empty).count() == 0
    with pytest.raises(ValueError):
        shards.assign(empty, weights=(1.0, 0.0))


def test_positions_within_groups(spark):
    rows = [(i % 3, (i * 7919) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g long, v long, i long")
    got = order.numbered(order.Scratch(spark), df.repartition(7), [F.col("v"), F.col("i")], "at", by="g").collect()
    by = defaultdict(list)
    for g, v, i in rows:
        by[g].append((v, i))
    want = {(g, v, i): k for g, x in by.items() for k, (v, i) in enumerate(sorted(x))}
    assert {(r.g, r.v, r.i): r["at"] for r in got} == want and len(got) == 1000


def brute_phrases(docs, least, longest=4, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        big = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in big.items():
            if any(len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in big.items()):
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


TEXTS = [
    ("The Quick brown fox, the quick brown. fox the\tquick", "en"), (None, "en"), ("", None), (" . , ", None), ("ab ab ab ab ab ab", None), ("ab ab ab", "und"), ("élan vital élan vital; ÉLAN vital", "fr"), ("x" * 3000 + " y", "en"),
    ("one two three four five one two three four five " * 3, "de"), ("z", "de"),
]


@pytest.mark.parametrize("block", [phrases.BLOCK, 64])
@pytest.mark.parametrize("least", [2, 3])
def test_phrases_match_plain_version(spark, block, least):
    rng = random.Random(3)
    rows = TEXTS * 2 + [(" ".join(rng.choices(["a", "b", "c", "D", "e.", "f,", "g\n"], k=200)), rng.choice(["en", "de", None])) for _ in range(12)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("x") for c in ("n", "block", "phrase", "word")}).repartition(3)
    got = phrases.collocations(*phrases.mine(docs, least=least, block=block), top=50).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute_phrases(rows, least, top=50)


def test_phrases_of_empty_tables(spark):
    docs = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert phrases.collocations(*phrases.mine(docs)).count() == 0
    assert phrases.collocations(*phrases.mine(docs.where("false"))).count() == 0


def test_top_rows_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED", 20)
    rows = spark.createDataFrame([(i % 2, i, (i * 37) % 101) for i in range(600)], "g long, i long, v long")
    got = phrases._top(rows, "g", [F.desc("v"), F.asc("i")], "i", 5).collect()
    want = [(g, k + 1, i) for g in (0, 1) for k, (_, i) in enumerate(sorted((-((i * 37) % 101), i) for i in range(g, 600, 2))[:5])]
    assert sorted((r.g, r["rank"], r.i) for r in got) == want


def test_lean_tables_leave_no_shuffle_files(spark):
    """The shuffle files behind a written table go without the garbage collector, though its DataFrame is still held."""
    import time

    from llm.order import Scratch

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files() -> set[str]:
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffle_files()
    df = spark.range(1000).groupBy((F.col("id") % 50).alias("k")).count()
    written = Scratch(spark, lean=True).write("lean", df)
    for _ in range(50):
        left = shuffle_files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and written.count() == df.count() == 50
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_phrases_are_counted_in_rounds(spark, monkeypatch):
    """No round shuffles more than a part of a relation's phrases, and together they count all."""
    rng, rows = random.Random(5), []
    plain = phrases._frequent
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    want = {(r.phrase, r.f) for r in phrases.mine(docs, least=2)[0].collect()}

    def counted(relation, lists, key, least, only=(0, 1)):
        out = plain(relation, lists, key, least, only)
        rows.append((tuple(key), only, out.count(), plain(relation, lists, key, least).count()))
        return out

    monkeypatch.setattr(phrases, "_frequent", counted)
    assert {(r.phrase, r.f) for r in phrases.mine(docs, least=2)[0].collect()} == want
    pairs = [r for r in rows if r[0] == ("a", "b")]
    assert len(pairs) == 3 * phrases.ROUNDS
    for at in range(0, len(pairs), phrases.ROUNDS):
        own = [n for _, _, n, _ in pairs[at : at + phrases.ROUNDS]]
        assert sum(own) == pairs[at][3] and max(own) < 0.6 * sum(own)
