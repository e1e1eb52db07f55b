"""Near-duplicate grouping with SuperMinHash signatures (operator 6).

Each document is the set of its distinct word shingles. A SuperMinHash signature takes,
for every element, a random permutation of the registers and strictly rising values along
it, so one element serves all registers and the ranks of a document's registers are
negatively correlated; estimates vary less than with independent minima. Generation stops
once no further value can lower a register: a few steps for long texts.

Signatures are cut into bands. Members of a band's bucket are confirmed against the
bucket's most central member, on full sets. Where that leaves a bucket with several groups,
links between groups are sought through the rarest differences from that member (see
:func:`_across_groups`) and confirmed too, so no link of a bucket is lost and no bucket is
paired out. Buckets, leads and differences that hold one in ``keys.SHARE`` of all rows are not gathered by their key: what
belongs to them goes to their rows. Confirmed links
are joined into components by large-star and small-star steps. Documents with equal sets
count as one from the start, so copies are never compared with each other.

Null, empty or blank texts have an empty set and stay alone; texts shorter than a
shingle are one shingle; ids may be null or repeat (each row then belongs to the group of
its text, and of rows with one id only the first text's keep it); empty tables give empty
results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import textscan as ts
from llm.keys import checkpoint, spread_join, with_key, written

#: Steps after which the few documents that are still open get explicit permutations.
TRACED = 8
#: Members of a lead that share one copy of its text.
SPREAD = 256
_STEP = 0xD1342543DE82EF95


def _step(i: int) -> np.uint64:
    return np.uint64(i * _STEP & (2**64 - 1))


def signatures(hashes: np.ndarray, row: np.ndarray, rows: int, m: int) -> np.ndarray:
    """SuperMinHash registers (rows x m) of the elements ``hashes`` of each row; empty rows stay infinite."""
    h = np.full((rows, m), np.inf)
    flat = h.ravel()
    x, r = hashes, row
    swaps: list[np.ndarray] = []
    perm: np.ndarray | None = None
    for j in range(m):
        if not len(x):
            break
        value = j + (ts.mix(x + _step(2 * j + 1)) >> np.uint64(11)) * 2.0**-53
        k = (j + (ts.mix(x + _step(2 * j + 2)) >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            place = k
            for t in range(j - 1, -1, -1):
                place = np.where(place == t, swaps[t], np.where(place == swaps[t], t, place))
            swaps.append(k)
        else:
            line = np.arange(len(x))
            place = perm[line, k].astype(np.int64)
            perm[line, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(flat, r * m + place, value)
        going = (h.max(axis=1) > j + 1)[r]
        if not going.all():
            x, r = x[going], r[going]
            if perm is None:
                swaps = [s[going] for s in swaps]
            else:
                perm = perm[going]
        if perm is None and j + 1 == TRACED and len(x):
            perm = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
            line = np.arange(len(x))
            for t, s in enumerate(swaps):
                perm[line, t], perm[line, s] = perm[line, s], perm[line, t].copy()
    return h


def _sketch(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    m = bands * rows
    for batch in batches:
        for at, data, off in ts.pieces(batch.column(1)):
            n = len(off) - 1
            h, r = ts.distinct_by_row(*ts.shingles(ts.Words(data, off), size))
            count = np.bincount(r, minlength=n)
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(ts.mix(h), out=sums[1:])
            first = np.concatenate([[0], np.cumsum(count)])
            whole = ts.mix((sums[first[1:]] - sums[first[:-1]]) ^ ts.mix(count.astype(np.uint64)))
            bits = signatures(h, r, n, m).view(np.uint64)
            band = np.empty((n, bands), np.uint64)
            for b in range(bands):
                acc = np.full(n, b + 1, np.uint64)
                for k in range(rows):
                    acc = ts.mix(acc * np.uint64(31) + bits[:, b * rows + k])
                band[:, b] = acc
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(band.view(np.int64).ravel()))
            yield pa.record_batch([batch.column(0).slice(at, n), pa.array(count.astype(np.int64)), pa.array(whole.view(np.int64)), lists], names=["key", "n", "whole", "bands"])


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """From (a, b, text of a, text of b): the (a, b) whose sets are similar enough."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            n = part.num_rows
            sets = []
            for c in (2, 3):
                got = [(h, r + at) for at, data, off in ts.pieces(part.column(c)) for h, r in [ts.shingles(ts.Words(data, off), size)]]
                sets.append(ts.distinct_by_row(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])))
            (ha, ra), (hb, rb) = sets
            order = np.lexsort((np.concatenate([ha, hb]), np.concatenate([ra, rb])))
            h, r = np.concatenate([ha, hb])[order], np.concatenate([ra, rb])[order]
            same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
            both = np.bincount(r[1:][same], minlength=n)
            union = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - both
            ok = (100 * both >= percent * union) & (both > 0)
            yield pa.record_batch([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok))], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(a, b): for each node of ``links`` (a, b) but the smallest of its component, that smallest one."""
    edges = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now


def _differences(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """From (lead, key, n, root, text of lead, text of key): a row for each shingle that only one of the two has.

    ``free`` tells that the two are not linked, ``first`` how many of the rarest of these rows
    any text that is linked with this one, but not with the lead, must have one of.
    """
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            n = part.num_rows
            sets = []
            for c in (4, 5):
                got = [(h, r + at) for at, data, off in ts.pieces(part.column(c)) for h, r in [ts.shingles(ts.Words(data, off), size)]]
                sets.append(ts.distinct_by_row(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])))
            (hl, rl), (hk, rk) = sets
            h, r = np.concatenate([hl, hk]), np.concatenate([rl, rk])
            mine = np.concatenate([np.zeros(len(hl), bool), np.ones(len(hk), bool)])
            order = np.lexsort((h, r))
            h, r, mine = h[order], r[order], mine[order]
            same = np.zeros(len(h), bool)
            both = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
            same[1:] |= both
            same[:-1] |= both
            h, r, mine = h[~same], r[~same], mine[~same]
            extra = np.bincount(r[mine], minlength=n)
            lacking = np.bincount(r[~mine], minlength=n)
            shared = np.bincount(rk, minlength=n) - extra
            free = 100 * shared < percent * (shared + extra + lacking)
            first = extra + lacking - (percent * extra + 100 * lacking) // (100 + percent)
            take = pa.array(r)
            e = np.where(mine, h, ts.mix(h))
            yield pa.record_batch(
                [*(part.column(k).take(take) for k in range(4)), pa.array(free[r]), pa.array(first[r].astype(np.int64)), pa.array(e.view(np.int64))],
                names=["lead", "key", "n", "root", "free", "first", "e"],
            )


def _across_groups(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """(a, b, n_a, n_b): all pairs of different roots under one lead that can reach the similarity.

    Let X and Y be two texts of a lead B, Y with ``e`` shingles that B lacks and lacking ``a``
    of B's. If X is linked with Y but not with B, the two differ from B alike in more than
    (percent * e + 100 * a) / (100 + percent) shingles. So X has one of the rarest
    a + e - floor(that) differences of Y; pairs are made through those alone. Where copies differ by
    edits of their own these are rare, and a large group of near copies makes few pairs.
    """
    columns = "lead long, key long, n long, root long, free boolean, first long, e long"
    rows = written(docs.mapInArrow(partial(_differences, size=size, percent=percent), columns))
    common = rows.groupBy("lead", "e").agg(F.count("*").alias("df"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.bool_or("free").alias("any_free"))
    order = Window.partitionBy("lead", "key").orderBy("df", "e")
    common = checkpoint(common)
    ranked = spread_join(rows, common, ["lead", "e"], "df").withColumn("i", F.row_number().over(order))
    useful = ranked.where("r0 <> r1 and any_free and (free or i <= first)").select("lead", "e", "key", "n", "root", "free", (F.col("i") <= F.col("first")).alias("early"))
    useful = checkpoint(useful)
    x = useful.where("free").select(*(F.col(c).alias(f"{c}_x") for c in ("lead", "e", "key", "n", "root")))
    y = useful.where("early").select(*(F.col(c).alias(f"{c}_y") for c in ("lead", "e", "key", "n", "root")))
    fits = f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
    met = x.join(y, F.expr(f"lead_x = lead_y and e_x = e_y and root_x <> root_y and {fits}"))
    return met.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80, size: int = 5, bands: int = 25, rows: int = 5) -> DataFrame:
    """(id, n_shingles, component, kept) for each row; ``component`` is the smallest id of the group.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both. A
    link of similarity s is found with probability 1 - (1 - s**rows)**bands.
    """
    keyed, unique = with_key(docs, id_col, text_col)
    sketches = checkpoint(keyed.select("key", "text").mapInArrow(partial(_sketch, size=size, bands=bands, rows=rows), "key long, n long, whole long, bands array<long>"))
    first = sketches.where("n > 0").groupBy("whole").agg(F.min(F.struct("key", "n", "bands")).alias("s"))
    members = checkpoint(first.select(F.col("s.key").alias("key"), F.col("s.n").alias("n"), F.explode("s.bands").alias("band")))
    sizes = checkpoint(members.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"))
    members = checkpoint(spread_join(members, sizes, ["band"], "c"))
    # a text in the midst of its copies shares the most and the largest buckets; it leads them
    central = members.groupBy("key").agg(F.sum("c").alias("weight"))
    members = members.join(central, "key")
    members = checkpoint(members)
    lead = checkpoint(members.groupBy("band").agg(F.min(F.struct(-F.col("weight"), "key", "n")).alias("lead"), F.count("*").alias("size")))
    members = checkpoint(spread_join(members.select("band", "key", "n"), lead, ["band"], "size").select("band", "key", "n", F.struct("lead.key", "lead.n").alias("lead")))
    once = keyed if unique else keyed.dropDuplicates(["key"])
    texts = once.select("key", "text").join(members.select("key").distinct(), "key")
    texts = checkpoint(texts)

    def links(pairs: DataFrame) -> DataFrame:
        pairs = checkpoint(pairs.distinct())
        b = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
        return with_lead_text(pairs, "a", "b", "text_a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(partial(_confirm, size=size, percent=percent), "a long, b long")

    def with_lead_text(rows: DataFrame, lead: str, member: str, name: str) -> DataFrame:
        """Checkpointed ``rows`` with the text of each lead; the text goes out once for each ``SPREAD`` of its members, which are dealt out."""
        counts = checkpoint(rows.groupBy(lead).agg(F.count("*").alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / SPREAD).cast("int")))
        lead_texts = texts.select(F.col("key").alias(lead), F.col("text").alias(name))
        if (counts.agg(F.max("_parts")).first()[0] or 0) <= 1:
            return rows.join(lead_texts, lead)
        part = F.pmod(F.xxhash64(F.col(member)), F.col("_parts")).cast("int")
        dealt = spread_join(rows, counts, [lead], "_n", SPREAD).withColumn("_part", part).drop("_n", "_parts")
        copies = counts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).join(lead_texts, lead)
        return dealt.join(copies.select(lead, "_part", name), [lead, "_part"]).drop("_part")

    def fits(n: str, m: str) -> str:
        return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"

    found = checkpoint(links(members.where("key <> lead.key").where(fits("n", "lead.n")).select(F.col("lead.key").alias("a"), F.col("key").alias("b"))))
    stars = components(found)
    # buckets that still hold several groups: the links between them
    grouped = members.join(stars.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left").select("band", "key", "n", F.coalesce("root", "key").alias("root"), F.col("lead.key").alias("lead"))
    grouped = checkpoint(grouped)
    mixed = checkpoint(grouped.groupBy("band").agg(F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("c > 2 and r0 <> r1").select("band", "c"))
    rest = checkpoint(spread_join(grouped, mixed, ["band"], "c").where("key <> lead").select("lead", "key", "n", "root").distinct())
    with_texts = with_lead_text(rest, "lead", "key", "lead_text").join(texts.select("key", "text"), "key")
    pairs = _across_groups(with_texts.select("lead", "key", "n", "root", "lead_text", "text"), percent, size)
    more = checkpoint(links(pairs))
    if not more.isEmpty():
        stars = components(stars.unionByName(more))
    roots = first.select("whole", F.col("s.key").alias("a")).join(stars, "a", "left").select("whole", F.coalesce("b", "a").alias("root"))
    out = sketches.select("key", "n", "whole").join(roots, "whole", "left").select("key", "n", F.coalesce("root", "key").alias("root"))
    kind = docs.schema[id_col].dataType
    if unique:
        name = lambda k: F.when(F.col(k) != F.lit(-(2**63)), F.col(k)).cast(kind)
        return out.select(name("key").alias("id"), F.col("n").alias("n_shingles"), name("root").alias("component"), (F.col("key") == F.col("root")).alias("kept"))
    ids = once.select("key", "id")
    return out.join(ids, "key").join(ids.select(F.col("key").alias("root"), F.col("id").alias("component")), "root").select("id", F.col("n").alias("n_shingles"), "component", (F.col("key") == F.col("root")).alias("kept"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, percent=85, bands=21, rows=6)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
