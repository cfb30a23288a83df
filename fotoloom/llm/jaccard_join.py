"""N-gram Jaccard join: a grouped prefix join, and the components of its links.

A document is its set of distinct five-word shingles (A-Z lower-cased; fewer words are one
shingle). Equal sets are one class. Two sets link when they share at
least ``need(n1, n2) = ceil(3 (n1 + n2) / 7)`` shingles, which is a similarity of 0.75.

Prefixes. Shingles are put in one global order, rare ones first; linked sets must share a
shingle within their first ``n - ceil(0.75 n) + 1``, so only those are joined. The order comes from a
count of all shingles in a fixed number of counters: whatever the counters say, any order is
right; they only keep frequent passages out of the prefixes.

Groups. Classes with the same prefix and size are one group, and only groups are joined: a group posts one row for each
shingle of its prefix. Pairs of groups that cannot share enough are dropped by exact bounds: by
their sizes and the places where they meet, then by what their whole prefixes share.

Links. The members of the pairs that remain are verified exactly, their shingles compared as words. To
verify all pairs of a crowd of near copies would be quadratic, so this goes in two rounds. First the smallest members of two groups
and of one group's own; of lists of up to ``short_list`` groups all pairs, of longer ones each
group with the leader of its size band (the group with the fewest rarer shingles). Second, members
of long lists, of groups and of pairs of groups that are still in different components: all their pairs that pass the bounds. A
component is thus exact without expanding a crowd into all its pairs.

Hot lists. A list that may have ``list_rows`` rows or more (the counters never say less) is not sent to one task: leaders are found
by an aggregation that starts before the shuffle, rows are salted, and what is left for the second round is cut into
blocks. Verification sends each pair's texts to a (leader, salt) partition.

Hashes. Shingles are joined and classes made by 64-bit hashes (xxh3 of each word, mixed), classes by the 128-bit digest of
all of a set's hashes. Two sets that differ could be one class only if each shingle they don't share had the hash of another:
a chance of 2^-64 for each pair of sets that differ in one shingle alone, and less for all others. A chance
collision elsewhere costs a comparison, not a link.

Defined results: null texts and texts without words have no shingle, link to nothing and are
their own component; rows that repeat a doc_id have a result each; a null doc_id never is a
component's id unless all its members' are null. Other columns are ignored.

Scale: per document one row with its prefix (a quarter of its hashes) is shuffled twice; pairs and their texts
follow the number of near copies. The driver reads the counters (a few fixed megabytes) and counts.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .repeats import NULL_ID, gram_hashes
from .shared import bounded_broadcast, byte_chunks, free_name, release, stage

SHINGLE = 5
COUNTERS = 1 << 24
_BLOCK = 1 << 16


@dataclass(frozen=True)
class JoinConfig:
    short_list: int = 8
    partners_of_salt: int = 128
    #: a list that may be longer is split over several tasks
    list_rows: int = 240
    #: rows of a list that one task compares with each other
    block_rows: int = 256


def text_words(texts: list[bytes | None]) -> list[list[bytes]]:
    """The words of each text, A-Z lower-cased (``bytes.lower`` knows no other letters)."""
    return [(t or b"").lower().split() for t in texts]


def word_shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text, as words."""
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def shingle_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, made of 64-bit hashes of their words."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):  # some megabytes at a time
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < 1 << 20):
            size += len(texts[end] or b"")
            end += 1
        words = text_words(texts[at:end])
        counts = list(map(len, words))
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(words)), np.uint64, sum(counts))
        grams = gram_hashes(h, SHINGLE)
        first = 0
        for n in counts:
            if n >= SHINGLE:
                g = np.sort(grams[first : first + n - SHINGLE + 1])
                out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
            elif n:  # the whole sequence is one shingle
                out.append(np.asarray([xxhash.xxh3_64_intdigest(h[first : first + n].tobytes(), seed=1)], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
            first += n
        at = end
    return out


def need(n1, n2):
    return (3 * (n1 + n2) + 6) // 7


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "text").alias("rk"),
    )


def shingle_counters(docs: DataFrame) -> np.ndarray:
    """How often shingles fall on each of ``COUNTERS`` counters, over all documents.

    A task counts to 255 at most, which is enough to tell rare from frequent; a total ``n`` comes
    back as the byte ``8 log2(1 + n)``, so that the driver reads 16 MB at any size.
    """

    def count(batches):
        total = np.zeros(COUNTERS, np.uint8)
        for batch in byte_chunks(batches, 4 << 20):
            slots = (np.concatenate(shingle_hashes(batch.column("text").to_pylist())) & np.uint64(COUNTERS - 1)).astype(np.int32)
            slot, n = np.unique(slots, return_counts=True)
            total[slot] = np.minimum(total[slot] + n, 255)
        if total.any():
            blocks = [total[i : i + _BLOCK].tobytes() for i in range(0, COUNTERS, _BLOCK)]
            yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(v, np.uint8).astype(np.int32)
        if sums:
            codes = [np.minimum(np.round(8 * np.log2(1 + v)), 255).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(codes, pa.binary())], names=["block", "counts"])

    kind = "block int, counts binary"
    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).collect()
    out = np.zeros(COUNTERS, np.uint8)
    for r in rows:
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.uint8)
    return out


def document_sets(docs: DataFrame, counters: np.ndarray, cfg: JoinConfig) -> DataFrame:
    """(rk, doc_id, n, d1, d2, g1, g2, prefix, hot): each document's set: size, 128-bit digests of all of it and of
    its ordered prefix, that prefix, and how many of its last places may have a long list.

    Frequent shingles come last in the order, so those whose list may have ``list_rows`` rows are the prefix's end.
    """
    totals = 2.0 ** (np.arange(256) / 8) - 1
    usual = max(2.0, 1.5 * float(np.bincount(counters, minlength=256) @ totals) / COUNTERS)  # what rare shingles that share a counter add up to
    level_of = np.clip(np.floor(np.log2(np.maximum(totals, 1) / usual)) + 1, 0, 60).astype(np.uint8)
    # a task counts to 255, so below that a total is no less than the list is long
    first_hot = int(level_of[int(np.searchsorted(totals, 0.9 * min(cfg.list_rows, 255)))])
    shared = docs.sparkSession.sparkContext.broadcast(level_of[counters])

    def scan(batches):
        levels = shared.value
        for batch in byte_chunks(batches, 4 << 20):
            sizes, digests, prefixes, hot = [], [], [], []
            for h in shingle_hashes(batch.column("text").to_pylist()):
                n = len(h)
                level = levels[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
                prefix = np.argsort(level, kind="stable")[: n - (3 * n + 3) // 4 + 1 if n else 0]
                sizes.append(n)
                prefixes.append(h[prefix].view(np.int64))
                hot.append(int((level[prefix] >= first_hot).sum()))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()) + xxhash.xxh3_128_digest(prefixes[-1].tobytes()))
            marks = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 4)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
            columns = [batch.column("rk"), batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(marks[:, i])) for i in range(4)), lists, pa.array(hot, pa.int32())]
            yield pa.record_batch(columns, names=["rk", "doc_id", "n", "d1", "d2", "g1", "g2", "prefix", "hot"])

    return _numbered(docs).mapInArrow(scan, "rk long, doc_id long, n long, d1 long, d2 long, g1 long, g2 long, prefix array<long>, hot int")


_PAIR = "a long, b long"


def _fits(n1, p1, n2, p2):
    """Whether sets of these sizes that first meet at these places of their order can still link."""
    return need(n1, n2) <= np.minimum(n1 - p1, n2 - p2)


def _list_stream(batches, names, n_keys=1):
    """Whole lists from rows sorted by their first ``n_keys`` columns: arrays of rows, cut where a key ends."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        if not len(cols[0]):
            continue
        other = np.zeros(len(cols[0]), bool)
        for c in cols[:n_keys]:
            other |= c != c[-1]
        end = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if not end and held and any(h[-1][0] != c[0] for h, c in zip(zip(*held), cols[:n_keys])):
            yield [np.concatenate(parts) for parts in zip(*held)]
            held = []
        if end:
            held.append([c[:end] for c in cols])
            yield [np.concatenate(parts) for parts in zip(*held)]
            held = []
        held.append([c[end:] for c in cols])
    if held:
        yield [np.concatenate(parts) for parts in zip(*held)]


def _distinct_pairs(a, b) -> np.ndarray:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    some = lo != hi
    return np.unique(np.stack([lo[some], hi[some]], axis=1), axis=0)


def group_pairs(postings: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Pairs of groups (a, b, token null) from the lists that are not hot, and the members of their long lists (a, b null).

    In a short list all groups meet that fit. In a longer one each meets the group of its size band
    with the fewest rarer shingles, which is the middle of a crowd of near copies.
    """

    def stream(batches):
        for token, gid, n, pos in _list_stream(batches, ("token", "gid", "n", "pos")):
            begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sizes = np.diff(np.append(begins, len(token)))
            a_all, b_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for size in range(2, cfg.short_list + 1):  # all lists of one size at once
                rows = begins[sizes == size][:, None] + np.arange(size)[None, :]
                for i in range(size if len(rows) else 0):
                    for j in range(i + 1, size):
                        x, y = rows[:, i], rows[:, j]
                        ok = _fits(n[x], pos[x], n[y], pos[y])
                        a_all.append(gid[x[ok]])
                        b_all.append(gid[y[ok]])
            for g in np.flatnonzero(sizes > cfg.short_list):
                lo, hi = begins[g], begins[g] + sizes[g]
                c, m, p = gid[lo:hi], n[lo:hi], pos[lo:hi]  # in the order of (n, gid)
                at = 0
                while at < len(c):  # a band: sizes that can all link to each other
                    end = max(int(np.searchsorted(m, m[at] * 4 // 3, side="right")), at + 1)
                    x, lead = np.arange(at, end), at + np.lexsort((c[at:end], p[at:end]))[0]
                    ok = _fits(m[x], p[x], m[lead], p[lead])
                    a_all.append(c[x[ok]])
                    b_all.append(np.full(int(ok.sum()), c[lead]))
                    at = end
                k = hi - lo
                yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(token[lo:hi]), pa.array(c), pa.array(m), pa.array(p.astype(np.int32))], names=["a", "b", "token", "gid", "n", "pos"])
            both = _distinct_pairs(np.concatenate(a_all), np.concatenate(b_all))
            m = len(both)
            yield pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *(pa.nulls(m, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "token", "gid", "n", "pos"])

    kind = "a long, b long, token long, gid long, n long, pos int"
    return postings.repartition("token").sortWithinPartitions("token", "n", "gid").mapInArrow(stream, kind)


def hot_pairs(hot: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Pairs (a, b) of the groups of hot lists with the leaders of their own and the next smaller size band.

    The leader is found by an aggregation that begins before the shuffle, and a list's rows are spread by salt, so that no task reads a whole list.
    """
    salts = 32
    banded = hot.withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3))))
    lead = banded.groupBy("token", "band").agg(F.min(F.struct("pos", "gid", "n")).alias("lead"))
    lead = lead.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    spread = banded.withColumn("salt", F.pmod(F.xxhash64("gid"), F.lit(salts)).cast("int"))
    met = spread.join(lead, ["token", "band", "salt"]).where(F.col("gid") != F.col("lead.gid"))
    both = F.col("n") + F.col("lead.n")
    met = met.where(F.floor((3 * both + 6) / 7) <= F.least(F.col("n") - F.col("pos"), F.col("lead.n") - F.col("lead.pos")))
    return met.select(F.least("gid", "lead.gid").alias("a"), F.greatest("gid", "lead.gid").alias("b")).distinct()


_DEALT = ("token", "pair", "i", "j", "side", "cid", "n", "pos", "comp")


def dealt_members(members: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Rows (token, pair, i, j, side, cid, n, pos, comp): the members of lists (token, cid, n, pos, comp), sent where a partner may be.

    Lists within one component are dropped first. One of up to ``block_rows`` is one place. Of a longer list a row is
    sent by what it fits: ``most = floor(7 (n - pos) / 3) - n`` is the largest partner it can link to, and two rows fit
    when each one's size is within the other's ``most``. Rows with alike sizes and ``most`` are a cell, a component with
    more than ``block_rows`` rows of a list has cells of its own, and only cells meet that hold a fitting pair of
    different components, as far as their extremes say; of these the rows that fit the other cell. Cells that
    meet and are large are cut into blocks of about ``block_rows``, which compare what has to be compared anyhow.
    """
    by_list = members.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("greatest"), F.count("*").alias("size"))
    apart = stage(by_list.where("least <> greatest").select("token", "size"), "lists-apart")[0]
    of = lambda lists: members.join(bounded_broadcast(lists.select("token"), 1_000_000), "token")
    whole = of(apart.where(F.col("size") <= cfg.block_rows)).select("token", F.lit(0).cast("long").alias("pair"), *(F.lit(0).alias(c) for c in _DEALT[2:5]), *_DEALT[5:])
    longer = apart.where(F.col("size") > cfg.block_rows)
    if longer.isEmpty():
        return whole
    rows = of(longer).withColumn("most", F.floor(7 * (F.col("n") - F.col("pos")) / 3) - F.col("n")).where("4 * most >= 3 * n")
    counted = rows.groupBy("token", "comp").agg(F.count("*").alias("size")).where(F.col("size") > cfg.block_rows)
    large = bounded_broadcast(stage(counted.select("token", "comp", F.col("comp").alias("of")), "large-components")[0], 1_000_000)
    rows = rows.join(large, ["token", "comp"], "left")
    step = lambda c: F.floor(16 * F.log(c) / F.log(F.lit(1.4))).cast("int")
    cell = F.struct(F.col("of").isNull().alias("mixed"), F.coalesce("of", F.lit(0)).alias("of"), step(F.col("n")).alias("n"), step(F.col("most")).alias("most"))
    rows = rows.select("token", "cid", "n", "pos", "comp", "most", cell.alias("cell"))
    extremes = [F.min("n").alias("smallest"), F.max("most").alias("most"), F.min("comp").alias("least"), F.max("comp").alias("greatest"), F.ceil(F.count("*") / cfg.block_rows).cast("int").alias("blocks")]
    cells = stage(rows.groupBy("token", "cell").agg(*extremes).withColumn("band", F.floor(F.col("cell.n") / 16)), "cells")[0]
    # sizes that fit differ by a factor of 4 / 3 at most, so by one band
    x, y = cells.withColumn("near", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1))))).alias("x"), cells.alias("y")
    fits = (F.col("x.smallest") <= F.col("y.most")) & (F.col("y.smallest") <= F.col("x.most"))
    differ = F.least("x.least", "y.least") != F.greatest("x.greatest", "y.greatest")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("near") == F.col("y.band")) & (F.col("x.cell") <= F.col("y.cell")) & fits & differ)
    way = lambda own, other, side: met.select(
        F.col(f"{own}.token").alias("token"), F.col(f"{own}.cell").alias("cell"), F.lit(side).alias("side"), F.xxhash64("x.cell", "y.cell").alias("pair"), (F.col("x.cell") == F.col("y.cell")).alias("same"),
        F.col(f"{own}.blocks").alias("blocks"), *(F.col(f"{other}.{c}").alias(f"other_{c}") for c in ("smallest", "most", "least", "greatest", "blocks")),
    )
    ways = stage(way("x", "y", 0).union(way("y", "x", 1).where("NOT same")), "cells-met")[0]
    sent = rows.join(bounded_broadcast(ways, 1_000_000), ["token", "cell"])
    sent = sent.where("other_smallest <= most AND n <= other_most AND NOT (other_least = comp AND other_greatest = comp)")
    sent = sent.withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    first = F.when(F.col("same"), F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    # below 0: a block of another cell, so that only two sides of one cell's block are the same rows
    second = F.when(F.col("same"), F.greatest("own", "other")).when(F.col("side") == 0, -1 - F.col("other")).otherwise(-1 - F.col("own"))
    side = F.when(F.col("same"), (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side"))
    return whole.union(sent.select("token", "pair", first.alias("i"), second.alias("j"), side.alias("side"), *_DEALT[5:]))


def unfinished_pairs(members: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Pairs (a, b) of sets in one list (token, cid, n, pos) that fit but are in different components (comp)."""

    def pack(found):
        both = np.unique(np.concatenate(found), axis=0)  # lists of one passage have the same members
        return pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    def stream(batches):
        for cols in _list_stream(batches, _DEALT, 4):
            i, j = cols[2:4]
            found, size = [], 0
            begins = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)]))
            for lo, hi in zip(begins, np.append(begins[1:], len(i))):
                side, c, n, pos, comps = (x[lo:hi] for x in cols[4:])
                if (comps == comps[0]).all():
                    continue
                same_block = i[lo] == j[lo]
                # sets of one size and place are looked at together; members are expanded for pairs of shapes that fit only
                shape, of = np.unique(np.stack([n, pos.astype(np.int64)], axis=1), axis=0, return_inverse=True)
                by = np.argsort(of.ravel(), kind="stable")
                edge = np.searchsorted(of.ravel()[by], np.arange(len(shape) + 1))
                for k in range(len(shape)):
                    fit = np.flatnonzero(_fits(shape[k, 0], shape[k, 1], shape[k:, 0], shape[k:, 1])) + k
                    if not len(fit):
                        continue
                    others = np.concatenate([by[edge[f] : edge[f + 1]] for f in fit])
                    for x in by[edge[k] : edge[k + 1]]:
                        far = comps[others] != comps[x]
                        y = others[far if same_block else far & (side[others] != side[x])]
                        if len(y):
                            found.append(np.stack([np.minimum(c[x], c[y]), np.maximum(c[x], c[y])], axis=1))
                            size += len(y)
                            if size > 1 << 19:
                                yield pack(found)
                                found, size = [], 0
            if found:
                yield pack(found)

    place = _DEALT[:4]
    return dealt_members(members, cfg).repartition(*place).sortWithinPartitions(*place).mapInArrow(stream, _PAIR).distinct()


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose prefixes share enough that the sets still can.

    Of two sets let a's prefix end first in the global order. All that both share up to there lies in both prefixes;
    beyond it a has only ``n - |prefix|`` shingles left. So the sets share at most what the prefixes share
    plus the longer of the two rests.
    """
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias("n" + c), F.col("prefix").alias("p" + c))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    rest = F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    most = F.size(F.array_intersect("pa", "pb")) + rest
    return both.where(F.floor((3 * (F.col("na") + F.col("nb")) + 6) / 7) <= most).select("a", "b")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, cfg: JoinConfig) -> DataFrame:
    """(a, b, linked) for pairs of class ids, by the exact size of the intersection of their shingles, compared as words."""
    # the end that more pairs name leads, so that a text is sent to few places
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).groupBy("cid").count()
    weighed = pairs.join(ends.toDF("a", "na"), "a").join(ends.toDF("b", "nb"), "b")
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    led = weighed.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("leader"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("cid"), F.greatest("na", "nb").alias("count"))
    salt = F.pmod(F.xxhash64("cid"), F.ceil(F.col("count") / cfg.partners_of_salt)).cast("int")
    led = stage(led.select("leader", "cid", salt.alias("salt")), "pairs-led")[0]
    sent = led.select("cid", "leader", "salt", F.lit(1).alias("role")).union(led.select(F.col("leader").alias("cid"), "leader", "salt", F.lit(0)).distinct())
    places = sent.groupBy("cid").agg(F.collect_list(F.struct("leader", "salt", "role")).alias("places"))
    places = places.join(classes.select("cid", "rk"), "cid")
    rows = _numbered(docs).join(places, "rk").select("text", "cid", F.explode("places").alias("p")).select("text", "cid", "p.*")

    def check(batches):
        now, lead = None, set()
        for batch in byte_chunks(batches, 2 << 20):
            a, b, linked = [], [], []
            for words, cid, leader, salt, role in zip(text_words(batch.column("text").to_pylist()), *(batch.column(c).to_pylist() for c in ("cid", "leader", "salt", "role"))):
                own = word_shingles(words)
                if role == 0:
                    now, lead = (leader, salt), own
                    continue
                assert now == (leader, salt), "a leader comes before its partners"
                a.append(min(cid, leader))
                b.append(max(cid, leader))
                linked.append(len(own & lead) >= need(len(lead), len(own)))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    dealt = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role", "cid")
    return dealt.mapInArrow(check, "a long, b long, linked boolean")


def _placed(docs: DataFrame, cfg: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and (d1, d2, component_id, keeper) for each distinct set that is not empty."""
    spark = docs.sparkSession
    sets = stage(document_sets(docs, shingle_counters(docs), cfg), "sets")[0]
    # A doc_id names a class unless it is null or its rows hold different sets.
    mixed = sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("d1") != F.max("d1")).alias("mixed")).where("mixed")
    mixed = stage(mixed.select(F.col("doc_id").alias("mixed_id")), "repeated-ids")[0]
    known, plain = sets, F.col("doc_id")
    if not mixed.isEmpty():
        known = sets.join(bounded_broadcast(mixed, 1_000_000), F.col("doc_id") == F.col("mixed_id"), "left")
        plain = F.when(F.col("mixed_id").isNull(), F.col("doc_id"))
    keyed = known.where("n > 0").withColumn("rid", F.coalesce(plain, F.xxhash64("d1", "d2")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "rk")).alias("least")
    classes = keyed.groupBy("d1", "d2").agg(least, *[F.first(c).alias(c) for c in ("n", "g1", "g2", "prefix", "hot")])
    classes, p_classes = stage(classes.select("d1", "d2", F.col("least.rid").alias("cid"), F.col("least.rk").alias("rk"), "least", "n", "g1", "g2", "prefix", "hot"), "classes")
    # sets of one size and prefix are one group, named by its smallest class
    shared = classes.groupBy("n", "g1", "g2").agg(F.min("cid").alias("gid"), F.count("*").alias("size")).where("size > 1")
    grouped = stage(classes.select("cid", "n", "g1", "g2").join(shared, ["n", "g1", "g2"]).select("gid", "cid", "n"), "group-members")[0]
    any_group = not grouped.isEmpty()
    release(spark)
    follows = grouped.where("gid <> cid").select("cid")
    firsts = classes.join(bounded_broadcast(follows, 1_000_000), "cid", "left_anti")
    postings = firsts.select(F.col("cid").alias("gid"), "n", (F.size("prefix") - F.col("hot")).alias("cold"), F.posexplode("prefix").alias("pos", "token"))
    cold, p_cold = stage(group_pairs(postings.where("pos < cold").select("token", "gid", "n", "pos"), cfg), "lists")
    release(spark)
    hot, p_hot = stage(postings.where("pos >= cold").select("token", "gid", "n", "pos"), "hot-lists")
    met = cold.where("a IS NOT NULL").select("a", "b")
    met = met.distinct() if hot.isEmpty() else met.union(hot_pairs(hot, cfg)).distinct()
    met, p_met = stage(plausible(met, classes), "met")
    release(spark)
    inside = grouped.where("gid <> cid").select(F.col("gid").alias("a"), F.col("cid").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stage(met.union(inside).distinct(), "pairs")[0] if any_group else met
    checked, p_checked = stage(verify(pairs, classes, docs, cfg), "checked")
    release(spark)
    labels = components(checked.where("linked"))
    # second round: members of long lists, of groups, and of pairs of groups, that are still in different components
    lists = cold.where("token IS NOT NULL").select("token", "gid", "n", "pos").unionByName(hot)
    members = lists.withColumnRenamed("gid", "cid")
    if any_group:  # all members of a group take its place
        in_group = bounded_broadcast(grouped.select(F.col("gid").alias("of"), F.col("cid").alias("member")), 1_000_000)
        expand = lambda rows: rows.join(in_group, F.col("gid") == F.col("of"), "left").select("token", F.coalesce("member", "gid").alias("cid"), "n", "pos")
        heads = bounded_broadcast(grouped.select(F.col("gid").alias("head")).distinct(), 1_000_000)
        wide = met.join(heads, F.col("a") == F.col("head"), "left_semi").union(met.join(heads, F.col("b") == F.col("head"), "left_semi"))
        ends = wide.select(F.xxhash64("a", "b").alias("token"), F.explode(F.array("a", "b")).alias("gid")).join(classes.select(F.col("cid").alias("gid"), "n"), "gid")
        within = grouped.select(F.xxhash64("gid").alias("token"), "cid", "n", F.lit(0).alias("pos"))
        members = expand(lists).unionByName(expand(ends.withColumn("pos", F.lit(0)))).unionByName(within).distinct()
    placed = members.join(labels.select(F.col("id").alias("cid"), "label"), "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")
    placed, p_placed = stage(placed, "placed")
    more, p_more = stage(plausible(unfinished_pairs(placed, cfg).join(pairs, ["a", "b"], "left_anti"), classes), "pairs-2")
    release(spark)
    if not more.isEmpty():
        again = stage(verify(more, classes, docs, cfg), "checked-2")[0]
        labels = components(checked.unionByName(again).where("linked").select("a", "b"))
    own = classes.select("d1", "d2", "cid", "least").join(labels.select(F.col("id").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    lowest = own.groupBy("label").agg(F.min("least").alias("lowest"))
    of_class = own.join(lowest, "label").select("d1", "d2", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.rk").alias("keeper"))
    of_class = stage(of_class, "components")[0]
    release(spark, p_classes, p_cold, p_hot, p_met, p_checked, p_placed, p_more)
    return sets, of_class


def near_duplicate_components(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    sets, of_class = _placed(docs, cfg)
    out = sets.select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id. Rows without words all stay."""
    sets, of_class = _placed(docs, cfg)
    key = free_name(docs.columns, "row_key")
    other = free_name([*docs.columns, key], "other_key")
    gone = sets.where("n > 0").join(of_class, ["d1", "d2"]).where("rk <> keeper").select(F.col("rk").alias(other)).distinct()
    gone = bounded_broadcast(stage(gone, "near-duplicates")[0], 1_000_000)
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "text"))
    kept = rows.join(gone, F.col(key) == F.col(other), "left_anti")
    # rows repeated whole: one of them stays, if it has words
    again = stage(sets.where("n > 0").groupBy("rk").count().where("count > 1").select(F.col("rk").alias(other)), "repeated-rows")[0]
    if not again.isEmpty():
        again = bounded_broadcast(again, 1_000_000)
        once = kept.join(again, F.col(key) == F.col(other), "left_semi").dropDuplicates([key])
        kept = kept.join(again, F.col(key) == F.col(other), "left_anti").unionByName(once)
    return kept.drop(key)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM shingles p JOIN shingles q ON p.x = q.x AND p.doc_id <> q.doc_id
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
