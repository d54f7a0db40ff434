"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

One permutation ``sigma`` of the 32-bit universe shuffles the shingles once; a second one,
``pi``, shifted by k, gives coordinate k of the signature: min over shingles of
``pi(sigma(x) - k)``. Bands are as many as find a pair at the threshold with odds above
1 - 1e-6 (``banding``; at 0.85 these are 24 of 5 coordinates). Every link is confirmed on
the full shingle sets.

Texts with equal shingle sets are one *class* before anything is compared, so exact copies
cost one row each. Candidates in a bucket are never paired all with all: each member meets
the bucket's hub (its class with the most bucket mates), the links make components, and only members of
different components of a bucket are then compared: pair by pair where these are few, else
by their rarest shingles (see ``_rare_pairs``), so a large group of near copies costs a few
comparisons a member while no link between components is lost.

Nulls and blanks: a null or wordless text has an empty set and is linked with nothing. Rows
with a null id come back with a null component and are kept. Repeated ids with equal texts
share one component; every such row comes back. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bytetext as B
from .components import components
from .scratch import map_arrow, materialize, small

#: Odds that bands miss a pair at the threshold; coordinates of a signature, if so few do; deviations below the mean for the least agreement of codes.
MISS, COORDINATES, DEVIATIONS = 1e-6, 128, 7.0
#: Ratio of the sizes in one band.
BAND = 1.03
#: A bucket with at most so many pairs a member across components is compared pair by pair.
LIGHT = 4
_FEATURES = "doc_id long, n_shingles long, class_id binary, bands array<long>, c0 long, c1 long, c2 long, c3 long"


def banding(percent: int) -> tuple[int, int]:
    """Bands, and the coordinates of each, that miss a pair of this similarity with odds of ``MISS`` at most: the longest bands that ``COORDINATES`` allow."""
    t = percent / 100
    for rows in (5, 4, 3, 2):
        bands = math.ceil(math.log(MISS) / math.log(1 - t**rows)) if t < 1 else 1
        if bands * rows <= COORDINATES:
            return bands, rows
    return math.ceil(math.log(MISS) / math.log(1 - t)), 1


def least_agreement(percent: int, codes: int) -> int:
    """Of so many two-bit codes, those that a pair at the threshold agrees on at least: 7 deviations below the mean, for odds of about 1e-11.

    A code agrees with its coordinate, or by chance (1 in 4) without it.
    """
    q = percent / 100 + (1 - percent / 100) / 4
    return max(0, math.floor(codes * q - DEVIATIONS * math.sqrt(codes * q * (1 - q))))


def _mix32(x: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """pi: a bijection of 32-bit integers, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of one set of 64-bit shingle hashes (not empty): ``size`` 32-bit coordinates."""
    sigma = (B.mix(shingles) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(sigma), 512):
        x = sigma[None, lo : lo + 512] - shift
        np.minimum(best, _mix32(x, np.empty_like(x)).min(axis=1), out=best)
    return best


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text, in order."""
    for c in B.chunks(column):
        data = B.LOWER[c.data]
        words = B.runs(B.NOT_SPACE[data], c.offsets)
        shingles, at = B.window_hash(B.span_hash(data, words.start, words.end), words, k, short=True)
        cut = np.searchsorted(at, words.cut)
        for r in range(c.hi - c.lo):
            yield np.unique(shingles[cut[r] : cut[r + 1]])


def _class(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _features(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    odd = np.random.default_rng(rows).integers(0, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    codes = min(128, bands * rows)
    place = np.uint64(2) * (np.arange(codes, dtype=np.uint64) % np.uint64(32))
    for batch in batches:
        sizes, ids, found, code = [], [], [], []
        for s in _sets(batch.column(1), k):
            sizes.append(len(s))
            ids.append(_class(s))
            if not len(s):
                found.append(None)
                code.append((0, 0, 0, 0))
                continue
            sig = signature(s, bands * rows).astype(np.uint64)
            found.append(B.mix((sig.reshape(bands, rows) * odd).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64))
            two = (sig[:codes] & np.uint64(3)) << place
            code.append(tuple(int(two[i : i + 32].sum(dtype=np.uint64).astype(np.int64)) if i < codes else 0 for i in (0, 32, 64, 96)))
        offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in found])]).astype(np.int32)
        flat = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int64)])
        cols = np.array(code, np.int64).reshape(-1, 4)
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(offsets, flat), *(pa.array(cols[:, i]) for i in range(4))], names=[x.split()[0] for x in _FEATURES.split(", ")])


def _class_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sets of the texts that are of the class wanted of their row."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            wanted = batch.column(1).slice(lo, 512).to_pylist()
            sets = [s for s, w in zip(_sets(batch.column(0).slice(lo, 512), k), wanted, strict=True) if _class(s) == w]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.record_batch([pa.array(map(_class, sets), pa.binary()), pa.ListArray.from_arrays(offsets, flat)], names=["class_id", "shingles"])


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, shingle: int = 5, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: links of texts with ``100 * |A & B| >= percent * |A | B|``."""
    if bands is None or rows is None:
        bands, rows = banding(percent)
    codes = min(128, bands * rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = materialize(map_arrow(texts, partial(_features, k=shingle, bands=bands, rows=rows), _FEATURES), "features")
    known = features.where("class_id is not null and doc_id is not null")
    classes = materialize(known.groupBy("class_id").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), *(F.first(f"c{i}").alias(f"c{i}") for i in range(4))), "classes")
    parts = _parts(texts, classes, percent, shingle, codes)
    if parts is None:
        least = classes.select("class_id", F.col("first_id").alias("component_id"))
    else:
        named = classes.select("class_id", "first_id").join(parts.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
        named = materialize(named, "named")
        smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
        least = named.join(smallest, "component").select("class_id", "component_id")
    out = features.select("doc_id", "n_shingles", "class_id").join(least, "class_id", "left")
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(True)).alias("kept"))


def _parts(texts: DataFrame, classes: DataFrame, percent: int, shingle: int, codes: int) -> DataFrame | None:
    """``node, component`` of every class with a link: first by stars of each bucket, then between their components."""
    band = classes.select("class_id", F.explode("bands").alias("bucket"))
    groups = band.groupBy("bucket").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.count("*").alias("size")).where("low <> high").select("bucket", "size")
    shared = materialize(band.join(groups, "bucket"), "buckets")
    # A class in many large buckets is like the centre of its group: it is the hub of nearly all buckets it is in.
    central = shared.groupBy("class_id").agg(F.sum("size").alias("weight"))
    hub = shared.join(central, "class_id").groupBy("bucket").agg(F.max(F.struct("weight", "class_id"))["class_id"].alias("hub"))
    star = shared.join(hub, "bucket").select(F.col("hub").alias("a"), F.col("class_id").alias("b"))
    first = _verified(_candidates(star, classes, percent, codes), texts, classes, percent, shingle)
    if first is None:
        return None
    parts = materialize(components(first), "parts")
    member = shared.select("bucket", "class_id").join(parts.withColumnRenamed("node", "class_id"), "class_id", "left").select("bucket", "class_id", F.coalesce("component", "class_id").alias("part"))
    member = materialize(member, "members")
    # The commonest component of a bucket; of two members of different components one at least is outside it.
    part = member.groupBy("bucket", "part").count()
    main = part.groupBy("bucket").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("bucket", "main", ((F.col("n") * F.col("n") - F.col("same")) > 2 * LIGHT * F.col("n")).alias("heavy"))
    mixed = materialize(member.join(main, "bucket"), "mixed")
    if mixed.isEmpty():
        return parts
    x, y = mixed.where("not heavy and part <> main").alias("x"), mixed.where("not heavy").alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.part") != F.col("y.part")) & ((F.col("y.part") == F.col("y.main")) | (F.col("x.class_id") < F.col("y.class_id")))).select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"))
    if not mixed.where("heavy").isEmpty():
        pairs = pairs.unionByName(_rare_pairs(mixed.where("heavy").select("class_id", "part").distinct(), texts, classes, percent, shingle))
    more = _verified(_candidates(pairs, classes, percent, codes), texts, classes, percent, shingle)
    # A component stands for its links.
    return parts if more is None else components(parts.toDF("a", "b").unionByName(more))


def _rare_pairs(members: DataFrame, texts: DataFrame, classes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Every pair of ``members(class_id, part)`` of different parts that can reach the threshold.

    Two sets of similarity t share one of the n - ceil(t * n) + 1 rarest shingles of each, in
    one order of all shingles; counted among the members, these lists are short where texts
    differ, so the join is on such a shingle. Nothing is lost and nothing is capped.
    """
    members = materialize(members, "heavy")
    own = _sets_of(classes.select("class_id", "first_id").join(members.select("class_id").distinct(), "class_id"), texts, shingle)
    each = own.select("class_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    ranked = each.join(each.groupBy("s").agg(F.count("*").alias("df")), "s").withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "s")))
    rare = ranked.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("df") > 1)).join(members, "class_id")
    # The first shingle that two sets share leaves at most what follows it in each, so sizes of
    # (100 + percent) * rest >= percent * (n + other size) alone can qualify. A set whose own size is beyond that
    # (it shares only what is common to a family) has no partner of its size and isn't joined at all.
    most = F.floor(((100 + percent) * (1 + F.col("n") - F.col("place")) - percent * F.col("n")) / percent)
    rare = rare.withColumn("most", most).where(100 * F.col("most") >= percent * F.col("n")).select("s", "class_id", "part", "n", "place", "most")
    rare = materialize(rare, "rare")
    # The smaller set of a pair seeks larger ones by bands of sizes, up to what both allow.
    band = lambda c: F.floor(F.log(c) / math.log(BAND)).cast("int")
    end = F.least(F.col("most"), F.floor(100 * F.col("n") / percent))
    x = rare.where("most >= n").withColumn("band", F.explode(F.sequence(band(F.col("n")), band(end) + 1))).alias("x")
    y = rare.withColumn("band", band(F.col("n"))).alias("y")
    fits = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.class_id") < F.col("y.class_id")))
    fits &= (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most")) & (100 * F.col("x.n") >= percent * F.col("y.n"))
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.part") != F.col("y.part")) & fits)
    return pairs.select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).distinct()


def _candidates(pairs: DataFrame, classes: DataFrame, percent: int, codes: int) -> DataFrame:
    """Distinct pairs whose set sizes and signature codes leave the threshold possible, as ``a, b, na, nb`` with a < b, and the first ids of both."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda s: classes.select(F.col("class_id").alias(s), F.col("n").alias(f"n{s}"), F.col("first_id").alias(f"first_{s}"), *(F.col(f"c{i}").alias(f"{s}{i}") for i in range(4)))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    differ = [F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")) for i in range(4)]
    odd = sum((F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555))) for d in differ[1:]), F.bit_count(differ[0].bitwiseOR(F.shiftrightunsigned(differ[0], 1)).bitwiseAND(F.lit(0x5555555555555555))))
    return both.where(F.lit(codes) - odd >= least_agreement(percent, codes)).select("a", "b", "na", "nb", "first_a", "first_b")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, percent: int, shingle: int) -> DataFrame | None:
    """The pairs whose full sets reach the threshold; none: no pair at all."""
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return None
    end = lambda s: pairs.select(F.col(s).alias("class_id"), F.col(f"first_{s}").alias("first_id"))
    sets = _sets_of(end("a").unionByName(end("b")).distinct(), texts, shingle)
    joined = pairs.select("a", "b", "na", "nb").join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return materialize(joined.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b"), "verified")


def _sets_of(wanted: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``class_id, shingles``, once each, of the classes ``wanted(class_id, first_id)``: ids may repeat, so rows of an id may have other classes or the same again."""
    wanted = materialize(wanted.select(F.col("first_id").alias("doc_id"), F.col("class_id").alias("wanted")), "wanted")
    sets = map_arrow(texts.join(small(wanted), "doc_id").select("text", "wanted"), partial(_class_sets, k=shingle), "class_id binary, shingles array<long>")
    return materialize(sets.groupBy("class_id").agg(F.first("shingles").alias("shingles")), "sets")
