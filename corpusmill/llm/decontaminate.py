"""Benchmark decontamination with a broadcast set of normalised item windows (DataFrame functions only).

A-Z are lower-cased and words are runs of ASCII letters, digits and non-ASCII characters.
A window is ``window`` consecutive words of an item; a shorter item is one window. A
window's key is a 64-bit hash of its words. The keys are broadcast; the windows of every
text are hashed and looked up among them, and a hit is verified on its words, so no join
shuffles a text. More than ``BLOCK`` keys (a bound of the broadcast) are looked up in
blocks, one scan of the texts each.

Nulls and blanks: a null or wordless text has no words and no hits; a null or wordless item
has no window. An item without id marks words but isn't counted. Repeated rows and repeated
ids are told apart by id and text together, and all come back. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import materialize, small

#: Keys (about 24 bytes each) in one broadcast.
BLOCK = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The normalised words of a text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")).cast("long")


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows as ``key, win, item_ids`` (as strings)."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).where("size(w) > 0")
    w = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("i"))
    w = w.select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("win")).groupBy("win").agg(F.collect_set("item_id").alias("item_ids"))
    return w.select(F.xxhash64("win").alias("key"), "win", "item_ids")


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Texts with hits: ``doc_id, text_key, hit`` (sorted positions of hit words from 0) and ``item_ids`` (sorted strings)."""
    windows = materialize(item_windows(items, item_id, item_text, window), "windows")
    keys = materialize(windows.select("key").distinct(), "keys")
    # Sizes of windows: ``window`` and those of shorter items, so ``window`` at most.
    sizes = [r[0] for r in windows.select(F.size("win").alias("n")).distinct().orderBy("n").collect()] or [window]
    blocks = max(1, -(-keys.count() // BLOCK))
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), words(text).alias("w")).where(F.size("w") >= sizes[0])
    found = None
    for i in range(blocks):
        part = keys.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i) if blocks > 1 else keys
        for n in sizes:
            seen = base.where(F.size("w") >= n).select("doc_id", "text_key", "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("first"))
            seen = seen.withColumn("key", F.xxhash64(F.slice("w", F.col("first") + 1, n)))
            # A hit takes its words along; texts don't leave this stage.
            hit = seen.join(F.broadcast(part), "key").select("doc_id", "text_key", "first", "key", F.slice("w", F.col("first") + 1, n).alias("seen"))
            found = hit if found is None else found.unionByName(hit)
    hits = materialize(found, "seen").join(small(windows, BLOCK // 10), "key").where(F.col("seen") == F.col("win"))
    hits = hits.select("doc_id", "text_key", "first", F.size("win").alias("n"), "item_ids")
    spread = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))
    found = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "n")).alias("spans"), F.collect_set("item_ids").alias("lists"))
    return found.select("doc_id", "text_key", F.array_sort(F.array_distinct(spread)).alias("hit"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("item_ids"))


def _with_hits(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the columns ``hit`` and ``item_ids`` (null: clean)."""
    hits = small(materialize(hits, "hits")).alias("h")
    d = docs.alias("d")
    same = (F.xxhash64(F.col(f"d.{text_col}").cast("string")) == F.col("h.text_key")) & F.col(f"d.{id_col}").eqNullSafe(F.col("h.doc_id"))
    return d.join(hits, same, "left").select("d.*", F.col("h.hit").alias("__hit"), F.col("h.item_ids").alias("__item_ids"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Every row's ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    hits = find_hits(docs, items, id_col, text_col, item_id, item_text, window)
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _with_hits(counted, hits, "doc_id", "text")
    n_hit = F.when(F.col("__hit").isNull(), F.lit(0)).otherwise(F.size("__hit")).cast("long")
    ids = F.coalesce(F.col("__item_ids"), F.array().cast("array<string>"))
    listed = F.array_join(ids, ",")
    return out.select("doc_id", count_words(F.col("text")).alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` without its hit documents, or (``remove="spans"``) with the hit words cut out; columns as they were."""
    out = _with_hits(docs, find_hits(docs, items, id_col, text_col, item_id, item_text, window), id_col, text_col)
    if remove == "documents":
        return out.where("__hit is null").select(*docs.columns)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    text = F.col(text_col).cast("string")
    # Both arrays are bound once for a text, as elements of an array of one.
    parts = F.array(F.struct(F.split(text, _WORD).alias("gaps"), F.array_remove(F.split(text, _BETWEEN), "").alias("own")))

    def without(x: Column) -> Column:
        n = F.size(x["own"])
        stay = F.when(n > 0, F.array_except(F.sequence(F.lit(0), n - 1), F.col("__hit").cast("array<int>")))
        return F.concat(F.array_join(F.transform(stay, lambda i: F.concat(F.get(x["gaps"], i), F.get(x["own"], i))), ""), F.element_at(x["gaps"], -1))

    cut = F.transform(parts, without)[0]
    return out.withColumn(text_col, F.when(F.col("__hit").isNull(), text).otherwise(cut)).select(*docs.columns)
