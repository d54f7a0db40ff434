"""Text containment joins: which texts hold which patterns, by an inverted index on each pattern's rarest run of words.

A word of a pattern that both sides of the pattern itself bound is a whole word of every text
that holds the pattern, and neighbouring ones are neighbours there. So runs of up to ``RUN``
such words are indexed, each pattern waits at the run that fewest texts have, and only texts
with that run are compared, by exact containment. Runs, not texts, are shuffled; the texts
meet the candidates alone. A pattern without a bounded word (a part of a word, or marks) meets
every text, in blocks of ``BLOCK`` patterns.

Case is ignored. A pattern of no characters, and null patterns, texts and ids, give no rows;
rows that repeat a text id count as texts of their own and their counts are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..shared import materialize, small

#: Words of a run; patterns in one block of the fallback.
RUN, BLOCK = 3, 200
_WORD = r"[\p{L}\p{N}_]+"
_IS_WORD = r"[\p{L}\p{N}_]"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _bounded(needle: Column, whole_words: bool) -> Column:
    """The words of a pattern that are whole words of any text that holds it."""
    w = _words(needle)
    if whole_words:
        return w
    first = F.when(needle.rlike(f"^{_IS_WORD}"), 1).otherwise(0)
    last = F.when(needle.rlike(rf"{_IS_WORD}\z"), 1).otherwise(0)
    return F.slice(w, first + 1, F.greatest(F.size(w) - first - last, F.lit(0)))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _runs(hashes: Column, size: int) -> Column:
    """Hashes of runs of ``size`` neighbours in a column of word hashes; a clash only adds a candidate."""
    n, run = F.size(hashes), hashes
    for k in range(1, size):
        run = F.zip_with(run, F.slice(hashes, k + 1, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    return F.slice(run, 1, F.greatest(n - size + 1, F.lit(0)))


def _counted(text: Column, needle: Column, whole_words: bool) -> tuple[Column, Column]:
    """First place (from 1; 0 if nowhere) and number of the pattern's occurrences side by side."""
    if not whole_words:
        gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
        return F.instr(text, needle), (gone / F.length(needle)).cast("long")
    quoted = F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    left = F.when(needle.rlike(f"^{_IS_WORD}"), f"(?<!{_IS_WORD})").otherwise("")
    right = F.when(needle.rlike(rf"{_IS_WORD}\z"), f"(?!{_IS_WORD})").otherwise("")
    pattern = F.concat(left, quoted, right)
    return F.regexp_instr(text, pattern), F.regexp_count(text, pattern).cast("long")


def contains_join(patterns: DataFrame, texts: DataFrame, whole_words: bool = False) -> DataFrame:
    """``pattern_id, text_id, at, n`` of rows ``pattern_id, pattern`` and ``text_id, text``: first place and number of the occurrences.

    With ``whole_words`` a pattern counts only where no word goes on beyond its ends.
    """
    asked = patterns.select("pattern_id", F.lower("pattern").alias("needle")).where("pattern_id IS NOT NULL AND needle <> ''")
    needles = asked.select("needle").distinct().withColumn("w", _bounded(F.col("needle"), whole_words)).withColumn("size", F.least(F.size("w"), F.lit(RUN)))
    needles = materialize(needles, "needles")
    held = texts.where("text_id IS NOT NULL AND text IS NOT NULL").select("text_id", F.lower("text").alias("text"))

    # Postings of those runs that some pattern has.
    sizes = sorted(r[0] for r in needles.select("size").distinct().collect() if r[0])  # at most RUN rows
    found = None
    if sizes:
        per_size = F.coalesce(*(F.when(F.col("size") == k, _runs(F.col("h"), k)) for k in sizes))
        runs = materialize(needles.where("size > 0").select("needle", "size", _hashes(F.col("w")).alias("h")).select("needle", F.explode(F.array_distinct(per_size)).alias("run")), "runs")
        known = small(runs.select("run").distinct())
        hashed = held.select("text_id", _hashes(_words(F.col("text"))).alias("h"))
        every = F.array_distinct(F.flatten(F.array(*(_runs(F.col("h"), k) for k in sizes))))
        postings = materialize(hashed.select("text_id", F.explode_outer(every).alias("run")).join(known, "run", "left_semi"), "postings")
        common = postings.groupBy("run").agg(F.count("*").alias("texts"))
        # A run that no text has leaves its pattern without candidates.
        rarest = runs.join(common, "run", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "run")).alias("best")).where("best.texts > 0").select("needle", "best.run")
        pairs = materialize(postings.join(small(rarest), "run").select("text_id", "needle").distinct(), "candidates")
        at, n = _counted(F.col("text"), F.col("needle"), whole_words)
        found = held.join(small(pairs), "text_id").select("needle", "text_id", at.alias("at"), n.alias("n"))

    loose = needles.where("size = 0").select("needle")
    blocks = -(-loose.count() // BLOCK)
    for b in range(blocks):
        part = loose if blocks == 1 else loose.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b)
        at, n = _counted(F.col("text"), F.col("needle"), whole_words)
        hit = held.join(F.broadcast(part), F.col("text").contains(F.col("needle"))).select("needle", "text_id", at.alias("at"), n.alias("n"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return asked.join(held, F.lit(False)).select("pattern_id", "text_id", F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))
    found = found.where("at > 0").groupBy("needle", "text_id").agg(F.min("at").alias("at"), F.sum("n").alias("n"))
    return found.join(asked, "needle").select("pattern_id", "text_id", F.col("at").cast("long").alias("at"), "n").distinct()
