"""Line deduplication: later copies of repeated runs of lines are deleted.

A document is a sequence of lines; lines without a word are no part of it.  The suffix array of all
sequences is built by distributed prefix doubling: the rank of a suffix by its first 2h lines follows
from the ranks of two suffixes by their first h lines, sorted as pairs.  Suffixes of equal rank at
depth h are the intervals whose longest common prefix is h lines or more; doubling goes on until no
two suffixes share a prefix.  In each interval the copy that comes first (by id, then place) stays.

A maximal repeated run begins at a place whose first ``min_lines`` lines stand earlier, unless the run
of the place before goes on there (its first copy is the place before this one's).  It is as long as
the longest common prefix of its suffix and that of its first copy, found in the array by descending
depths: where both have the same rank at a depth, they share that many lines more.  Whole runs are
deleted, and so are shorter ones that hold ``min_words`` words; what overlaps is deleted once.

Only repeated suffixes stay active: a suffix whose first h lines stand once is dropped, since no
longer prefix of it can repeat.  Ranks are given to the distinct pairs, which are counted with
map-side combining before anything is sorted, so a line that stands in a third of all documents is
one row there; joins that bring ranks back to the suffixes are sort-merge joins, split by adaptive
execution where one rank is hot.  Every round, its pairs of ranks too, is written to the shared folder
before it is read a second time, so that no join or count is run twice.

Null and empty texts have no lines and stay as they are.  Rows with the same id and text count as
one document; of copies with equal ids the order of a hash decides.  Null ids come last in the order.
Very long texts take more rounds, as the logarithm of their longest repeated run.  The empty table
gives an empty result.  Clashing column names do no harm: all names used here begin with two
underscores.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import discard, written

MIN_LINES = 3
MIN_WORDS = 50  # of a repeated run of fewer lines
MIN_LEFT = 2.0**-64  # of its words, that is any word: only documents without a word of their own go
KEY = ["__a", "__b"]
_SPACES = " \t\x0b\f\r"


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a 128-bit key of id and text."""
    i, t = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.withColumns({"__a": F.xxhash64(i, i.isNull(), t), "__b": F.xxhash64(t, F.lit("line"), i, i.isNull())})


def _suffixes(docs: DataFrame) -> DataFrame:
    """(key, __id, __pos, __len, __r): place in the sequence, characters and hash of the line."""
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(x).cast("long").alias("len"), F.when(F.length(F.translate(x, _SPACES, "")) > 0, F.xxhash64(x)).alias("id"))),
        lambda s: s["id"].isNotNull(),
    )
    rows = _keyed(docs).where("text is not null").select(*KEY, F.col("doc_id").cast("long").alias("__id"), lines.alias("__lines"))
    rows = rows.where(F.size("__lines") > 0).dropDuplicates(KEY)
    return rows.select(*KEY, "__id", F.posexplode("__lines").alias("__pos", "__x")).select(*KEY, "__id", "__pos", F.col("__x.len").alias("__len"), F.col("__x.id").alias("__r"))


def _ranked(active: DataFrame, pair: list[str]) -> DataFrame:
    """Suffixes of ``active`` (written) whose ``pair`` repeats, with its rank among all pairs and the first
    copy.  The pairs are written before they are ordered: drawing the bounds of ranges would count them
    once more.  ``active`` is deleted."""
    place = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), *[F.col(k).alias(k) for k in KEY], F.col("__pos").alias("p"))
    pairs = written(active.groupBy(*pair).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__first")).where("__n > 1").drop("__n"))
    ranks = pairs.orderBy(*pair).select(*pair, F.monotonically_increasing_id().alias("__rank"), "__first")
    out = written(active.join(ranks, pair).drop(*pair).withColumnRenamed("__rank", "__r"))
    discard(active, pairs)
    return out


def _doubled(active: DataFrame, ahead: int) -> DataFrame:
    """Ranks by two windows, one beginning ``ahead`` lines after the other.  The windows overlap, if at
    all, so the characters of the second count from where the first ends."""
    later = active.select(*KEY, (F.col("__pos") - ahead).alias("__pos"), F.col("__r").alias("__r2"), F.col("__len").alias("__len2"))
    both = active.drop("__first").join(later, [*KEY, "__pos"]).withColumn("__len", F.col("__len") + F.col("__len2")).drop("__len2")
    return _ranked(written(both), ["__r", "__r2"])


def suffix_array(docs: DataFrame, min_lines: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """(depth, repeated suffixes) for every depth up to ``min_lines`` and from there doubling, until
    nothing is repeated: the rank ``__r`` among all prefixes of that depth and the interval's first
    copy.  ``__len`` is no less than the characters of the prefix."""
    levels = [(1, _ranked(written(_suffixes(docs)), ["__r"]))]
    while True:
        depth, active = levels[-1]
        ahead = 1 if depth < min_lines else depth
        deeper = _doubled(active, ahead)
        if deeper.isEmpty():
            return levels
        levels.append((depth + ahead, deeper))


def _first() -> Column:
    return F.struct(*[F.col(f"__first.{k}").alias(k) for k in KEY], F.col("__first.p").alias("__pos"))


def maximal_runs(levels: list[tuple[int, DataFrame]], min_lines: int = MIN_LINES) -> DataFrame | None:
    """(key, __pos, __from, __n), written: where a maximal repeated run begins, the id of its first copy
    and its lines.  None if nothing of ``min_lines`` lines is repeated."""
    base = dict(levels).get(min_lines)
    if base is None:
        return None
    later = base.select(*KEY, "__pos", F.col("__first.i").alias("__from"), _first().alias("__f")).where(F.col("__f") != F.struct(*KEY, "__pos"))
    before = Window.partitionBy(*KEY).orderBy("__pos")
    goes_on = (F.lag("__pos").over(before) == F.col("__pos") - 1) & (
        F.lag("__f").over(before) == F.struct(*[F.col(f"__f.{k}") for k in KEY], (F.col("__f.__pos") - 1).alias("__pos"))
    )
    starts = later.withColumn("__on", F.coalesce(goes_on, F.lit(False))).where("not __on").drop("__on")
    runs = written(starts.withColumns({"__run": F.monotonically_increasing_id(), "__n": F.lit(0)}))
    for depth, level in reversed(levels):
        places = F.array(*[F.struct(*[F.col(at + k).alias(k) for k in KEY], (F.col(at + "__pos") + F.col("__n")).alias("__pos")) for at in ("", "__f.")])
        asked = runs.select("__run", F.explode(places).alias("x")).select("__run", *[F.col(f"x.{k}") for k in (*KEY, "__pos")])
        ranks = asked.join(level.select(*KEY, "__pos", "__r"), [*KEY, "__pos"]).groupBy("__run")
        alike = ranks.agg((F.count("__r") == 2).alias("__two"), (F.min("__r") == F.max("__r")).alias("__same")).where("__two and __same").select("__run", F.lit(depth).alias("__more"))
        longer = runs.join(alike, "__run", "left").withColumn("__n", F.col("__n") + F.coalesce("__more", F.lit(0))).drop("__more")
        runs = written(longer)
    return runs.select(*KEY, "__pos", "__from", "__n")


def doomed(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, __starts, __runs, __longest): sequence positions where later copies begin with their lines,
    the number of maximal runs, and the longest of them: its lines and its first copy's id (of equally
    long ones the first in the document)."""
    levels = suffix_array(docs, min_lines)
    found = maximal_runs(levels, min_lines)
    for depth, level in levels:
        if depth < min_lines:  # of few lines, only those long enough to hold that many words
            later = level.where(_first() != F.struct(*KEY, "__pos")).where(F.col("__len") >= 2 * min_words - depth)
            one = later.select(*KEY, "__pos", F.lit(None).cast("long").alias("__from"), F.lit(depth).alias("__n"))
            found = one if found is None else found.unionAll(one)
    whole = F.col("__n") >= min_lines
    longest = F.max(F.when(whole, F.struct(F.col("__n").alias("n"), (-F.col("__pos")).alias("at"), F.col("__from").alias("source"))))
    starts = F.collect_list(F.struct(F.col("__pos").alias("p"), F.col("__n").alias("d")))
    return found.groupBy(*KEY).agg(starts.alias("__starts"), F.count_if(whole).alias("__runs"), longest.alias("__longest"))


RESULT = "struct<text:string,n_lines:int,n_removed:int,longest_run:int,left:double>"


def _words(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass").split())


def _rewrite(min_lines: int, min_words: int) -> Column:
    @F.pandas_udf(RESULT)
    def rewrite(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for text, at in zip(texts, starts, strict=True):
            if not isinstance(text, str):
                out.append((None, 0, 0, 0, 1.0))
                continue
            lines = text.split("\n")
            sequence = [k for k, x in enumerate(lines) if x.strip(_SPACES)]
            gone: list[int] = []
            run = longest = upto = 0
            for p, d in sorted((s["p"], s["d"]) for s in at) if at is not None else ():
                if d < min_lines and sum(_words(lines[k]) for k in sequence[p : p + d]) < min_words:
                    continue
                run = run if p <= upto else 0
                new = range(max(p, upto), p + d)
                gone += new
                run += len(new)
                longest, upto = max(longest, run), max(upto, p + d)
            if not gone:
                out.append((text, len(sequence), 0, 0, 1.0))
                continue
            dead = {sequence[k] for k in gone}
            kept = [x for k, x in enumerate(lines) if k not in dead]
            words = _words(text)
            out.append(("\n".join(kept), len(sequence), len(gone), longest, sum(map(_words, kept)) / max(1, words)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed", "longest_run", "left"])

    return rewrite(F.col("text"), F.col("__starts"))


def _with_result(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    typed = docs.withColumn("text", F.col("text").cast("string"))
    return _keyed(typed).join(doomed(typed, min_lines, min_words), KEY, "left").withColumn("__new", _rewrite(min_lines, min_words))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, longest_run, left, kept_text, n_runs, longest_copy, copied_from) per
    document: ``longest_run`` is the longest stretch of deleted lines, which may join several runs;
    ``n_runs`` the maximal repeated runs that stand earlier, ``longest_copy`` the lines of the longest of
    them (0 without any) and ``copied_from`` the document of its first copy."""
    got = _with_result(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_lines, min_words)
    copies = [F.coalesce("__runs", F.lit(0)).alias("n_runs"), F.coalesce(F.col("__longest.n").cast("long"), F.lit(0)).alias("longest_copy"), F.col("__longest.source").alias("copied_from")]
    return got.select("doc_id", "__new.n_lines", "__new.n_removed", "__new.longest_run", "__new.left", F.col("__new.text").alias("kept_text"), *copies)


def clean(docs: DataFrame, min_lines: int = MIN_LINES, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns, with later copies deleted from the texts; documents of whose words
    less than ``min_left`` are left go altogether, and ``n_chars`` follows the text."""
    got = _with_result(docs, min_lines, min_words).where(F.col("__new.left") >= min_left)
    cols = [F.col("__new.text").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    out = got.select(*cols)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
