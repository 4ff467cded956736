"""Spelling variants: words within one edit of each other, found through an index of variable-length grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.session import cut_lineage

#: Production parameters: least code points of a word, least occurrences, and how many times more often a form must occur.
MIN_LENGTH = 5
MIN_COUNT = 3
DOMINANCE = 2
#: Lengths of grams; words shorter than the longest take grams up to their own length (see ``_merged``).
SHORTEST, LONGEST = 2, 8
#: A gram is frequent, and extended, if it makes up more than this share of all grams of its length. So at most so many are frequent at a length, whatever the corpus.
FREQUENT = 5_000
#: Different grams that a task holds before it passes their counts on.
_HELD = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "[A-Za-zÀ-ÿ]+"
_BEGIN, _END = "^", "$"  # no letters, so no word has them


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every maximal run of letters of every whole text, A-Z lower-cased; null and empty texts have none."""
    each = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))).alias("run"))
    # Most runs are lower case: only others are translated character by character.
    return each.select("doc_id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))


def with_slips(words: DataFrame, one_in: int = 97) -> DataFrame:
    """(word): the runs, of which one in ``one_in`` lacks a code point, both chosen by the crc32 of ``<doc_id>:<run>``; a null doc_id is written as nothing."""
    crc = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return words.select("run", crc.alias("h")).select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word"))


def counted_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points that occur at least ``min_count`` times; occurrences are added before the shuffle."""
    long_enough = words.filter(F.length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def frequent_grams(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT) -> dict[str, int]:
    """The grams of SHORTEST to ``longest`` - 1 characters that are frequent, with their counts: the inner nodes of the gram dictionary.

    A gram is frequent if it occurs more than once in ``frequent`` grams of its length; those fewer than ``frequent`` rows a length come to the driver.
    """
    lengths = range(SHORTEST, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                marked = f"{_BEGIN}{word}{_END}"
                for size in lengths:
                    seen.update([marked[p : p + size] for p in range(len(marked) - size + 1)])
                if len(seen) >= _HELD:
                    yield flush(seen)
                    seen = Counter()
        yield flush(seen)

    if not lengths:
        return {}
    counts = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.withColumn("size", F.length("gram")), "gram-counts")
    totals = counts.groupBy("size").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "size").filter(F.col("n") * frequent > F.col("total"))
    return {row["gram"]: row["n"] for row in kept.select("gram", "n").collect()}


def _decomposed(word: str, extended: dict[str, int], longest: int) -> list[tuple[int, str, int]]:
    """A word's variable grams (rank, gram, place).

    At each place stands the shortest gram that the dictionary does not extend: it grows while it is frequent, up to ``longest``. The choice depends on the
    gram's own characters only, so an edit outside a gram leaves it as it is.
    """
    marked = f"{_BEGIN}{word}{_END}"
    grams = []
    for p in range(len(marked) - SHORTEST + 1):
        size = SHORTEST
        gram = marked[p : p + size]
        while size < longest and gram in extended and p + size < len(marked):
            size += 1
            gram = marked[p : p + size]
        grams.append((extended.get(gram, 0), gram, p))
    return grams


def _merged(word: str, extended: dict[str, int], longest: int) -> list[tuple[int, str, int]]:
    """The word's rarest grams, as many as it takes until no single edit can affect all of them.

    An edit of a character affects just the grams that hold it, and an insertion between two those that hold both; so one edit affects all chosen grams
    only while some letter lies in each. A word of m characters has m + 1 grams, and no letter lies in more than ``longest``: as long as that is at most m, the choice ends.
    """
    chosen, low, high = [], 1, len(word) + 1
    for rank, gram, p in sorted(_decomposed(word, extended, longest)):
        chosen.append((rank, gram, p))
        low, high = max(low, p), min(high, p + len(gram))
        if low >= high:
            break
    return chosen


def _postings(words: DataFrame, extended: dict[str, int], longest: int) -> DataFrame:
    """(word, n, gram, at, size, shorter, longer): the rarest grams of every word (see ``_merged``), each with its place and the word's length.

    Two words one edit apart share all grams that the edit does not affect. In the one order of all grams (frequent ones last) the first gram they share is
    among the chosen ones of either word, as the edit spares one of these; so merging the lists of chosen grams finds every pair, and the others are skipped.
    Both words of a pair must cut grams alike, up to the length of the shorter one: rows marked ``shorter`` meet words of equal length or one longer, those
    marked ``longer`` words that are one shorter. Where both cuts agree, rows have both marks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            counts = batch.column("n").to_pylist()
            for k, word in enumerate(batch.column("word").to_pylist()):
                cuts = [(longest, True, True)] if len(word) > longest else [(len(word), True, False), (len(word) - 1, False, True)]
                for most, shorter, longer in cuts:
                    for _, gram, at in _merged(word, extended, most):
                        for column, value in zip(out, (k, gram, at, len(word), shorter, longer)):
                            column.append(value)
            rows = pa.array(out[0], pa.int32())
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
            columns = [pa.array(values, kind) for values, kind in zip(out[1:], kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word").take(rows), pa.array([counts[k] for k in out[0]], pa.int64()), *columns], ["word", "n", "gram", "at", "size", "shorter", "longer"]
            )

    return words.select("word", "n").mapInArrow(run, "word string, n long, gram string, at int, size int, shorter boolean, longer boolean")


def near_words(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT) -> DataFrame:
    """(a, a_n, b, b_n): each unordered pair of words (word, n) that differ by one inserted, deleted or replaced code point, once.

    Words have two or more code points and come once each. A shared gram that the edit spares stands at the same place in words
    of equal length, and at the same or the next place in a word that is one longer; lists are kept by gram, place and length, so they hold only words that can pair.
    Every pair that meets is verified in the join; a list that is much longer than others is split by adaptive execution. Nothing is capped.
    """
    postings = cut_lineage(_postings(words, frequent_grams(words, longest, frequent), longest), "gram-postings")
    size, at = F.col("size"), F.col("at")

    def keyed(rows: DataFrame, name: str, size: Column, at: Column) -> DataFrame:
        return rows.select(F.xxhash64("gram", size, at).alias("key"), F.col("word").alias(name), F.col("n").alias(f"{name}_n"))

    one = F.levenshtein("a", "b", 1) == 1
    short = postings.filter("shorter")
    equal = keyed(short, "a", size, at).join(keyed(short, "b", size, at), "key").filter((F.col("a") < F.col("b")) & one)
    moved = short.withColumn("there", F.explode(F.array(at, at + 1)))
    unequal = keyed(moved, "a", size + 1, F.col("there")).join(keyed(postings.filter("longer"), "b", size, at), "key").filter(one)
    columns = ["a", "a_n", "b", "b_n"]
    return equal.select(*columns).unionAll(unequal.select(*columns)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: the end of its chain of forms.

    Each step jumps from a word's root to that root's own, so a chain of m words takes log2 m rounds; along a chain counts grow by ``DOMINANCE`` at least, which bounds m.
    """
    jumps = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = cut_lineage(jumps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if jumped.filter("moved").isEmpty():
            return jumped.select("word", "root")
        jumps = jumped.select("word", "root")


def spelling_groups(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n; each word once, of two or more code points).

    ``form`` is the near word (see ``near_words``) of largest n, of several the first in code-point order, if it occurs at least ``dominance`` times as often (2 or more, else
    chains may not end); else null, and ``form_n`` too. ``root`` is the end of the chain of forms, the word itself without one. An empty table gives no rows.
    """
    if dominance < 2:
        raise ValueError("a form must occur at least twice as often")
    words = cut_lineage(words.select("word", "n"), "words")
    pairs = cut_lineage(near_words(words), "near-words")
    either = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    either = either.unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = either.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    largest = -F.col("best.less")
    chosen = largest >= dominance * F.col("n")
    formed = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, largest).alias("form_n")
    )
    formed = cut_lineage(formed, "forms")
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_spelling(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """The groups (see ``spelling_groups``) of the words of whole texts of ``docs`` (doc_id, text, any others), slips included (see ``with_slips``).

    Null and empty texts have no words, an empty table gives no rows; repeated rows count as often as they come.
    """
    return spelling_groups(counted_words(with_slips(runs(docs)), max(min_length, SHORTEST), min_count))
