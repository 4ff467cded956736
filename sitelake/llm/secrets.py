"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers. Native expressions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sitelake.functions.text import bind
from sitelake.llm.labelled import bounded_sample
from sitelake.session import cut_lineage

# The patterns of the three kinds. An access key has 20 characters or more, a hex string 24: a shorter run of their characters
# has no match within it either, so the length stands in the pattern. What is assigned must have 6, which is tested after matching.
KINDS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
_ASSIGNED = 6
#: What the models judge: strings of at least 16 characters of this alphabet; "=" only ends them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RANDOM = "random"
_CANDIDATES = r"[A-Za-z0-9+/_-]{16,}+=*+"
#: Production parameters: nats by which the random model must be likelier, in all and for each character, least different characters, and documents that
#: labelled samples are drawn from.
THRESHOLD = 12.0
PER_CHARACTER = 0.8
VARIETY = 7
SAMPLE = 2_000
MASK = "[SECRET]"


def _pairs(text: Column) -> Column:
    """The transitions of a string: its first character after the start sign, then each two in a row."""
    after = F.split(text, "")
    return F.zip_with(F.concat(F.array(F.lit("^")), after), F.concat(after, F.array(F.lit(""))), lambda a, b: F.concat(a, b))


def train_markov(samples: DataFrame) -> dict[str, float]:
    """Log-likelihood ratio, random against ordinary, of each transition of two characters.

    ``samples`` has text and label (1: random string, 0: ordinary identifier). Transitions are counted in Spark; half a count is added to each of the 67 that a
    character may have. Characters beyond the alphabet, null and empty texts are left out; a transition unseen under a label keeps its
    smoothed probability. Without samples of both labels every ratio is that of the smoothing.
    """
    clean = F.regexp_replace("text", "[^A-Za-z0-9+/_=-]", "")
    strings = samples.filter(F.col("label").isin(0, 1)).select("label", clean.alias("t")).filter(F.length("t") > 0)
    # Equal strings are taken apart once.
    strings = strings.groupBy("label", "t").agg(F.count(F.lit(1)).alias("n"))
    pairs = strings.select("label", "n", F.explode(_pairs(F.col("t"))).alias("pair")).filter(F.length("pair") == 2)
    counted = pairs.groupBy("label", "pair").agg(F.sum("n").alias("n"))
    count = {(r["label"], r["pair"]): r["n"] for r in counted.collect()}  # at most 2 * 68 * 67 rows
    ratio = {}
    for before in "^" + ALPHABET:
        total = {label: sum(count.get((label, before + c), 0) for c in ALPHABET) + len(ALPHABET) / 2 for label in (0, 1)}
        for c in ALPHABET:
            p = {label: (count.get((label, before + c), 0) + 0.5) / total[label] for label in (0, 1)}
            ratio[before + c] = math.log(p[1] / p[0])
    return ratio


def labelled_strings(docs: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(text, label): labelled samples drawn from at most ``limit`` documents, those whose ids hash lowest.

    Random strings are digests of the texts in the alphabets that keys come in (hex, upper hex, base 64 and its variant for URLs). Ordinary identifiers are
    the texts' words, alone and joined as names in programs and addresses are, with numbers and without; paths, versions and plain numbers; dates and times as
    they stand in names of files; and rules, that is repeated signs and letters.
    """
    chosen = bounded_sample(docs, limit)
    split = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " "), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9a-f]+$"))
    # Written, so that the words are cut once and not again for each use of one.
    chosen = cut_lineage(chosen.select("text", F.sha2("text", 256).alias("digest"), F.sha1("text").alias("short"), split.alias("words")), "labelled-strings")
    coded = F.base64(F.unhex("digest"))
    random = F.array("digest", "short", F.upper("short"), coded, F.translate(coded, "+/=", "-_"), F.base64(F.unhex("short")))
    joined = [F.transform("words", lambda w, i: F.concat(w, F.lit(sign), F.get("words", i + 1))) for sign in "_-/"]
    camel = F.transform("words", lambda w, i: F.concat(F.lower(w), F.initcap(F.get("words", i + 1))))
    upper = F.transform("words", lambda w, i: F.upper(F.concat(w, F.lit("_"), F.get("words", i + 1))))
    paths = F.transform("words", lambda w, i: F.concat(F.lit("/"), F.lower(w), F.lit("/"), F.lower(F.get("words", i + 1))))
    # Words with numbers of one to four digits, as in names, versions and addresses; each word in one of these forms.
    forms = [("", 1, "/"), ("", 2, "_"), ("-", 2, "-"), ("_", 4, "/"), ("", 3, "-"), ("", 2, "")]
    sign, size, after = (F.array(*[F.lit(v) for v in values]) for values in zip(*forms))

    def numbered(w: Column, i: Column) -> Column:
        k = i % len(forms)
        digits = F.substring(F.abs(F.xxhash64("text", i)).cast("string"), F.lit(1), F.get(size, k))
        return F.concat(F.lower(w), F.get(sign, k), digits, F.get(after, k), F.lower(F.get("words", i + 1)))

    numbers = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.abs(F.xxhash64("text", i)).cast("string"))
    # A moment of the years 1970 to 2100 a pattern, from the text's hash.
    patterns = ("yyyy-MM-dd'T'HH-mm-ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd_HHmmss", "yyyyMMdd'T'HHmmss'Z'", "yyyy-MM-dd_HH-mm-ss")
    moments = F.array(*[F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64("text", F.lit(p)), F.lit(4_102_444_800))), p) for p in patterns])
    ordinary = F.filter(F.concat("words", *joined, camel, upper, paths, F.transform("words", numbered), numbers, moments), lambda w: w.isNotNull())
    rules = chosen.sparkSession.createDataFrame([(c * 32,) for c in ALPHABET], "text string").select("text", F.lit(0).alias("label"))
    either = [chosen.select(F.explode(texts).alias("text"), F.lit(label).alias("label")) for texts, label in ((random, 1), (ordinary, 0))]
    return either[0].unionAll(either[1]).unionAll(rules)


def _score(text: Column, ratio: dict[str, float]) -> Column:
    """The log-likelihood ratio of a string of the alphabet, in one pass over its characters."""
    table = F.from_json(F.lit(json.dumps([ratio[a + b] for a in "^" + ALPHABET for b in ALPHABET])), "array<double>")
    places = F.lit("^" + ALPHABET)

    def step(state: Column, c: Column) -> Column:
        at = F.instr(places, c)
        return F.struct(at.alias("before"), (state["sum"] + F.get(table, (state["before"] - 1) * len(ALPHABET) + at - 2)).alias("sum"))

    start = F.struct(F.lit(1).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(text, ""), start, step, lambda state: state["sum"])


def _is_random(found: Column, ratio: dict[str, float], threshold: float) -> Column:
    """Whether a candidate is likelier random by enough, in all and a character, and has characters enough that differ.

    The likelihood is computed once a candidate; candidates of few different characters (rules, paddings) are not scored.
    """
    varied = F.size(F.array_distinct(F.split(found, ""))) >= VARIETY
    return F.when(varied, _score(found, ratio) >= F.greatest(F.lit(threshold), F.length(found) * PER_CHARACTER)).otherwise(False)


def _kept(kind: str, found: Column, ratio: dict[str, float], threshold: float) -> Column:
    """Whether a match of the kind's pattern is a finding."""
    if kind == RANDOM:
        return _is_random(found, ratio, threshold)
    return F.length(F.regexp_extract(found, KINDS[kind], 2)) >= _ASSIGNED if kind == "assign" else F.lit(True)


_MATCHES = "array<struct<kind:string,rank:int,gap:int,length:int,kept:boolean>>"


def _matches(text: Column, ratio: dict[str, float], threshold: float) -> Column:
    """All matches of the kinds that have a finding in the text: (kind, rank, gap since the last match of the kind, length, kept).

    Matches are judged once; the text is cut at them only where one is a finding.
    """
    parts = []
    for rank, kind in enumerate([*KINDS, RANDOM]):
        pattern = KINDS.get(kind, _CANDIDATES)
        judged = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda m: F.struct(F.length(m).alias("length"), _kept(kind, m, ratio, threshold).alias("kept")),
        )

        def placed(found: Column) -> Column:
            each = F.zip_with(
                F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1))),
                found,
                lambda gap, m: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.length(gap).alias("gap"), m["length"].alias("length"), m["kept"].alias("kept")),
            )
            return F.when(F.exists(found, lambda m: m["kept"]), each).otherwise(F.array().cast(_MATCHES))

        parts.append(bind(judged, placed))
    return F.concat(*parts)


def _spans(rows: DataFrame) -> DataFrame:
    """(uid, kind, rank, start, end) of the findings of rows (uid, matches).

    Where a match begins is the sum of the gaps and matches before it, taken over the rows of one text and kind; a text's matches are one group, so its
    size bounds the group. A random string inside a fixed finding is no finding of its own.
    """
    each = rows.select("uid", F.posexplode("matches").alias("at", "m")).select("uid", "at", "m.*").repartition("uid")
    before = Window.partitionBy("uid", "rank").orderBy("at")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before)).withColumn("start", F.col("end") - F.col("length")).filter("kept")
    earlier = Window.partitionBy("uid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = F.max(F.when(F.col("kind") != RANDOM, F.col("end"))).over(earlier)
    placed = placed.withColumn("covered", (F.col("kind") == RANDOM) & (F.coalesce(fixed, F.lit(-1)) >= F.col("end")))
    return placed.filter("not covered").select("uid", "kind", "rank", "start", "end")


def find_secrets(docs: DataFrame, ratio: dict[str, float], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text, any others): spans are (start, rank, end, kind), by start, then kind.

    Kinds ``assign``, ``access`` and ``hex`` come from fixed patterns, leftmost and without overlap within a kind; ``random`` are strings of at least 16
    characters of ``ALPHABET``, ``VARIETY`` of them different, that the random model makes likelier than the ordinary one by ``threshold`` nats and by
    ``PER_CHARACTER`` nats a character, unless a fixed finding holds them.
    Places count code points from 0, the end is exclusive. Null and empty texts have an empty array. Repeated rows and null ids
    give a row each. Texts are read whole and do not leave their task: only lengths of matches are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", _matches(text, ratio, threshold).alias("matches"))
    rows = cut_lineage(rows, "secret-matches")
    spans = _spans(rows.filter(F.size("matches") > 0)).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return rows.select("uid", "doc_id").join(spans, "uid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def redact_secrets(docs: DataFrame, ratio: dict[str, float], threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """``docs`` with each run of overlapping findings (see ``find_secrets``) replaced by ``mask``; all columns and rows stay.

    Texts without findings pass in place; of the others each row goes through one shuffle with its spans. Null texts stay null. Rows are
    written with what was found in them, as both kinds are read from there: the search runs once.
    """
    columns = docs.columns
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    tagged = cut_lineage(docs.select(F.struct(*quoted).alias("row"), _matches(text, ratio, threshold).alias("matches")), "scanned")
    clean = tagged.filter(F.size("matches") == 0).select("row.*")
    found = tagged.filter(F.size("matches") > 0).withColumn("uid", F.monotonically_increasing_id()).select("uid", "row", "matches")
    found = cut_lineage(found, "secret-rows")
    # Overlapping findings are one stretch: a stretch begins where no earlier finding reaches.
    order = Window.partitionBy("uid").orderBy("start", "rank")
    spans = _spans(found.select("uid", "matches"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stretch = spans.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")).withColumn("stretch", F.sum("new").over(order))
    merged = stretch.groupBy("uid", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    body = F.col("row.text")
    kept = F.transform(
        F.sequence(F.lit(0), F.size("cuts")),
        lambda i: F.substring(
            body,
            F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0)).cast("int") + 1,
            (F.coalesce(F.get("cuts", i)["start"], F.length(body)) - F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0))).cast("int"),
        ),
    )
    masked = found.join(cuts, "uid").select(*[F.array_join(kept, mask).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns])
    return clean.unionByName(masked)
