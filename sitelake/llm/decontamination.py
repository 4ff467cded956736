"""Benchmark decontamination by templates: typed placeholders, joined template windows, consistent slots. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sitelake.session import cut_lineage

#: Production parameters: tokens in a window, least share of an item's windows, least tokens in a row.
WINDOW = 5
SHARE = 0.8
RUN = 13
#: A window needs so many tokens that are no placeholders.
LITERALS = 2
#: Benchmark windows up to this number (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000

# Placeholders are characters of the private use area; those in a text itself are removed first. Signs and the numbers of measures
# have their own until values have been found, then count as units and numbers.
_NAME, _NUMBER, _UNIT, _SIGN, _AMOUNT = (chr(0xE000 + i) for i in range(5))
_ALL = _NAME + _NUMBER + _UNIT + _SIGN + _AMOUNT
_TYPED = _NAME + _NUMBER + _UNIT + _UNIT + _NUMBER
# Words taken for units after a number, and signs taken for units before one.
_UNITS = (
    "%|percent|km|kilometers?|kilometres?|m|meters?|metres?|cm|centimeters?|centimetres?|mm|millimeters?|millimetres?|miles?|yards?|yd|feet|foot|ft|"
    "inch(?:es)?|kg|kilograms?|g|grams?|mg|milligrams?|tons?|tonnes?|pounds?|lbs?|ounces?|oz|liters?|litres?|ml|milliliters?|gallons?|"
    "seconds?|secs?|minutes?|mins?|hours?|hrs?|h|days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|mph|kmh|kph|hz|khz|mhz|ghz|"
    "kw|kwh|volts?|watts?|joules?|kb|mb|gb|tb|bytes?|bits?|degrees?|°[CF]?"
)
_SIGNS = "[$€£¥](?= ?\\p{Nd})"
# A capitalised word inside a sentence, with those that follow it.
_NAMES = "(?<=[\\p{L}\\p{N},;:)] )\\p{Lu}[\\p{L}'’-]*+(?: \\p{Lu}[\\p{L}'’-]*+)*+"
_DIGITS = "(?<![\\p{L}\\p{N}])\\p{Nd}++(?:[.,:/]\\p{Nd}++)*+"
_MEASURES = f"({_DIGITS})[ -]?((?i:{_UNITS}))(?![\\p{{L}}\\p{{N}}])"
_NUMBERS = f"{_DIGITS}(?![\\p{{L}}\\p{{N}}])"
#: Items of fewer tokens match only texts that consist of them: so short a phrase inside a text is no sign of the item.
SHORTEST = 3
#: Diagonals (place in the text less place in the item) no further apart belong to one occurrence: so many tokens may have been put in or left out.
SLACK = 4
#: A text and a benchmark class; ``part`` tells texts under one doc_id apart.
_PAIR = ["doc_id", "part", "class"]
_TOKENS = f"[{_ALL}]|[\\p{{L}}\\p{{N}}]++"


def _steps(text: Column) -> list[Column]:
    """The text before names, signs, measures and numbers are replaced, in turn, and after all of it."""
    raw = F.translate(F.coalesce(text, F.lit("")), _ALL, "")
    named = F.regexp_replace(raw, _NAMES, _NAME)
    signed = F.regexp_replace(named, _SIGNS, f"{_SIGN} ")
    measured = F.regexp_replace(signed, _MEASURES, f"{_AMOUNT} {_UNIT}")
    return [raw, named, signed, measured, F.regexp_replace(measured, _NUMBERS, _NUMBER)]


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKENS), F.lit(0))


def template(text: Column) -> Column:
    """The tokens of a text in lower case, with names, numbers and units as typed placeholders. Null gives no tokens."""
    return _tokens(F.translate(_steps(text)[-1], _ALL, _TYPED))


def slots(text: Column) -> Column:
    """The values behind the placeholders of ``template``: an array of (pos, value), by ``pos``, the place among the tokens."""
    raw, named, signed, measured, whole = _steps(text)
    tokens = _tokens(whole)
    values = {
        _NAME: F.regexp_extract_all(raw, F.lit(_NAMES), F.lit(0)),
        _SIGN: F.regexp_extract_all(named, F.lit(_SIGNS), F.lit(0)),
        _AMOUNT: F.regexp_extract_all(signed, F.lit(_MEASURES), F.lit(1)),
        _UNIT: F.regexp_extract_all(signed, F.lit(_MEASURES), F.lit(2)),
        _NUMBER: F.regexp_extract_all(measured, F.lit(_NUMBERS), F.lit(0)),
    }
    found = []
    for mark, kind in zip(_ALL, _TYPED):
        # The k-th placeholder of a kind stands for the k-th match of its pattern.
        places = F.filter(F.transform(tokens, lambda t, i: F.when(t == mark, i)), lambda i: i.isNotNull())
        found.append(F.zip_with(places, values[mark], lambda p, v: F.struct(p.alias("pos"), F.concat(F.lit(kind), F.lower(v)).alias("value"))))
    return F.array_sort(F.concat(*found))


def _windows(tokens: Column, n: int) -> Column:
    """A hash of each n tokens in a row; null for fewer tokens."""
    each = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.xxhash64(F.lit(n), *[F.get(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) >= n, each)


def _own_windows(tokens: Column, n: int) -> Column:
    """The windows of an item: those of n tokens, or one of all tokens where there are fewer."""
    return F.coalesce(*[_windows(tokens, k) for k in range(n, 0, -1)])


def _benchmark(benchmark: DataFrame, n: int) -> DataFrame:
    """(class, item_id, items, tokens, slots) of each different pair of template and pattern of equal slots; ``item_id`` is the least of ``items``."""
    parsed = benchmark.select("item_id", template(F.col("text")).alias("tokens"), slots(F.col("text")).alias("slots")).filter(F.size("tokens") > 0)
    pattern = F.transform("slots", lambda s: F.array_position(F.transform("slots", lambda x: x["value"]), s["value"]))
    classes = parsed.withColumn("pattern", pattern).groupBy("tokens", "pattern")
    return classes.agg(F.min(F.struct("item_id", "slots")).alias("least"), F.array_sort(F.collect_set("item_id")).alias("items")).select(
        F.xxhash64("tokens", "pattern").alias("class"), "least.item_id", "items", "tokens", "least.slots"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """A row for each document and benchmark item that it holds, verbatim or with other names, numbers and units.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Items with one template are one class,
    named by its least item_id. Columns: doc_id, item_id, items (ids of the class), n_windows (of the item), matched (those found in the
    document), coverage (matched / n_windows), run_tokens (longest run of tokens found in order without a gap), n_slots (values of the item that were compared), consistent.

    A document holds an item if at least ``share`` of the item's windows of ``window`` template tokens occur in it, or ``run`` tokens in a row,
    and if the slots agree: over the windows of an occurrence, each value of the item stands for one value in the document and the reverse.
    Windows of fewer than two literal tokens say nothing and are left out. An item shorter than a window is one window of its own length, found anywhere in a
    text (below ``SHORTEST`` tokens: only as the whole text). The slots are judged by occurrence: windows on diagonals at most ``SLACK`` apart. Those of occurrences that contradict themselves are left out, and what
    stays must reach the same bounds; so two copies with different values do not refute one another. Null and empty texts hold nothing; an empty table gives no rows. Different texts under one doc_id (null is an id like others) are judged each by
    itself, and so are different items under one item_id; the closest of them gives the row.
    """
    items = cut_lineage(_benchmark(benchmark, window), "benchmark")
    literal = F.transform(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.size(F.filter(F.slice("tokens", i + 1, window), lambda t: ~t.rlike(f"^[{_ALL}]$"))) >= LITERALS)
    hashed = items.select("class", "tokens", _own_windows(F.col("tokens"), window).alias("hashes"))
    known = hashed.select("class", F.posexplode(F.arrays_zip("hashes", literal.alias("literal")))).filter("col.literal").select("class", F.col("pos").alias("ipos"), F.col("col.hashes").alias("hash"))
    known = cut_lineage(known, "benchmark-windows")
    totals = known.groupBy("class").agg(F.count(F.lit(1)).alias("n_windows")).join(items.select("class", F.size("tokens").alias("n_tokens")), "class")

    tokens = docs.select("doc_id", F.xxhash64("text").alias("part"), template(F.col("text")).alias("tokens"))
    # Texts have windows of the lengths that items have: mostly one, at most ``window``.
    lengths = sorted(r["n"] for r in items.select(F.least(F.size("tokens"), F.lit(window)).alias("n")).distinct().collect())
    none = F.array().cast("array<bigint>")
    each = []
    for n in lengths or [window]:
        there = _windows(F.col("tokens"), n) if n >= min(SHORTEST, window) else F.when(F.size("tokens") == n, _windows(F.col("tokens"), n))
        each.append(F.transform(F.coalesce(there, none), lambda h, i: F.struct(i.alias("dpos"), h.alias("hash"))))
    rows = tokens.select("doc_id", "part", F.inline(F.concat(*each) if len(each) > 1 else each[0]))
    small = known.count() <= BROADCAST_WINDOWS
    matches = rows.join(F.broadcast(known) if small else known, "hash").select(*_PAIR, "dpos", "ipos")
    matches = cut_lineage(matches.distinct(), "matched-windows")

    counted = matches.groupBy(*_PAIR).agg(F.countDistinct("ipos").alias("matched")).join(totals, "class")
    enough = F.least(F.ceil(F.col("n_windows") * share), F.lit(max(1, run - window + 1)))
    close = cut_lineage(_null_safe(matches, counted.filter(F.col("matched") >= enough), _PAIR).select(*_PAIR, "dpos", "ipos"), "close-windows")
    near = cut_lineage(_judged(close, totals, window, share, run), "near-items")
    # Only what could be an item has its slots compared; what contradicts itself is taken out, and the rest is judged again.
    placed = cut_lineage(_occurrences(_null_safe(close, near.select(*_PAIR), _PAIR)), "occurrences")
    checked = cut_lineage(_slot_check(docs, items, placed, window), "checked-slots")
    wrong = checked.filter("not consistent").select(*_PAIR, "occurrence")
    agreed = _null_safe(placed, wrong, [*_PAIR, "occurrence"], "left_anti").select(*_PAIR, "dpos", "ipos")
    slots_of = checked.filter("consistent").groupBy(*_PAIR).agg(F.max("n_slots").alias("n_slots"))
    judged = _judged(agreed, totals, window, share, run).withColumn("consistent", F.lit(True))
    out = _null_safe(judged, slots_of, _PAIR, "left").join(items.select("class", "item_id", "items"), "class")
    out = out.withColumn("n_slots", F.coalesce("n_slots", F.lit(0).cast("long")))
    closest = F.max(F.struct("coverage", "run_tokens", "matched", "n_windows", "n_slots", "consistent", "items")).alias("c")
    out = out.groupBy("doc_id", "item_id").agg(closest)
    return out.select("doc_id", "item_id", *[f"c.{c}" for c in ("items", "n_windows", "matched", "coverage", "run_tokens", "n_slots", "consistent")])


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equality join in which null equals null; the keys come from the left."""
    other = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns if c in keys or c not in left.columns])
    return left.join(other, [left[k].eqNullSafe(other[f"_{k}"]) for k in keys], how).drop(*[f"_{k}" for k in keys])


def _judged(matches: DataFrame, totals: DataFrame, window: int, share: float, run: int) -> DataFrame:
    """The pairs whose matched windows cover ``share`` of the item or have ``run`` tokens in a row: (pair, n_windows, matched, coverage, run_tokens)."""
    counted = matches.groupBy(*_PAIR).agg(F.countDistinct("ipos").alias("matched")).join(totals, "class")
    # Windows on one diagonal without a gap are a run.
    line = Window.partitionBy(*_PAIR, F.col("dpos") - F.col("ipos")).orderBy("ipos")
    runs = matches.withColumn("run", F.col("ipos") - F.row_number().over(line)).groupBy(*_PAIR, (F.col("dpos") - F.col("ipos")).alias("diagonal"), "run")
    longest = runs.agg(F.count(F.lit(1)).alias("n")).groupBy(*_PAIR).agg(F.max("n").alias("longest"))
    both = _null_safe(counted, longest, _PAIR).withColumn("coverage", F.col("matched") / F.col("n_windows"))
    both = both.withColumn("run_tokens", F.least(F.col("longest") + window - 1, F.col("n_tokens").cast("long")))
    return both.filter((F.col("coverage") >= share) | (F.col("run_tokens") >= run)).select(*_PAIR, "n_windows", "matched", "coverage", "run_tokens")


def _occurrences(matches: DataFrame) -> DataFrame:
    """The matched windows of each pair with the number of their occurrence; a new one begins where diagonals are more than ``SLACK`` apart."""
    diagonals = matches.select(*_PAIR, (F.col("dpos") - F.col("ipos")).alias("diagonal")).distinct()
    along = Window.partitionBy(*_PAIR).orderBy("diagonal")
    begins = (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(along), F.col("diagonal")) > SLACK).cast("int")
    numbered = diagonals.withColumn("begins", begins).withColumn("occurrence", F.sum("begins").over(along)).drop("begins")
    return _null_safe(matches.withColumn("diagonal", F.col("dpos") - F.col("ipos")), numbered, [*_PAIR, "diagonal"]).drop("diagonal")


def _slot_check(docs: DataFrame, items: DataFrame, matches: DataFrame, window: int) -> DataFrame:
    """(doc_id, part, class, occurrence, n_slots, consistent) of those occurrences whose matched windows hold slots."""
    asked = items.select("class", F.explode("slots").alias("s")).select("class", F.col("s.pos").alias("ipos"), F.col("s.value").alias("item_value"))
    wide = matches.select(*_PAIR, "occurrence", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("k"), "dpos", "ipos")
    wide = wide.select(*_PAIR, "occurrence", (F.col("dpos") + F.col("k")).alias("dpos"), (F.col("ipos") + F.col("k")).alias("ipos")).distinct()
    met = cut_lineage(wide.join(asked, ["class", "ipos"]), "met-slots")
    # Only documents in which a slot was met are read again.
    again = docs.select("doc_id", F.xxhash64("text").alias("part"), "text")
    again = _null_safe(again, met.select("doc_id", "part").distinct(), ["doc_id", "part"], "left_semi")
    found = again.select("doc_id", "part", slots(F.col("text")).alias("slots")).select("doc_id", "part", F.explode("slots").alias("s"))
    found = found.select("doc_id", "part", F.col("s.pos").alias("dpos"), F.col("s.value").alias("value")).distinct()
    both = _null_safe(met, found, ["doc_id", "part", "dpos"])
    per = both.groupBy(*_PAIR, "occurrence").agg(
        F.countDistinct("item_value").alias("n_slots"), F.countDistinct("value").alias("values"), F.countDistinct("item_value", "value").alias("mappings")
    )
    return per.select(*_PAIR, "occurrence", "n_slots", ((F.col("mappings") == F.col("n_slots")) & (F.col("mappings") == F.col("values"))).alias("consistent"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, all columns, whose document holds no benchmark item (see ``contaminated``); a null doc_id counts as one id."""
    bad = contaminated(docs, benchmark, **parameters).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
