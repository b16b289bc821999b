r"""Benchmark decontamination by templates, in DataFrame functions only.

Texts are brought to three templates after white space is made single spaces. In
two of them numbers, units and names become typed placeholders and other words are
lower-cased and lose what isn't a letter; a capitalised word at the start of a
sentence, line or text is a plain word in the first and a name in the second. The
third has case-folded words and no placeholders. Windows of WINDOW tokens of the
benchmark are hash-joined with those of the documents, template by template. As a
run that counts has WINDOW + STRIDE - 1 tokens or more, every STRIDE-th window of a
document is enough to meet one; where one is met, item and document are compared
token by token on that diagonal. Shorter items, and those with windows of no plain
word, are looked up at every place. Windows that agree at consecutive places of one
item and one document make runs. A run with
placeholders must be consistent in its slots: equal values of the item stand for
equal values of the document and different for different, so an item with other
numbers or names is caught and a mere list of numbers isn't. An item counts as
leaked into a document with a run of MIN_RUN tokens, or of the whole item where
that is shorter; items shorter than a window are looked up by their whole template.

A run must hold MIN_WORDS different plain words, or one in the third template. This
is asked of the finished run. Windows without a plain word aren't looked up but are
compared where another window of their item is met, so runs go on over them.
The windows of the benchmark are broadcast only when their counted number is at
most BROADCAST_WINDOWS; beyond it both sides are shuffled by the hash.

Defined cases: a null text is an empty one; an item without a plain word
matches nothing; repeated rows of a doc_id or item_id are looked
at as one id's texts and give one row; rows with a null id are left out; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WINDOW = 8
#: Places from one window of a document to the next that is looked up.
STRIDE = 4
MIN_RUN = 13
MIN_WORDS = 4
#: 16 bytes of key and place each, a few hundred MB as a hash table at the most.
BROADCAST_WINDOWS = 1_000_000

#: Placeholders (private-use characters) and the units that follow a number.
NUMBER, UNIT, NAME = "", "", ""
#: Marks around a name at the start of a sentence, line or text, which may be a plain word as well.
FIRST, END = "\ue004", "\ue005"
#: The templates: first words are plain; all capitalised words are names; case-folded words and no placeholders.
KINDS = (0, 1, 2)
LITERAL = 2
#: White space but the plain space, and the characters that stand for placeholders here.
_GAPS = "".join(map(chr, [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0xE001, 0xE006)]))
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|l|ml|h|hr|hrs|hours?|min|mins|minutes?|s|sec|seconds?|days?|weeks?|months?|years?|miles?|feet|ft|inch|inches|meters?|metres?|kilometers?|grams?|dollars?|euros?|cents?|percent|mph|kmh"


def _spaced(text: Column) -> Column:
    """The text with single spaces for all white space, so that wrapping makes no difference."""
    plain = F.translate(text, _GAPS, " " * len(_GAPS))
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, "  +", " ")).otherwise(plain)


def _split(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def _marked(spaced: Column) -> Column:
    """Tokens with placeholders, one for each word that holds a letter or digit; a name that may be a plain first word stands between marks."""
    numbered = F.regexp_replace(spaced, r"\p{N}+(?:[.,:/]\p{N}+)*", NUMBER)
    united = F.regexp_replace(numbered, rf"{NUMBER}( ?)(?i:{UNITS})(?![\p{{L}}{NUMBER}])", rf"{NUMBER}$1{UNIT}")
    capital = F.regexp_replace(united, rf"(\p{{Lu}}(?<![\p{{L}}{NUMBER}{UNIT}].)\p{{Ll}}+)(?![\p{{L}}{NUMBER}])", rf"{FIRST}$1{END}")
    named = F.regexp_replace(capital, rf"{FIRST}(?<=[\p{{L}}{NUMBER}{UNIT}{END},;][ ].)[^{END}]*{END}", NAME)
    return _split(F.lower(F.regexp_replace(named, rf"[^\p{{L}}{NUMBER}-{END} ]+", "")))


def _literal(spaced: Column) -> Column:
    """Case-folded words, at the same places as _marked() has them."""
    return _split(F.lower(F.upper(F.regexp_replace(spaced, r"[^\p{L}\p{N} ]+", ""))))


def _templates(table: DataFrame, key: str, made: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """(key, t0, t1, t2): the tokens of the three templates, each token by ``made``."""
    parts = table.select(key, _spaced(F.col("text")).alias("text")).select(key, _marked(F.col("text")).alias("marked"), _literal(F.col("text")).alias("literal"))
    plain = lambda t: F.when(t.contains(FIRST), F.translate(t, FIRST + END, "")).otherwise(t)
    name = lambda t: F.when(t.contains(FIRST), F.concat(F.substring_index(t, FIRST, 1), F.lit(NAME), F.substring_index(t, END, -1))).otherwise(t)
    return parts.select(key, F.transform("marked", lambda t: made(plain(t))).alias("t0"), F.transform("marked", lambda t: made(name(t))).alias("t1"), F.transform("literal", lambda t: made(t)).alias("t2"))


def words(text: Column) -> Column:
    """The raw words, at the same places as the templates have theirs."""
    return F.filter(F.split(_spaced(text), " "), lambda t: t.rlike(r"[\p{L}\p{N}]"))


def _plain_words(tokens: Column) -> Column:
    """How many different tokens without a placeholder or digit there are."""
    return F.size(F.array_distinct(F.filter(tokens, lambda t: ~t.rlike(rf"[\p{{N}}{NUMBER}-{NAME}]"))))


def _texts(table: DataFrame, key: str) -> DataFrame:
    return table.select(table[key].cast("long").alias(key), F.coalesce(table["text"].cast("string"), F.lit("")).alias("text")).where(F.col(key).isNotNull())


def _hashes(tokens: str, size: int, stride: int, kind: int) -> Column:
    """Hash of the window of ``size`` tokens at each ``stride``-th place; other kinds, other hashes."""
    places = F.when(F.size(tokens) >= size, F.sequence(F.lit(0), F.size(tokens) - size, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(size)), F.lit(kind)))


def _windows(table: DataFrame, key: str, at: str, size: int = WINDOW, stride: int = 1) -> DataFrame:
    """(key, hash, kind, at) for windows of ``size`` tokens of each template."""
    kinds = [f"t{k}" for k in KINDS]
    hashed = _templates(table, key, lambda t: F.xxhash64(t)).select(key, *(_hashes(t, size, stride, k).alias(t) for k, t in enumerate(kinds)))
    # the outer form: for the inner one the optimiser adds a filter that works out the windows once more
    rows = hashed.select(key, F.size("t0").alias("n"), F.posexplode_outer(F.concat(*kinds)).alias("place", "hash")).where(F.col("hash").isNotNull())
    return rows.select(key, "hash", F.expr("cast(place div n as int)").alias("kind"), F.expr(f"cast(place % n as int) * {stride}").alias(at))


def _item_templates(benchmark: DataFrame) -> DataFrame:
    """(item_id, kind, tokens, n), three rows an item."""
    made = _templates(benchmark, "item_id").select("item_id", F.posexplode(F.array("t0", "t1", "t2")).alias("kind", "tokens"))
    return made.withColumn("n", F.size("tokens")).distinct()


def _silent(templates: DataFrame) -> DataFrame:
    """(item_id, kind, item_at): windows without a plain word, which are not looked up."""
    places = templates.where(F.col("n") >= WINDOW).select("item_id", "kind", "tokens", F.explode(F.sequence(F.lit(0), F.col("n") - WINDOW)).alias("item_at"))
    return places.where(_plain_words(F.slice("tokens", F.col("item_at") + 1, WINDOW)) == 0).select("item_id", "kind", "item_at").distinct()


def _few_words(templates: DataFrame) -> DataFrame:
    """(item_id, kind, item_at): windows of fewer than MIN_WORDS plain words."""
    places = templates.where(F.col("n") >= WINDOW).select("item_id", "kind", "tokens", F.explode(F.sequence(F.lit(0), F.col("n") - WINDOW)).alias("item_at"))
    return places.where(_plain_words(F.slice("tokens", F.col("item_at") + 1, WINDOW)) < MIN_WORDS).select("item_id", "kind", "item_at").distinct()


def _compared(met: DataFrame, templates: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, doc_at, item_id, item_at, kind): all windows that agree on the diagonals where one was met."""
    lines = met.select("doc_id", "item_id", "kind", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    texts = docs.join(lines.select("doc_id").distinct(), "doc_id", "left_semi")
    tokens = _templates(texts, "doc_id").select("doc_id", F.array("t0", "t1", "t2").alias("t"))
    both = lines.join(templates, ["item_id", "kind"]).join(tokens, "doc_id").withColumn("own", F.col("t")[F.col("kind")])
    first, last = F.greatest(F.lit(0), -F.col("shift")), F.least(F.col("n"), F.size("own") - F.col("shift")) - WINDOW
    both = both.where(first <= last).withColumn("item_at", F.explode(F.sequence(first, last)))
    held = both.where(F.slice("own", F.col("item_at") + F.col("shift") + 1, WINDOW) == F.slice("tokens", F.col("item_at") + 1, WINDOW))
    return held.select("doc_id", (F.col("item_at") + F.col("shift")).alias("doc_at"), "item_id", "item_at", "kind").distinct()


def _runs(matches: DataFrame) -> DataFrame:
    """Maximal runs of matched windows: doc_id, item_id, kind, doc_at, item_at, n_tokens."""
    line = Window.partitionBy("doc_id", "item_id", "kind", "shift").orderBy("doc_at")
    numbered = matches.withColumn("shift", F.col("doc_at") - F.col("item_at")).withColumn("run", F.col("doc_at") - F.row_number().over(line))
    runs = numbered.groupBy("doc_id", "item_id", "kind", "shift", "run").agg(F.min("doc_at").alias("doc_at"), F.min("item_at").alias("item_at"), F.count("*").alias("n"))
    return runs.select("doc_id", "item_id", "kind", "doc_at", "item_at", (F.col("n") + (WINDOW - 1)).cast("int").alias("n_tokens"))


def _consistent(item: str, doc: str, kinds: str) -> Column:
    """Whether the slots of a run map one to one. Arguments are array columns of the run's tokens."""
    slots = F.filter(F.arrays_zip(F.col(item).alias("i"), F.col(doc).alias("d"), F.col(kinds).alias("k")), lambda x: x["k"].rlike(f"[{NUMBER}-{NAME}]"))
    bare = lambda c: F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    size = lambda f: F.size(F.array_distinct(F.transform(slots, f)))
    pairs = size(lambda x: F.struct(bare(x["i"]).alias("i"), bare(x["d"]).alias("d")))
    return (pairs == size(lambda x: bare(x["i"]))) & (pairs == size(lambda x: bare(x["d"])))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each (doc_id, item_id) with the item leaked into the document.

    n_tokens is the longest consistent run, item_tokens the item's template
    length, n_slots the placeholders in that run.
    """
    scratch = Scratch(spark, "decontaminate")
    docs, benchmark = _texts(docs, "doc_id"), _texts(benchmark, "item_id")
    templates = scratch.save(_item_templates(benchmark), "templates")
    silent = scratch.save(_silent(templates), "silent")

    def matched(items: DataFrame, size: int, stride: int, name: str) -> DataFrame:
        wanted = items.select("hash", "item_id", "item_at")
        if items.count() <= BROADCAST_WINDOWS:
            wanted = F.broadcast(wanted)
        met = _windows(docs, "doc_id", "doc_at", size, stride).join(wanted, "hash")  # one long key: the kind is in the hash
        return scratch.save(met.select("doc_id", "doc_at", "item_id", "item_at", "kind"), name).distinct()

    items = _windows(benchmark, "item_id", "item_at").distinct().join(silent, ["item_id", "kind", "item_at"], "left_anti")
    everywhere = templates.where(F.col("n").between(WINDOW, WINDOW + STRIDE - 2)).select("item_id", "kind").union(silent.select("item_id", "kind")).distinct()
    everywhere = scratch.save(everywhere, "everywhere")
    met = matched(scratch.save(items.join(everywhere, ["item_id", "kind"], "left_anti"), "windows"), WINDOW, STRIDE, "met")
    dense = scratch.save(items.join(everywhere, ["item_id", "kind"], "left_semi"), "windows-everywhere")
    if dense.limit(1).count():
        met = met.unionByName(matched(dense, WINDOW, 1, "met-everywhere"))
    matches = scratch.save(_compared(met, templates, docs), "matches")
    weak = _few_words(templates)
    strong = matches.join(weak, ["item_id", "kind", "item_at"], "left_anti")
    # a run that fails as a whole may hold one that stands by its wordy windows alone
    runs = _runs(matches).unionByName(_runs(strong)).distinct()
    for size in [r.n for r in templates.where(f"n between 1 and {WINDOW - 1}").select("n").distinct().orderBy("n").collect()]:
        of_size = templates.where((F.col("n") == size) & (_plain_words(F.col("tokens")) > 0))
        short = scratch.save(_windows(benchmark, "item_id", "item_at", size).distinct().join(of_size, ["item_id", "kind"], "left_semi").where("item_at = 0"), f"windows-{size}")
        whole = matched(short, size, 1, f"matches-{size}").withColumn("n_tokens", F.lit(size))
        runs = runs.unionByName(whole.select(*runs.columns))

    raw = benchmark.select("item_id", words(F.col("text")).alias("item_words"))
    item_words = templates.withColumnRenamed("tokens", "kinds").withColumnRenamed("n", "item_tokens").join(raw, "item_id").where(F.size("item_words") == F.col("item_tokens"))
    shown = runs.join(item_words, ["item_id", "kind"]).where(F.col("n_tokens") >= F.least(F.lit(MIN_RUN), F.col("item_tokens")))
    part = lambda column, at: F.slice(column, F.col(at) + 1, F.col("n_tokens"))
    shown = shown.select("doc_id", "item_id", "kind", "doc_at", "n_tokens", "item_tokens", part("kinds", "item_at").alias("kinds"), part("item_words", "item_at").alias("item_words"))
    shown = shown.where(_plain_words(F.col("kinds")) >= F.when(F.col("kind") == LITERAL, 1).otherwise(MIN_WORDS))
    shown = shown.withColumn("n_slots", F.size(F.filter("kinds", lambda t: t.rlike(f"[{NUMBER}-{NAME}]"))))
    shown = scratch.save(shown, "runs")
    sure = shown.where("n_slots = 0").select("doc_id", "item_id", "n_tokens", "item_tokens", "n_slots")
    slotted = shown.where("n_slots > 0")
    texts = docs.join(slotted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("words"))
    held = texts.join(slotted, "doc_id").withColumn("doc_words", part("words", "doc_at")).where(_consistent("item_words", "doc_words", "kinds"))
    found = sure.unionByName(held.select(*sure.columns))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_tokens", "n_slots", "item_tokens")).alias("m")).select("doc_id", "item_id", "m.n_tokens", "m.item_tokens", "m.n_slots")
