"""Benchmark decontamination by template windows, to catch re-parameterised questions.

Words are letter runs or numbers; a word gets a typed placeholder when it is a number, a unit right
after a number, or a name (capitalised after a word or comma); other words count in lower case. Windows
of WINDOW template words are hashed and hash-joined with the benchmark's windows. Items shorter than a
window form one window of their own length. Windows with fewer than LITERALS ordinary words say
nothing as templates and are matched by their literal words in lower case instead, so a copy of them is
found but no variant. They count for the share only in items without any other window.

An alignment is an offset between document and item with the windows met at it. Its slots are
compared where these windows cover them: it is consistent if every item value goes to one value of
the document. A document leaks an item when the windows of its consistent alignments are at least SHARE
of the item's, or when the windows of a consistent alignment cover RUN words in a row, whatever share of
the item that is. So a copy after a muddled variant, with words put in or left out, or a part is found. Of
an alignment that is not consistent only windows with the item's own words count, and only in a row. The
leak is `verbatim` if all slot words of the alignment with most windows are the item's, else
`reparameterised`.

DataFrame functions only; documents are read once for windows of all lengths and once for the slots of those that meet an item. The benchmark's windows are broadcast only if they number at most
BROADCAST_ROWS (they are counted first); a larger benchmark is joined by shuffle.

Edge cases: null or empty texts and items have no windows and are never met; rows are told apart by id and the text's digest, so
several texts under one id (of documents or items) are judged each, and the pair (doc_id, item_id) is one row: that of the texts
with the largest share; null ids are dropped, as a leak could not be named; empty tables give no rows; other
columns are ignored. Of equal alignments a verbatim one gives the verdict. Items of fewer than LEAST_WORDS words are `short`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

WINDOW = 8
LITERALS = 4
SHARE = 0.5
#: Words of an item in a row that are a leak, however long the item is.
RUN = 13
#: An item of fewer words is met in ordinary texts: it is reported as `short`, and no document goes for it.
LEAST_WORDS = 4
BROADCAST_ROWS = 500_000
SALTS = 16
#: Units that become placeholders after a number.
UNITS = (
    "mm", "cm", "m", "km", "mi", "ft", "in", "g", "kg", "mg", "lb", "oz", "ml", "l", "s", "sec", "ms", "min", "h", "hr", "hours", "minutes", "seconds", "days", "weeks", "months", "years",
    "percent", "dollars", "euros", "cents", "meters", "metres", "kilometers", "miles", "feet", "inches", "grams", "kilograms", "pounds", "liters", "litres", "degrees",
)
#: Words of a text as they stand, and the signs that stand for words of a type.
WORD = r"[0-9]+(?:[.,][0-9]+)*|\p{L}+"
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: A capitalised word after a word, comma or closing bracket and one blank.
_NAME = r"(?<=[\p{L}0-9,;)] )\p{Lu}(?=\p{Ll})\p{L}*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def templates(text: Column) -> Column:
    """The template words of a text; as many as words(text) in the same order."""
    out = F.translate(F.coalesce(text.cast("string"), F.lit("")), NUMBER + NAME + UNIT, "   ")
    out = F.regexp_replace(out, _NAME, NAME)
    out = F.lower(F.regexp_replace(out, "[0-9]+(?:[.,][0-9]+)*", f" {NUMBER} "))
    out = F.regexp_replace(out, f"{NUMBER} +(?:{'|'.join(UNITS)})(?!\\p{{L}})", f"{NUMBER} {UNIT}")
    return F.array_remove(F.split(out, f"[^\\p{{L}}{NUMBER}{NAME}{UNIT}]+"), "")


def with_windows(table: DataFrame, id_col: str, text_col: str, lengths: list[int], literal: list[int]) -> DataFrame:
    """id, row, length, place, hash: every template window of the lengths, and every window of the words in lower case of the literal lengths; row is the text's digest. One pass over the table."""
    text = table[text_col].cast("string")
    t = table.filter(table[id_col].isNotNull()).select(table[id_col].cast("long").alias("id"), _digest(text).alias("row"), templates(text).alias("t"), *([F.transform(words(text), F.lower).alias("w")] if literal else []))
    code = lambda c: F.transform(c, lambda x: F.xxhash64(x)).alias(c)
    coded = t.select("id", "row", code("t"), *([code("w")] if literal else []))
    each = [_windows("t", n, False) for n in lengths] + [_windows("w", n, True) for n in literal]
    # Outer, and no filter on the arrays: Catalyst would copy their definition into such filters, and into the lambda of every element.
    return coded.select("id", "row", F.explode_outer(F.flatten(F.array(*each))).alias("x")).filter("x is not null").select("id", "row", "x.length", "x.place", "x.hash")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _windows(codes: str, n: int, literal: bool) -> Column:
    starts = F.when(F.size(codes) >= n, F.sequence(F.lit(1), F.size(codes) - (n - 1))).otherwise(F.array().cast("array<int>"))
    named = lambda i: F.xxhash64(F.slice(codes, i, n), F.lit("literal")) if literal else F.xxhash64(F.slice(codes, i, n))
    return F.transform(starts, lambda i: F.struct(F.lit(n).alias("length"), (i - 1).alias("place"), named(i).alias("hash")))


def _items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, irow, text: every text of every item once."""
    t = benchmark.filter(benchmark[id_col].isNotNull()).select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text"))
    return t.groupBy("item_id", _digest(F.col("text")).alias("irow")).agg(F.max("text").alias("text"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int], list[int]]:
    """item_id, irow, length, place, hash and the text's number of windows: template windows with enough ordinary words and literal ones where there are too few; whether the window counts for the share (literal ones only if the text has no other); and the lengths in use of either kind."""
    items = _items(benchmark, id_col, text_col)
    items = items.select("item_id", "irow", "text", F.least(F.size(templates(F.col("text"))), F.lit(WINDOW)).alias("own")).filter("own > 0")
    lengths = sorted(r["own"] for r in items.select("own").distinct().collect())  # WINDOW numbers at most
    plain = items.select("item_id", "irow", "own", F.posexplode(templates(F.col("text"))).alias("at", "t")).select("item_id", "irow", "own", "at", (~F.col("t").isin(NUMBER, NAME, UNIT)).cast("int").alias("plain"))
    ahead = Window.partitionBy("item_id", "irow").orderBy("at").rowsBetween(0, WINDOW - 1)
    key = ["item_id", "irow"]
    rich = plain.withColumn("plain", F.sum("plain").over(ahead)).filter(F.col("plain") >= F.least(F.col("own"), F.lit(LITERALS))).select(*key, F.col("at").alias("place"))
    named = lambda literal: with_windows(items, "item_id", "text", [] if literal else lengths or [WINDOW], literal or []).withColumnRenamed("id", "item_id").withColumnRenamed("row", "irow")
    cols = [*key, "length", "place", "hash"]
    own = named(None).join(items.select(*key, "own"), key).filter("length = own").select(*cols)
    out = own.join(rich, [*key, "place"], "left_semi").select(*cols)
    poor = own.select(*key, "length", "place").join(rich, [*key, "place"], "left_anti")
    literal = sorted(r["length"] for r in poor.select("length").distinct().collect())  # WINDOW numbers at most
    sums = out.groupBy(*key).agg(F.count("*").alias("rich"))
    out = out.withColumn("literal", F.lit(False))
    if literal:
        out = out.unionByName(named(literal).join(poor, [*key, "length", "place"], "left_semi").select(*cols).withColumn("literal", F.lit(True)))
    total = out.groupBy(*key).agg(F.count("*").alias("all"))
    counted = out.join(total.join(sums, key, "left"), key)
    return counted.select(*cols, F.coalesce("rich", "all").alias("windows"), (~F.col("literal") | F.col("rich").isNull()).alias("counts")), lengths, literal


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, hit, windows, slots, verdict: every pair of a document and an item that it leaks."""
    index, lengths, literal = benchmark_windows(benchmark)
    index = index.withColumnRenamed("place", "at").withColumnRenamed("length", "len")
    met = with_windows(docs, id_col, text_col, lengths or [WINDOW], literal)
    on = (met["hash"] == index["hash"]) & (met["length"] == index["len"])
    if index.count() <= BROADCAST_ROWS:
        pairs = met.join(F.broadcast(index), on)
    else:
        # A window that most documents hold is dealt over SALTS tasks.
        met = met.withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.lit(SALTS)))
        pairs = met.join(index.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), on & (met["salt"] == F.col("deal")))
    pair = ["id", "row", "item_id", "irow", "windows"]
    by_offset = pairs.groupBy(*pair, (F.col("place") - F.col("at")).alias("offset")).agg(F.array_sort(F.collect_set("at")).alias("ats"), F.collect_set(F.when(F.col("counts"), F.col("at"))).alias("own_ats"), F.max("len").alias("len"))
    by_offset = materialize(by_offset.withColumn("run", _run(F.col("ats"), F.col("len"))), "alignments")
    # Sets of an item's places and the longest run are kept by pair, never its alignments, which a repetitive document has many of.
    hits = by_offset.select(*pair, F.explode_outer("own_ats").alias("at"), "run").groupBy(*pair).agg(F.size(F.collect_set("at")).alias("hit"), F.max("run").alias("run"))
    enough = hits.filter((F.col("hit") >= SHARE * F.col("windows")) | (F.col("run") >= RUN)).select(*pair)
    cand = by_offset.join(enough, pair, "left_semi").withColumnRenamed("id", "doc_id").select("doc_id", "row", "item_id", "irow", "windows", "offset", "ats", "own_ats")
    return _with_verdict(cand, item_words(benchmark), docs, id_col, text_col)


def _run(ats: Column, own: Column) -> Column:
    """The most words in a row that windows at these sorted places cover."""

    def step(so_far: Column, at: Column) -> Column:
        start = F.when(at <= so_far["end"], so_far["start"]).otherwise(at)
        return F.struct(start.alias("start"), (at + own).alias("end"), F.greatest(so_far["most"], at + own - start).alias("most"))

    return F.aggregate(ats, F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("most")), step, lambda x: x["most"])


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id, irow, own, iw, it, slots: every item text's window length, words, template words and number of placeholders."""
    items = _items(benchmark).select("item_id", "irow", words(F.col("text")).alias("iw"), templates(F.col("text")).alias("it"))
    return items.select("item_id", "irow", F.least(F.size("it"), F.lit(WINDOW)).alias("own"), "iw", "it", F.size(F.filter("it", _is_slot)).cast("long").alias("slots"))


def _is_slot(t: Column) -> Column:
    return t.isin(NUMBER, NAME, UNIT)


def _with_verdict(cand: DataFrame, items: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Compares the slots that an alignment's met windows cover; only documents that meet an item with slots are read again."""
    cand = cand.join(items, ["item_id", "irow"])
    text = docs[text_col].cast("string")
    texts = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), _digest(text).alias("row"), text.alias("text"))
    one = ["doc_id", "row"]
    met = texts.join(cand.filter("slots > 0").select(*one).distinct(), one, "left_semi").groupBy(*one).agg(F.max("text").alias("text")).select(*one, words(F.col("text")).alias("w"))
    within = lambda a: F.sequence(a, a + F.col("own") - 1)
    slots = F.filter(F.array_distinct(F.flatten(F.transform("ats", within))), lambda p: _is_slot(F.get("it", p)))
    there = cand.join(met, one, "left").withColumn("at_slots", F.transform(slots, lambda p: F.struct(F.lower(F.get("iw", p)).alias("value"), F.lower(F.coalesce(F.get("w", (p + F.col("offset")).cast("int")), F.lit(""))).alias("word"))))
    kinds = F.size(F.array_distinct(F.transform("at_slots", lambda s: F.concat_ws(" ", s["value"], s["word"]))))
    consistent = kinds == F.size(F.array_distinct(F.transform("at_slots", lambda s: s["value"])))
    same = lambda p: ~_is_slot(F.get("it", p)) | (F.lower(F.get("iw", p)) == F.lower(F.coalesce(F.get("w", (p + F.col("offset")).cast("int")), F.lit(""))))
    equal = F.filter("ats", lambda a: F.forall(within(a), same))
    judged = there.select("doc_id", "row", "item_id", "irow", "windows", "slots", "own", F.size("it").alias("item_words"), "ats", "own_ats", consistent.alias("consistent"), F.forall("at_slots", lambda s: s["value"] == s["word"]).alias("exact"), equal.alias("equal"))
    # Without consistency only the windows whose words are the item's count, and only in a row.
    judged = judged.withColumn("run", _run(F.when(F.col("consistent"), F.col("ats")).otherwise(F.col("equal")), F.col("own"))).withColumn("own_ats", F.when(F.col("consistent"), F.col("own_ats")).otherwise(F.array().cast("array<int>")))
    best = F.struct("consistent", F.size("ats").alias("n"), (F.col("exact") | ~F.col("consistent")).alias("exact"))
    pair = ["doc_id", "row", "item_id", "irow", "windows", "slots", "item_words"]
    runs = judged.select(*pair, F.explode_outer("own_ats").alias("at"), "run", best.alias("best"))
    good = runs.groupBy(*pair).agg(F.size(F.collect_set("at")).alias("hit"), F.max("run").alias("run"), F.max("best").alias("best"))
    verdict = F.when(F.col("item_words") < LEAST_WORDS, "short").when(F.col("best.exact"), "verbatim").otherwise("reparameterised")
    out = good.filter((F.col("hit") >= SHARE * F.col("windows")) | (F.col("run") >= RUN)).withColumn("verdict", verdict)
    # Of a document's texts and an item's texts the pair with the largest share gives the row, a verbatim one first.
    rank = F.struct((F.col("verdict") != "short").alias("a"), (F.col("hit") / F.col("windows")).alias("b"), (F.col("verdict") == "verbatim").alias("c"), "row", "irow")
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("hit", "windows", "slots", "verdict"), rank).alias("x")).select("doc_id", "item_id", "x.hit", "x.windows", "x.slots", "x.verdict")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns; a null doc_id stays, and so does a document that only holds an item of fewer than LEAST_WORDS words."""
    found = materialize(leaks(docs, benchmark).filter("verdict <> 'short'").select(F.col("doc_id").alias("leak")).distinct(), "leaks")  # of its own lineage: docs may have a column of any name
    return docs.join(found, docs["doc_id"].cast("long") == found["leak"], "left_anti")
