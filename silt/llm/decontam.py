"""Benchmark decontamination (operator 1): template canonicalisation, in DataFrame functions only.

Texts become tokens in which numbers, units after a number and names (capitalised words within a sentence) are typed
placeholders. Windows of WINDOW canonical tokens, however many of them are slots, are taken at every token of the
benchmark and of the documents and joined by hash. A hit aligns an item with a place in a document, where the tokens of
both are compared pair by pair; a pair is equal if its canonical tokens or its values are. The alignment is a leak if

- MIN_MATCH or more of its pairs are equal (all of a shorter item), MIN_SAME of them in their values too: placeholders
  alone are chance; and
- the values of its slots are replaced consistently (one value of the item by one value in the document) within its
  stretch, the run of pairs with the largest sum of +1 for an equal and -1 for an unequal one (beyond it lies the
  document's own text), or MIN_MATCH pairs in a row (all of a shorter item) are equal in their values, whatever else.

So every alignment that holds WINDOW equal canonical tokens in a row is judged by all its pairs, wherever in the
document it lies. An item's first word is a name or not by what stands before it; its windows are taken both ways.

The benchmark's windows are counted and broadcast up to `broadcast_windows`; those of a larger benchmark are joined by a
shuffle of (document, place, hash), salted so that a window which very many documents hold is split. Texts are fetched
once for each document with a hit, in pieces of PIECE tokens, and hits are keyed by document and piece, so neither a
passage that a third of the documents hold nor a long document makes a hot key or a quadratic term.

Edge cases: null or empty texts match nothing; items of fewer than WINDOW tokens are too short to tell a leak from
chance and match nothing; items with equal text each get their rows; repeated documents (equal doc_id and text) get
one row for each item; null ids are kept as null; extra columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.llm.common import cut

WINDOW = 8
#: Tokens of a piece of a document that hits are compared with; the longest item's tokens come on top.
PIECE = 512
#: Parts of the key of a window where windows are joined by a shuffle.
SALTS = 16
#: Tokens of an alignment that are the same in their values too, literals or slots, that a leak needs.
MIN_SAME = 5
#: Equal tokens at one alignment that make a leak.
MIN_MATCH = 13
BROADCAST_WINDOWS = 2_000_000

#: Placeholders: private-use characters, name, number and unit.
NAME, NUMBER, UNIT, AFTER = "\ue000", "\ue001", "\ue002", "\ue003"
UNITS = (
    "mm|cm|km|m|meters?|metres?|kilometers?|kilometres?|miles?|feet|foot|ft|inch(?:es)?|yards?|mg|kg|g|grams?|kilograms?"
    "|tons?|tonnes?|pounds?|lbs?|ounces?|oz|ml|l|liters?|litres?|gallons?|ms|s|sec|seconds?|min|minutes?|h|hours?|days?"
    "|weeks?|months?|years?|dollars?|usd|euros?|eur|cents?|percent|degrees?|mph|kph|hz|khz|mhz|ghz|kb|mb|gb|tb|v|w|kw"
)


def _marked(text: Column, keep: str) -> Column:
    """text with placeholders; keep: what of the value follows its placeholder ('' or '$0')."""
    text = F.regexp_replace(text, f"[{NAME}-{UNIT}]", " ")
    text = F.regexp_replace(text, r"\p{Lu}(?<=[^.!?:;\s]\s{1,3}.)\p{Ll}+(?![\p{L}\p{N}])", NAME + keep)
    text = F.regexp_replace(text, r"\p{Nd}[\p{Nd}.,]*(?<=\p{Nd})", f" {NUMBER}{keep} ")
    unit = f"(?i)({NUMBER}[0-9.,]*+ ++)({UNITS})(?![\\p{{L}}\\p{{N}}])"
    return F.lower(F.regexp_replace(text, unit, f"$1{UNIT}{keep and '$2'}"))


def tokens(text: Column, keep: str = "") -> Column:
    cut_at = rf"[^\p{{L}}\p{{N}}{NAME}-{UNIT}.,]+"
    return F.filter(F.split(_marked(text, keep), cut_at), lambda x: x != "")


def _canonical(token: Column) -> Column:
    return F.when((token >= NAME) & (token < AFTER), F.substring(token, 1, 1)).otherwise(token)


def _hashed(canon: Column) -> Column:
    return F.transform(canon, lambda x: F.xxhash64(x))


def _hashes(tokens: str) -> Column:
    """Hashes of the windows of an array of token hashes, one for each token that a window starts at."""
    window = ", ".join(f"{tokens}[i + {k}]" for k in range(WINDOW))
    return F.expr(
        f"""if(size({tokens}) >= {WINDOW},
            transform(sequence(0, size({tokens}) - {WINDOW}), i -> xxhash64({window})), cast(array() as array<bigint>))"""
    )


def _value(token: Column) -> Column:
    """A token without its placeholder, and without the comma or full stop that may follow a slot."""
    slot = (token >= NAME) & (token < AFTER)
    return F.when(slot, F.rtrim(F.substring(token, 2, 1_000_000), F.lit(".,"))).otherwise(token)


def _items(benchmark: DataFrame) -> DataFrame:
    """own (values), canon (canonical tokens) and ids of each distinct text of the benchmark."""
    items = benchmark.groupBy("text").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("ids"))
    items = items.withColumn("own", tokens(F.col("text"), "$0")).where(F.size("own") >= WINDOW)
    return items.withColumn("item", F.xxhash64("text")).withColumn("canon", F.transform("own", _canonical))


def _windows(items: DataFrame) -> DataFrame:
    """hash, item and j (the window's first token); the first token as it is at a text's start and within a sentence."""
    within = F.transform(tokens(F.concat(F.lit("a "), F.ltrim("text"))), _canonical)
    first = items.select("item", _hashed(F.slice(within, 2, WINDOW)).alias("tokens"))
    first = first.select("item", F.lit(0).alias("j"), F.get(_hashes("tokens"), F.lit(0)).alias("hash"))
    every = items.select("item", _hashed(F.col("canon")).alias("tokens"))
    every = every.select("item", F.posexplode(_hashes("tokens")).alias("j", "hash"))
    return every.unionByName(first).distinct()


def _hits(docs: DataFrame, windows: DataFrame, n_windows: int, broadcast_windows: int) -> DataFrame:
    """silt_doc, item and at (the place of the item's first token) of each alignment that shares a window."""
    # As the item's tokens are: a placeholder with a comma or full stop after it is the placeholder.
    canon = F.transform(tokens(F.col("text")), lambda x: F.xxhash64(_canonical(x))).alias("tokens")
    hashes = docs.select(F.xxhash64("doc_id", "text").alias("silt_doc"), canon).select("silt_doc", _hashes("tokens").alias("hashes"))
    # An outer explode: for an inner one Catalyst adds a filter on the array's size, which computes the array twice.
    placed = hashes.select("silt_doc", F.posexplode_outer("hashes").alias("i", "hash"))
    if n_windows <= broadcast_windows:
        met = placed.join(F.broadcast(windows), "hash")
    else:
        salted = windows.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        met = placed.withColumn("salt", F.expr(f"cast(pmod(xxhash64(silt_doc, i), {SALTS}) as int)")).join(salted, ["hash", "salt"])
    return met.select("silt_doc", "item", (F.col("i") - F.col("j")).alias("at")).distinct()


_STRETCH = """aggregate(sequence(0, size(pairs) - 1),
    named_struct('sum', 0, 'start', 0, 'best', 0, 'low', 0, 'high', -1),
    (s, i) -> if(s.sum + if(pairs[i].eq, 1, -1) < 0,
        named_struct('sum', 0, 'start', i + 1, 'best', s.best, 'low', s.low, 'high', s.high),
        if(s.sum + if(pairs[i].eq, 1, -1) >= s.best,
            named_struct('sum', s.sum + if(pairs[i].eq, 1, -1), 'start', s.start, 'best', s.sum + if(pairs[i].eq, 1, -1),
                'low', s.start, 'high', i),
            named_struct('sum', s.sum + if(pairs[i].eq, 1, -1), 'start', s.start, 'best', s.best, 'low', s.low, 'high', s.high))))"""
_RUN = """aggregate(pairs, named_struct('now', 0, 'most', 0),
    (s, x) -> named_struct('now', if(x.same, s.now + 1, 0), 'most', if(x.same, greatest(s.most, s.now + 1), s.most)), s -> s.most)"""


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Leaks of benchmark (item_id, text) in docs (doc_id, text): one row for each document and item.

    doc_id, item_id, n_tokens (of the item), n_matched, n_slots and n_changed (slots whose value differs) of the best
    alignment, and silt_doc, a hash of doc_id and text.
    """
    docs = docs.select("doc_id", "text")
    items = cut(_items(benchmark))
    windows = cut(_windows(items))
    longest = items.agg(F.max(F.size("own"))).first()[0] or 0
    hits = cut(_hits(docs, windows, windows.count(), broadcast_windows))
    doc = docs.withColumn("silt_doc", F.xxhash64("doc_id", "text"))
    doc = doc.join(hits.select("silt_doc").distinct(), "silt_doc", "left_semi")
    doc = doc.groupBy("silt_doc").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    piece = f"""transform(sequence(0, (size(tokens) - 1) div {PIECE}),
        k -> named_struct('piece', k, 'tokens', slice(tokens, int(k * {PIECE} + 1), {PIECE + longest})))"""
    doc = doc.select("silt_doc", "doc_id", tokens(F.col("text"), "$0").alias("tokens"))
    pieces = doc.select("silt_doc", "doc_id", F.explode_outer(F.expr(piece)).alias("p")).select("silt_doc", "doc_id", "p.piece", "p.tokens")
    hits = hits.withColumn("piece", F.expr(f"cast(greatest(at, 0) div {PIECE} as bigint)"))
    sides = items.select("item", "own", "canon")
    if windows.count() <= broadcast_windows:
        sides = F.broadcast(sides)
    found = hits.join(pieces.withColumn("piece", F.col("piece").cast("bigint")), ["silt_doc", "piece"]).join(sides, "item")
    # The tokens of the document that lie beside the item's; null where it sticks out.
    beside = F.expr(f"transform(sequence(at, at + size(own) - 1), p -> get(tokens, int(p - piece * {PIECE})))")
    found = found.select("silt_doc", "doc_id", "item", "at", "canon", F.transform("own", _value).alias("own"), beside.alias("met"))
    found = found.select(
        "silt_doc", "doc_id", "item", "at", "canon", "own", F.transform("met", _canonical).alias("met_canon"),
        F.transform("met", _value).alias("met"),
    )
    pairs = f"""transform(arrays_zip(own, met, canon, met_canon), x -> named_struct('own', x.own, 'met', x.met,
        'slot', x.canon >= '{NAME}' and x.canon < '{AFTER}', 'same', x.own <=> x.met, 'eq', x.own <=> x.met or x.canon <=> x.met_canon))"""
    found = found.select("silt_doc", "doc_id", "item", F.expr(pairs).alias("pairs"))
    found = found.select(
        "silt_doc", "doc_id", "item", F.size("pairs").alias("n_tokens"), "pairs", F.expr(_STRETCH).alias("s"), F.expr(_RUN).alias("run"),
    )
    slots = "filter(slice(pairs, s.low + 1, s.high - s.low + 1), x -> x.slot and x.eq)"
    found = found.select(
        "silt_doc", "doc_id", "item", "n_tokens", "run",
        F.expr("size(filter(pairs, x -> x.eq))").alias("n_matched"),
        F.expr("size(filter(pairs, x -> x.slot and x.eq))").alias("n_slots"),
        F.expr("size(filter(pairs, x -> x.slot and x.eq and not x.same))").alias("n_changed"),
        F.expr("size(filter(pairs, x -> x.same))").alias("same"),
        F.expr(f"array_distinct(transform({slots}, x -> named_struct('own', x.own, 'met', x.met)))").alias("replaced"),
    )
    # Written: a filter on these would be pushed below the projections and repeat what they compute.
    found = cut(found)
    consistent = F.expr("size(replaced) = size(array_distinct(transform(replaced, x -> x.own)))")
    needed = F.least(F.lit(MIN_MATCH), F.col("n_tokens"))
    leak = (F.col("n_matched") >= needed) & (F.col("same") >= MIN_SAME) & (consistent | (F.col("run") >= needed))
    best = F.max(F.struct("n_matched", (-F.col("n_changed")).alias("n_same"), "n_slots", "n_tokens")).alias("best")
    out = found.where(leak).groupBy("silt_doc", "item").agg(F.first("doc_id").alias("doc_id"), best)
    ids = items.select("item", F.explode("ids").alias("id"))
    item_id = F.when(F.col("id") != "", F.col("id")).cast(benchmark.schema["item_id"].dataType).alias("item_id")
    numbers = [F.col(f"best.{n}").cast("bigint").alias(n) for n in ("n_tokens", "n_matched", "n_slots")]
    changed = (-F.col("best.n_same")).cast("bigint").alias("n_changed")
    return out.join(ids, "item").select("doc_id", item_id, *numbers, changed, "silt_doc")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a leak."""
    found = leaks(docs.select("doc_id", "text"), benchmark).select(F.col("silt_doc").alias("silt_leak")).distinct()
    return docs.join(found, F.xxhash64("doc_id", "text") == F.col("silt_leak"), "left_anti")
