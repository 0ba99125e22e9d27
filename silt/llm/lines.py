"""Line dedup (operator 9): deletion-neighbourhood join, in DataFrame functions only.

A line is removed if an earlier line, by (doc_id, place in the text), has the same words or words at edit distance 1 (one
word replaced, put in or left out) while the longer of both has MIN_NEAR words or more, that is, a similarity of 0.8 or
more. Lines are judged on the input, not on what is left.

Equal lines are first folded to one row with their earliest place. Of PARTS parts of a line, one edit touches one
alone; lines that agree with no other line in the rest can't have a neighbour and go no further. The others emit every
variant with one word deleted as a hashed key, and the line itself as the key of no deletion. A key's 64 bits depend on
the order of words, so lines under one key with the deletion at the same place differ in that word at most, and a line
under another's variant lacks one word of it. Only the earliest line of each group is kept, a running minimum that is
aggregated before any shuffle, so a line or variant that a third of the corpus has costs one row a task; no pairs within
a group are made. Then each line is compared word by word with the earliest one it met under each key, and goes only
if their edit distance holds: lines that meet by chance remove nothing. Hot keys are joined by broadcast, see joins.py.

Time and memory grow with a line's length, not its square: running hashes are folded in chunks of CHUNK words.

Edge cases: a null text has no lines and stays null; lines without a word are kept and never match; a null doc_id
counts as later than all others; rows with equal doc_id and text are one document and get one result; equal doc_ids
with different texts are ordered by a hash of the text; a text all of whose lines go becomes empty; columns of docs
that have the name of a result column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.llm.common import WORD, cut, without
from silt.llm.joins import join_unique

#: Words of the longer of two lines, at least, for one edit to be a similarity of 0.8.
MIN_NEAR = 5
#: Parts of a line of which one edit touches one alone.
PARTS = 2
#: Words over which running hashes are appended one by one.
CHUNK = 64
#: Bits of a variant's key that count (tests make keys collide).
KEY_BITS = -1
_SPACE = r"[\x20\x09-\x0D]+"


def _keys() -> str:
    """SQL: for each part, a hash of the words before and after it; one edit leaves one of them as it is.

    A part is a PARTS-th of the words, rounded down; if that is more than for a line one word shorter, the hashes for
    the shorter part are there too, so that both lines of an insertion have them.
    """
    out = []
    for n in ("n", "(n - 1)"):
        k = f"({n} div {PARTS})"
        for part in range(PARTS):
            ends = []
            if part:
                ends.append(f"substring_index(line, ' ', int({part} * {k}))")
            if part < PARTS - 1:
                ends.append(f"substring_index(line, ' ', -int({PARTS - 1 - part} * {k}))")
            key = f"xxhash64({part}, {k}, {', '.join(ends)})"
            out.append(key if n == "n" else f"if(n % {PARTS} = 0, {key}, null)")
    return f"if(n >= {MIN_NEAR - 1}, array({', '.join(out)}), null)"


def _variants(df: DataFrame) -> DataFrame:
    """line_key, key and place of each line (line_key, w) without each of its words in turn, and of the line itself at place -1.

    A line's hash is the exclusive or of a hash of each word and its place. Without word i it is that of b, the hashes
    with all places one lower, of b[i], and of what a and b differ in before i, a running fold.
    """
    chunk = f"""aggregate(sequence(q * {CHUNK}, least(size(v.a), (q + 1) * {CHUNK}) - 1), named_struct('sum', 0L, 'out', cast(array() as array<bigint>)),
        (s, i) -> named_struct('sum', s.sum ^ v.a[i] ^ v.b[i], 'out', array_append(s.out, s.sum)))"""
    before = """aggregate(v.chunks, named_struct('sum', 0L, 'out', cast(array() as array<bigint>)),
        (s, c) -> named_struct('sum', s.sum ^ c.sum, 'out', array_append(s.out, s.sum)), s -> s.out)"""
    variants = f"""concat(
        transform(flatten(transform(v.chunks, (c, q) -> transform(c.out, x -> x ^ v.before[q]))),
            (x, i) -> named_struct('key', xxhash64(size(v.a) - 1, x ^ v.b[i] ^ v.all_b) & {KEY_BITS}L, 'place', i)),
        array(named_struct('key', xxhash64(size(v.a), v.all_a) & {KEY_BITS}L, 'place', -1)))"""
    # Each step is bound to v by a transform of its own: as a column, Catalyst could put it in place of its name in a
    # lambda and compute it for each word.
    steps = [
        "named_struct('a', transform(w, (x, i) -> xxhash64(x, i)), 'b', transform(w, (x, i) -> xxhash64(x, i - 1)))",
        f"""named_struct('a', v.a, 'b', v.b, 'all_a', aggregate(v.a, 0L, (s, x) -> s ^ x), 'all_b', aggregate(v.b, 0L, (s, x) -> s ^ x),
            'chunks', transform(sequence(0, (size(v.a) - 1) div {CHUNK}), q -> {chunk}))""",
        f"named_struct('a', v.a, 'b', v.b, 'all_a', v.all_a, 'all_b', v.all_b, 'chunks', v.chunks, 'before', {before})",
        f"if(size(v.a) >= {MIN_NEAR}, {variants}, slice({variants}, -1, 1))",
    ]
    value = f"array({steps[0]})"
    for step in steps[1:]:
        value = f"transform({value}, v -> {step})"
    out = df.select("line_key", F.explode_outer(F.expr(f"flatten({value})")).alias("v"))
    return out.select("line_key", "v.key", "v.place")


#: SQL: whether w.a and w.b, arrays of words, are at edit distance 1 at most, the longer one long enough; `at` is the first
#: place, from 1, at which they differ, null if there is none among those that both have.
_DIFFERS = "nullif(array_position(zip_with(w.a, w.b, (x, y) -> x <> y), true), 0)"
_NEAR = f"""greatest(size(w.a), size(w.b)) >= {MIN_NEAR} and abs(size(w.a) - size(w.b)) <= 1 and
    transform(array({_DIFFERS}), at -> at is null or (
        slice(w.a, int(at + if(size(w.a) >= size(w.b), 1, 0)), size(w.a)) = slice(w.b, int(at + if(size(w.b) >= size(w.a), 1, 0)), size(w.b))))[0]"""


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """line_key of those pairs (line_key, early) whose lines' edit distance holds; found: line_key and line."""
    pairs = cut(pairs.distinct())
    rows = pairs.groupBy("early").agg(F.count(F.lit(1)).alias("rows"))
    early = cut(rows.join(found.select(F.col("line_key").alias("early"), F.col("line").alias("other")), "early"))
    both = join_unique(pairs, early, "early", "rows", pairs.count(), "inner").join(found, "line_key")
    near = f"transform(array(named_struct('a', split(line, ' '), 'b', split(other, ' '))), w -> {_NEAR})[0]"
    return both.where(F.expr(near)).select("line_key")


def _plain(line) -> Column:
    """The line's words with one space between."""
    line = F.col(line) if isinstance(line, str) else line
    odd = line.startswith(" ") | line.endswith(" ")
    for x in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd |= line.contains(x)
    return F.when(odd, F.trim(F.regexp_replace(line, _SPACE, " "))).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """where (a line's place in the order), a key of the line's words, and hashes of its parts, for each line with words."""
    # Outer explodes: for inner ones Catalyst adds a filter on the array's size, which computes the array twice.
    line = F.posexplode_outer(F.split("text", "\n")).alias("at", "line")
    rows = docs.select("silt_order", "silt_doc", line).where(F.col("line").rlike(WORD))
    rows = rows.select(F.struct("silt_order", "silt_doc", "at").alias("where"), _plain("line").alias("line"))
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    rows = rows.withColumn("n", (spaces + 1).cast("int"))
    return rows.select("where", F.xxhash64("line").alias("line_key"), F.expr(_keys()).alias("halves"))


def removable(docs: DataFrame) -> DataFrame:
    """silt_doc and keep, the places of its lines that stay, for documents that keep a line with words.

    docs: silt_order, silt_doc, text.
    """
    each = _lines(docs).groupBy("line_key").agg(F.min("where").alias("where"), F.first("halves").alias("halves"))
    each = cut(each)
    n_lines = each.count()
    firsts = each.select("line_key", "where")
    # Lines that agree with another one but for a part.
    keys = each.select("line_key", F.explode_outer("halves").alias("half")).where("half is not null")
    ends = (F.min("line_key") < F.max("line_key")).alias("many")
    shared = cut(keys.groupBy("half").agg(ends, F.count(F.lit(1)).alias("lines")).where("many").drop("many"))
    near = join_unique(keys, shared, "half", "lines", n_lines, "inner").select("line_key").distinct()
    # Their words come from their first places, read off the documents.
    at = (
        cut(near.join(firsts, "line_key"))
        .groupBy(F.col("where.silt_doc").alias("silt_doc"))
        .agg(F.collect_list(F.struct("where.at", "line_key")).alias("places"))
    )
    place = F.explode_outer("places").alias("place")
    found = docs.join(at, "silt_doc").select(F.split("text", "\n").alias("lines"), place)
    found = found.select(F.col("place.line_key").alias("line_key"), _plain(F.expr("lines[place.at]")).alias("line"))
    found = cut(found.dropDuplicates(["line_key"]))
    variants = _variants(found.select("line_key", F.split("line", " ").alias("w")))
    common = variants.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    met = cut(join_unique(variants, common, "key", "lines", n_lines, "inner").drop("lines").join(firsts, "line_key"))
    # Earliest whole line, earliest of all, and how many, under each key; then earliest at each place of a key.
    one = F.struct("where", F.col("line_key").alias("line"))
    whole = F.min(F.when(F.col("place") == -1, one)).alias("whole")
    by_key = cut(met.groupBy("key").agg(whole, F.min(one).alias("any"), F.count(F.lit(1)).alias("lines")))
    later = join_unique(met, by_key, "key", "lines", n_lines, "inner")
    to_whole = later.where("place >= 0 and whole.where < where").select("line_key", F.col("whole.line").alias("early"))
    from_whole = later.where("place = -1 and any.where < where").select("line_key", F.col("any.line").alias("early"))
    spots = met.where("place >= 0").select("line_key", "where", F.xxhash64("key", "place").alias("spot"))
    by_spot = spots.groupBy("spot").agg(F.min(one).alias("same"), F.count(F.lit(1)).alias("lines")).where("lines > 1")
    spots = join_unique(spots, cut(by_spot), "spot", "lines", n_lines, "inner")
    by_spot = spots.where("same.where < where").select("line_key", F.col("same.line").alias("early"))
    gone = _verified(to_whole.union(from_whole).union(by_spot), found)
    kept = firsts.join(gone.distinct(), "line_key", "left_anti")
    return kept.groupBy(F.col("where.silt_doc").alias("silt_doc")).agg(F.collect_list("where.at").alias("keep"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with its text less the lines that repeat an earlier one, and n_lines and n_removed (lines with words)."""
    added = ("silt_order", "silt_doc", "n_lines", "n_removed")
    base = without(docs, added)
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    base = base.withColumn("silt_order", order).withColumn("silt_doc", F.xxhash64("doc_id", "text"))
    keep = removable(base.select("silt_order", "silt_doc", "text"))
    lines = F.split("text", "\n")
    out = base.join(keep, "silt_doc", "left").withColumn("silt_lines", lines)
    blank = F.expr(f"filter(sequence(0, size(silt_lines) - 1), i -> not rlike(silt_lines[i], '{WORD.replace(chr(92), chr(92) * 2)}'))")
    out = out.withColumn("silt_blank", blank)
    stay = F.expr("array_sort(concat(silt_blank, coalesce(keep, cast(array() as array<int>))))")
    text = F.when(F.col("text").isNotNull(), F.array_join(F.transform(stay, lambda i: F.get("silt_lines", i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.expr("size(silt_lines) - size(silt_blank)"))
    out = out.withColumn("n_lines", n_lines.cast("bigint"))
    kept = F.when(F.col("keep").isNull(), F.lit(0)).otherwise(F.size("keep"))
    out = out.withColumn("n_removed", (F.col("n_lines") - kept).cast("bigint")).withColumn("text", text)
    names = [c for c in docs.columns if c.lower() not in added]
    return out.select(*[F.col(f"`{c}`") for c in names], "n_lines", "n_removed")
