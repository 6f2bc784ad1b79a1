"""Near-duplicate lines: an exact set-similarity join in DataFrame functions.

A line is the set of its words. Two lines are alike if the Jaccard similarity of their sets
is at least 4/5. Words are ordered from rare to frequent; alike lines share a word in their
prefixes (all but the last ``ceil(4n/5) - 1`` words), which makes the join key. Length and
place of the common word bound the overlap, and so does a bitmap of the words; the few pairs
left are verified on the full sets. A line goes if an earlier line is like it.

Equal sets are one class first, so copies cost a combined aggregate and no pairs. Near
copies are first compared with the earliest class that has the same two neighbours in its
prefix; what that settles takes no part in the full join as the later line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostloom.llm.common import perhaps_among, settled
from hostloom.operators.keyed import settle

#: Least Jaccard similarity of alike lines, as a fraction, so that every bound is exact.
NUMERATOR, DENOMINATOR = 4, 5
#: Buckets of hashed words whose frequencies give the order of rarity (a bounded table).
BUCKET_BITS = 16
#: Pairs of neighbours in the prefix by which lines meet the earliest class first.
FIRST = 3
#: Pairs with a line of more than LONG words are told apart by two bitmaps, which lines of more than NEAR words have.
LONG = 64
NEAR = LONG * NUMERATOR // DENOMINATOR
#: Word counts and places in packed rows end here; longer sets pass every filter.
MOST = (1 << 16) - 1
#: Blanks of the word definition besides the space.
BLANKS = "\t\n\x0b\x0c\r"
#: Those that a line may have.
WITHIN = BLANKS.replace("\n", "")


def split_words(text: Column, blanks: str = BLANKS) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``, and empty strings where blanks meet."""
    plain = text
    for blank in blanks:
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    # Few lines have a blank besides the space. Searches of the bytes are cheaper than a pattern, which decodes the line first.
    some = reduce(Column.__or__, [F.contains(text, F.lit(blank)) for blank in blanks])
    return F.split(F.when(some, plain).otherwise(text), " ")


def words(line: Column) -> Column:
    """64-bit hashes of the different words ``[^\\x20\\x09-\\x0D]+`` of a line of :func:`lines`.

    For a plain projection: below a generator or inside another function of array elements
    Spark interprets the whole expression and boxes every number.
    """
    return F.array_remove(F.array_distinct(F.transform(split_words(line, WITHIN), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of all lines that ``\\n`` separates."""
    return docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _ceil(n: Column, a: int, b: int) -> Column:
    """ceil(n * a / b) of whole numbers."""
    return F.ceil(n * a / b).cast("int")


def frequencies(docs: DataFrame) -> DataFrame:
    """``bucket, n``: words by bucket of their hash, counted over all lines."""
    word = lines(docs).select(F.explode(split_words(F.col("line"), WITHIN)).alias("word"))
    bucket = F.xxhash64("word").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1).cast("bigint")).cast("int")
    return word.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def rarity(counts: DataFrame) -> Column:
    """Steps of rarity by bucket: at most ``2 ** BUCKET_BITS`` numbers.

    Three steps to each doubling are fine enough for an order and fit seven bits; the JVM keeps
    one object for each number that small, so look-ups stay in its caches. A literal, since
    functions of array elements take no subqueries; only the plan that writes the sets holds it.
    """
    steps = ["0"] * (1 << BUCKET_BITS)
    found = counts.select("bucket", (F.log2("n") * 3).cast("int").alias("step")).toArrow()
    for bucket, step in zip(found["bucket"].to_pylist(), found["step"].to_pylist(), strict=True):
        steps[bucket] = str(step)
    return F.split(F.lit(",".join(steps)), ",").cast("array<bigint>")


def _parity(words: Column, half: bool) -> Column:
    """A parity bit per word in 64 bits: of all words, or of those whose hash has a certain bit unset.

    The bits come from a table of 128: fewer steps a word than shifts and a filter. An element needs no cast of its place.
    """
    bits = [1 << k if k < 63 else -1 << 63 for k in range(64)]
    table = F.split(F.lit(",".join(map(str, bits + (64 * [0] if half else bits)))), ",").cast("array<bigint>")
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a.bitwiseXOR(table[w.bitwiseAND(F.lit(127).cast("bigint"))]))


def line_sets(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id, line_no, class, n, sketch, half, prefix`` of every line with a word.

    ``class`` hashes the set. ``prefix`` has the rarest words, enough for every alike line to
    share one; sets of up to three words are alike only if equal, so theirs is empty.
    ``sketch`` has a parity bit per word: sets differ in at least as many words as their
    sketches in bits. For long lines 64 bits tell little, so ``half`` is that of half the words;
    with the sketch it gives the other half's.
    """
    steps, low = rarity(counts), F.lit((1 << BUCKET_BITS) - 1).cast("bigint")
    # Rarity first, then 56 bits of the word: one number, so that one sort gives the order and the set.
    # Ranks are never null, which lets the sort take plain numbers.
    step = lambda w: F.coalesce(F.get(steps, w.bitwiseAND(low)), F.lit(0).cast("bigint"))
    rank = lambda w: F.shiftleft(step(w), 56).bitwiseOR(F.shiftrightunsigned(w, 8))
    # `settle` gets ready columns only, see `words`. It keeps the words out of the ranks' function, and the filter from computing both again.
    hashed = settle(lines(docs).select("doc_id", "line_no", words(F.col("line")).alias("words")), F.col("words"), keep=["doc_id", "line_no"])
    ranked = hashed.select("doc_id", "line_no", F.sort_array(F.transform("words", rank)).alias("words"))
    sets = settle(ranked, F.col("words"), keep=["doc_id", "line_no"]).where("size(words) > 0")
    sketch, n = _parity(F.col("words"), False), F.size("words")
    half = F.when(n > NEAR, _parity(F.col("words"), True))
    few = F.slice("words", F.lit(1), F.when(n > 3, n - _ceil(n, NUMERATOR, DENOMINATOR) + 1).otherwise(0))
    prefix = F.transform(few, lambda r: r.bitwiseAND(F.lit((1 << 32) - 1)))
    return sets.select("doc_id", "line_no", F.xxhash64("words", n).alias("class"), n.alias("n"), sketch.alias("sketch"), half.alias("half"), prefix.alias("prefix"))


def classes(sets: DataFrame) -> DataFrame:
    """One row per different set: ``class, n, sketch, half, prefix, copies`` and its first place."""
    same = [F.first(c).alias(c) for c in ("n", "sketch", "half", "prefix")]
    first = sets.groupBy("class").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), *same, F.count(F.lit(1)).alias("copies"))
    return first.select("class", "n", "sketch", "half", "prefix", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"))


def _could_be(a: str, b: str, long: bool) -> Column:
    """Bitmap, length and place filters on packed rows named ``a`` and ``b``, which share a word.

    The overlap of alike sets of n and m words is at least ``(n + m) * 4 / 9``, so they differ
    in at most ``(n + m) / 9`` words. Only short arithmetic stands here, the most selective
    first: a long condition is not compiled and far slower.
    """
    x, y = F.col(f"{a}.key"), F.col(f"{b}.key")
    n, m = _n(x), _n(y)
    every = F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch"))
    bits = F.bit_count(every)
    if long:
        one = F.col(f"{a}.half").bitwiseXOR(F.col(f"{b}.half"))
        bits = F.bit_count(one) + F.bit_count(every.bitwiseXOR(one))
    few = bits * (NUMERATOR + DENOMINATOR) <= (n + m) * (DENOMINATOR - NUMERATOR)
    place = F.least(n - _at(x), m - _at(y)) * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR
    return few & (m * DENOMINATOR >= n * NUMERATOR) & (n * DENOMINATOR >= m * NUMERATOR) & place


def _key(word: Column, at: Column, done: Column) -> Column:
    """A word, the size of its set, its place there and whether the line is done, in one number."""
    n = F.least("n", F.lit(MOST)).cast("bigint")
    place = F.when(F.col("n") < MOST, at).otherwise(0)
    return F.shiftleft(word, 32).bitwiseOR(F.shiftleft(n, 16)).bitwiseOR((place * 2 + done).cast("bigint"))


def packed(known: DataFrame) -> DataFrame:
    """``key, doc_id, spot, sketch, half``: a row for each word of the prefix.

    Most rows of the join are these, and one number is half of what four take. ``spot`` holds
    the word before this one in the prefix, in 32 bits, above the 31 bits of the line number;
    it is negative for a first word.
    """
    each = known.select("*", F.posexplode("prefix").alias("at", "word"))
    before = F.when(F.col("at") > 0, F.shiftleft(F.get("prefix", F.col("at") - 1), 31)).otherwise(F.lit(-1 << 63))
    spot = before.bitwiseOR(F.col("line_no").cast("bigint"))
    return each.select(_key(F.col("word"), F.col("at"), F.col("done")).alias("key"), "doc_id", spot.alias("spot"), "sketch", "half")


def _line(spot: Column) -> Column:
    return spot.bitwiseAND(F.lit((1 << 31) - 1).cast("bigint")).cast("int")


def _begins(a: Column, b: Column) -> Column:
    """Not both words follow the same word: only there a pair is made, once per stretch of common words.

    What holds at a word of a stretch holds at the words before it, since earlier places leave more overlap.
    """
    return (F.shiftrightunsigned(a.bitwiseXOR(b), 31) != 0) | (a < 0)


def witnesses(known: DataFrame) -> DataFrame:
    """``key, doc_id, line_no, sketch, half``: a row for each of :data:`FIRST` pairs of neighbours in the prefix.

    The pairs with the least hashes are taken, so that lines with nearly the same prefix take the same ones.
    """
    size = F.size("prefix")
    pairs = F.zip_with(F.slice("prefix", F.lit(1), F.greatest(size - 1, F.lit(0))), F.slice("prefix", F.lit(2), size), lambda a, b: F.xxhash64(a, b))
    # The pairs as a column first, since a generator would interpret the sort; `settle` keeps its test for none from sorting again.
    kept = ["n", "doc_id", "line_no", "sketch", "half"]
    sorted_ = known.select(*kept, F.slice(F.sort_array(pairs), 1, FIRST).alias("least"))
    each = settle(sorted_, F.col("least"), keep=kept).select("*", F.explode("least").alias("pair"))
    return each.select(_key(F.col("pair"), F.lit(0), F.lit(0)).alias("key"), "doc_id", "line_no", "sketch", "half")


def _word(key: Column) -> Column:
    return F.shiftright(key, 32).cast("int")


def _n(key: Column) -> Column:
    return F.shiftright(key, 16).bitwiseAND(F.lit(MOST).cast("bigint")).cast("int")


def _at(key: Column) -> Column:
    return F.shiftright(key, 1).bitwiseAND(F.lit(MOST >> 1).cast("bigint")).cast("int")


def _pairs(rows: DataFrame, late: str, early: str) -> DataFrame:
    """The pairs of places, later and earlier, of joined rows."""
    sides = ((late, "late"), (early, "early"))
    return rows.select(*[F.col(f"{side}.{c}").alias(f"{name}_{short}") for side, name in sides for c, short in (("doc_id", "doc"), ("line_no", "line"))])


def first_pairs(known: DataFrame) -> DataFrame:
    """Each class with the earliest one that has one of its :func:`witnesses`, if they could be alike."""
    rows = witnesses(known)
    # Bands of length begin elsewhere for every third pair, so that one edge doesn't part lines for all of theirs.
    band = F.floor(F.log(_n(F.col("key")).cast("double")) * 4 + F.pmod(_word(F.col("key")), F.lit(3)) / 3)
    row = F.struct("key", "doc_id", "line_no", "sketch", "half")
    head = F.first(row).over(Window.partitionBy(_word(F.col("key")), band).orderBy("doc_id", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = rows.select(row.alias("r"), head.alias("h")).where(F.struct("h.doc_id", "h.line_no") < F.struct("r.doc_id", "r.line_no"))
    alike_bits = _could_be("r", "h", False) & F.coalesce(_could_be("r", "h", True), F.lit(True))
    return settled(_pairs(both.where(alike_bits), "r", "h").distinct())


def flagged(known: DataFrame, done: DataFrame) -> DataFrame:
    """``known`` with ``done``: 1 for places among the later ones of ``done``, else 0.

    A bounded bitmap tells most lines from those that may be done; only the latter are joined.
    """
    places = done.select(F.col("late_doc").alias("doc_id"), F.col("late_line").alias("line_no"))
    maybe = perhaps_among(places, ["doc_id", "line_no"])
    checked = known.where(maybe).join(places.withColumn("done", F.lit(1)), ["doc_id", "line_no"], "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return known.where(~maybe).withColumn("done", F.lit(0)).unionByName(checked)


def other_pairs(known: DataFrame, done: DataFrame) -> DataFrame:
    """All pairs that could be alike whose later place isn't among ``done``.

    Pairs of which both lines have more than NEAR words meet in one join, where two bitmaps
    tell them apart; all others, whose lines have up to LONG words, in the other.
    """
    # Written once: both joins read it on both sides, and each plan holds one look-up of what is done.
    rows = settled(flagged(known, done))
    found = None
    for long in (False, True):
        some = packed(rows.where(F.col("n") > NEAR if long else F.col("n") <= LONG))
        a, b = some.alias("a"), some.alias("b")
        line, other = _line(F.col("a.spot")), _line(F.col("b.spot"))
        earlier = (F.col("b.doc_id") < F.col("a.doc_id")) | ((F.col("b.doc_id") == F.col("a.doc_id")) & (other < line))
        # The flag stands in a condition on both sides, so that they stay one shuffle of the same rows.
        open_ = F.col("a.key").bitwiseAND(F.lit(1).cast("bigint")) + F.col("b.key") * 0 < 1
        once = _begins(F.col("a.spot"), F.col("b.spot")) & _could_be("a", "b", long)
        if not long:
            once &= F.least(_n(F.col("a.key")), _n(F.col("b.key"))) <= NEAR
        met = a.join(b, (_word(F.col("a.key")) == _word(F.col("b.key"))) & open_ & earlier & once)
        both = met.select(F.col("a.doc_id").alias("late_doc"), line.alias("late_line"), F.col("b.doc_id").alias("early_doc"), other.alias("early_line"))
        found = both if found is None else found.unionByName(both)
    return settled(found.distinct())


def alike(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``late_doc, late_line`` of pairs whose full sets are alike.

    Bounded bitmaps of the documents and places that pairs name keep all other texts from being
    cut into lines and all other lines out of the shuffle; they let a few too many through,
    which the join drops.
    """
    places = pairs.select(F.col("late_doc").alias("doc_id"), F.col("late_line").alias("line_no")).union(pairs.select("early_doc", "early_line")).distinct()
    places = settled(places)
    wanted = lines(docs.where(perhaps_among(places, ["doc_id"]))).where(perhaps_among(places, ["doc_id", "line_no"]))
    # Written once: the two joins below would read all texts again each.
    sets = settled(wanted.select("doc_id", "line_no", words(F.col("line")).alias("words")).join(places, ["doc_id", "line_no"]))
    late = sets.select(F.col("doc_id").alias("late_doc"), F.col("line_no").alias("late_line"), F.col("words").alias("a"))
    early = sets.select(F.col("doc_id").alias("early_doc"), F.col("line_no").alias("early_line"), F.col("words").alias("b"))
    both = pairs.join(late, ["late_doc", "late_line"]).join(early, ["early_doc", "early_line"])
    common = F.size(F.array_intersect("a", "b"))
    return settled(both.where(common * DENOMINATOR >= (F.size("a") + F.size("b") - common) * NUMERATOR).select("late_doc", "late_line").distinct())


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no`` (lines from 0) of every line that is like an earlier one.

    Earlier means a smaller doc_id, or the same and a smaller line number; whether the
    earlier line goes itself doesn't matter. Lines without words and lines of rows with a
    null doc_id neither go nor count. Rows that share a doc_id are one document: equal lines
    with equal numbers are one place.
    """
    docs = docs.select("doc_id", "text")
    sets = settled(line_sets(docs, frequencies(docs)))
    many = settled(sets.groupBy("class").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("class"))
    # Most sets occur once. A bounded bitmap tells them from those that may have copies, so that only the latter are grouped.
    maybe = perhaps_among(many, ["class"])
    grouped = settled(classes(sets.where(maybe)))
    columns = ["n", "sketch", "half", "prefix", "doc_id", "line_no"]
    known = sets.where(~maybe).select(columns).unionByName(grouped.select(columns))
    place = F.struct(F.col("s.doc_id").alias("doc_id"), F.col("s.line_no").alias("line_no"))
    firsts = grouped.where("copies > 1").select("class", F.struct("doc_id", "line_no").alias("first"))
    copies = sets.where(maybe).select("class", "doc_id", "line_no").alias("s").join(firsts, "class").where(place > F.col("first")).select("doc_id", "line_no")
    done = alike(docs, first_pairs(known))
    rest = alike(docs, other_pairs(known, done))
    near = done.unionByName(rest).select(F.col("late_doc").alias("doc_id"), F.col("late_line").alias("line_no"))
    return copies.unionByName(near).distinct()


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines of :func:`repeated_lines`, all columns; ``n_chars``, if there, follows the text.

    Rows that lose nothing stay as they are. A row that loses all lines stays with an empty text.
    """
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.collect_list("line_no").alias("_hl_gone"))  # at most a document's lines
    both = docs.join(gone.withColumnRenamed("doc_id", "_hl_id"), docs["doc_id"] == F.col("_hl_id"), "left")
    split = F.split("text", "\n")
    left = F.array_join(F.filter(split, lambda x, k: ~F.array_contains("_hl_gone", k)), "\n")
    text = F.when(F.col("_hl_gone").isNull(), F.col("text")).otherwise(left)
    size = F.when(F.col("_hl_gone").isNull(), F.col("n_chars")).otherwise(F.length(text)) if "n_chars" in docs.columns else None
    columns = {"text": text, "n_chars": size}
    types = dict(docs.dtypes)
    return both.select(*[columns[c].cast(types[c]).alias(c) if columns.get(c) is not None else docs[c] for c in docs.columns])
