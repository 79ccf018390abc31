"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its different lower-cased words. A line is removed if an earlier line (by row, then by line number) has
the same set or a set with a Jaccard similarity of `threshold` or more; whether that earlier line itself is removed does not
matter. Lines without a word are never removed.

1. Texts are cut once, into a table of the hashes of each line's words, which the counts, the sets and the numbers of lines are read from and which then goes.
   Word rarity: counts of all words in BUCKETS hash buckets, kept as powers of two. (Rarity, hash) numbers in ascending order begin with a set's rarest words.
2. Equal sets (two hashes of 64 bits): the first occurrence stays and stands for its set.
3. Prefixes: similar sets share c + 1 of their n - ceil(threshold * n) + 1 + c rarest words. These are dealt into c classes by hash, so similar sets share
   two words of a class: the keys of the join are pairs of words of a prefix, which stay rare where single words are frequent. c grows with the set's size
   by bands; a set is keyed for its own band and, if a similar set may lie there, for the one below.
4. Most keys belong to one set only, and most others to two that are unlike. They are counted first, in numbers of fixed size, among them the
   exclusive or of parity bitmaps: of two sets its bits are a lower bound of their difference. A bit table of fixed size keeps the rows of the other keys.
5. The sets of a key of CROWD sets or fewer are gathered, and each two of them pass the length filter, the positional filter and the bitmaps or are dropped.
   In larger keys each set meets the earliest one of its key (the head) under the same filters. The nearest of each set is verified. This resolves
   groups of near copies without pairing their members.
6. Sets that are still open meet the others of step 5, and in larger keys all earlier sets with one of their keys, under the same filters, and are verified.

Verification compares whole sets. They are cut again, once for steps 5 and 6, from the few lines concerned, which a bit table of fixed size
picks while the texts are read, so texts are shuffled once, in the end, and only those that lose a line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared

THRESHOLD = 0.8
BUCKETS = 1 << 17
#: Bits of the tables that tell shared keys, and lines or rows that are wanted.
KEY_BITS, ID_BITS = 1 << 26, 1 << 24
#: Keys of more sets than this are those of crowds, whose members share many keys.
CROWD = 16
#: The smallest size and the classes of the bands below the last ones, which double: from 16 * CLASSES words on, an eighth of the band's smallest size.
#: With one class a prefix is as short as pairs allow: fixed words of a template make no key by themselves if more than 1 - threshold of a line's words are its own, and rarer.
SMALL_CLASSES, MEDIUM, CLASSES = 1, 16, 8
#: Classes of one part of a long prefix.
PART_CLASSES = 64
#: White space and ASCII punctuation without blanks and line ends.
MARKS = r"""[\t\x0B\f\r!"#$%&'()*+,./:;<=>?@\[\\\]\^_`{|}~\-]+"""
WORDY = r"""[^ \t\n\x0B\f\r!"#$%&'()*+,./:;<=>?@\[\\\]\^_`{|}~\-]"""
_HASH_BITS = 26
#: Hashes are written as they are: a dictionary and compression take more time than they save.
HASHES = {"compression": "none", "parquet.enable.dictionary": "false"}


def rarity(rows: DataFrame) -> Column:
    """A literal array: the power of two of each bucket's number of words in rows (rid, text) or their cut_lines(), above _HASH_BITS zeros. Its size is BUCKETS, whatever the input."""
    words = cut_lines(rows).select(F.explode("words").alias("w"))
    counts = words.groupBy(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("id")).agg(F.floor(F.log2(F.count("*").cast("double"))).cast("int").alias("p"))
    found = counts.toArrow()  # BUCKETS rows at most
    powers = [0] * BUCKETS
    for k, p in zip(found["id"].to_pylist(), found["p"].to_pylist(), strict=True):
        powers[k] = min(p, 31) << _HASH_BITS
    return F.split(F.lit(",".join(map(str, powers))), ",").cast("array<int>")


def plain(text: Column | str) -> Column:
    """A text or line in lower case, with blanks and line ends as its only separators."""
    return F.regexp_replace(F.lower(text), MARKS, " ")


def word_set(line: Column | str) -> Column:
    """The hashes of the different words of a plain() line in ascending order."""
    # a pattern of one character is not compiled for each line; numbers that can't be null are sorted as primitives
    hashes = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    return F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def rarest_first(words: Column | str, powers: Column) -> Column:
    """A set's words as numbers of 31 bits in order of rarity. Words that share a number stand side by side, each with its own place, so prefixes hold what they must."""

    def pack(h: Column) -> Column:
        power = F.get(powers, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.coalesce(power.bitwiseOR(h.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)).cast("int")), F.lit(0))

    return F.sort_array(F.transform(words, pack))


def cut_lines(rows: DataFrame) -> DataFrame:
    """id (rid, line_no) and words (the set) of each line with a word of rows (rid, text); rows that are cut already stay as they are."""
    if "words" in rows.columns:
        return rows
    lines = all_lines(rows.select("rid", plain("text").alias("text"))).where(F.col("line").rlike("[^ ]"))
    return lines.select("id", word_set("line").alias("words"))


def all_lines(rows: DataFrame) -> DataFrame:
    """id (rid, line_no) and line of each line of rows (rid, text)."""
    return rows.select("rid", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select(F.struct("rid", "line_no").alias("id"), "line")


def band(n: Column) -> Column:
    """The band of sets of n words."""
    return F.when(n < MEDIUM, 0).when(n < 16 * CLASSES, 1).otherwise(F.floor(F.log2(n.cast("double") / (16 * CLASSES))).cast("int") + 2)


def classes(band: Column) -> Column:
    return F.when(band == 0, SMALL_CLASSES).when(band == 1, CLASSES).otherwise(F.call_function("shiftleft", F.lit(2 * CLASSES), band - 2))


def prefix_size(n: Column, c: Column, threshold: float) -> Column:
    """How many of a set's rarest words hold c + 1 of a similar set's; 0 for sets so small that only their equals are similar."""
    least = math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else 1 << 30
    return F.when(n >= least, F.least(n, n - F.ceil(n * threshold - 1e-9).cast("int") + 1 + c)).otherwise(0)


def join_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """sets (n, tokens: hashes of the longest prefix in order of rarity, ...) with a row for each key, a pair of words, and at, the place of the later one, counted from 0 (null in long prefixes, which are dealt out in parts)."""
    own, below = band(F.col("n")), band(F.ceil(F.col("n") * threshold - 1e-9).cast("int"))
    each = sets.where(F.size("tokens") > 0).select("*", F.explode(F.array_distinct(F.array(own, below))).alias("band"))
    size = prefix_size(F.col("n"), classes(F.col("band")), threshold)
    each = each.withColumn("dealt", F.when(F.size("tokens") > size, F.slice("tokens", F.lit(1), size)).otherwise(F.col("tokens")))
    # words of a class are in one part; parts bound the pairs that are looked at
    parts = F.greatest(F.lit(1), (classes(F.col("band")) / PART_CLASSES).cast("int"))
    many = each.select("*", parts.alias("parts")).where("parts > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    many = many.withColumn("dealt", F.filter("dealt", lambda t: F.pmod(t, F.col("parts")) == F.col("part"))).drop("parts", "part")
    each = each.where(parts == 1).withColumn("whole", F.lit(True)).unionByName(many.withColumn("whole", F.lit(False)))
    # the numbers of classes are powers of two, so a class is the last bits of a hash
    each = each.withColumn("mask", classes(F.col("band")) - 1).drop("tokens")
    both = each.select("*", F.posexplode("dealt").alias("i", "a")).select("*", F.posexplode("dealt").alias("j", "b"))
    both = both.where((F.col("i") < F.col("j")) & (F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.col("mask")) == 0))
    # a and b in order of rarity, which is one for all sets
    return both.select(F.xxhash64("band", "a", "b").alias("key"), F.when(F.col("whole"), F.col("j")).alias("at"), *(c for c in sets.columns if c != "tokens"))


def bit_table(hashes: DataFrame, bits: int) -> DataFrame:
    """One row: so many bits in an array of longs, with the bits of the numbers h set."""
    h = F.pmod("h", F.lit(bits))
    words = hashes.select(h.alias("h")).select(F.expr("h div 64").alias("id"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("w"))
    every = hashes.sparkSession.range(bits // 64).select("id", F.lit(0).cast("long").alias("w"))
    dense = words.unionByName(every).groupBy(F.expr("id div 4096").alias("part"), "id").agg(F.bit_or("w").alias("w"))
    packed = dense.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("a"))
    return packed.agg(F.expr("transform(flatten(sort_array(collect_list(struct(part, a))).a), x -> x.w)").alias("bits"))


def may_be_in(table: DataFrame, hashed: Column, bits: int) -> Column:
    """Whether the number's bit is set in a bit table."""
    h = F.pmod(hashed, F.lit(bits))
    return F.call_function("shiftright", F.element_at(table.scalar(), (F.floor(h / 64) + 1).cast("int")), (h % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def unique_ids(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    plain = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    return plain["n"] == plain["known"] and docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def with_row_ids(docs: DataFrame) -> DataFrame:
    """docs with a unique rid, ascending in order of the rows: doc_id itself, or numbers where doc_ids are null or repeated."""
    if unique_ids(docs):
        return docs.withColumn("rid", F.col("doc_id").cast("long"))
    return shared.table(docs.orderBy("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()), "rows")


def apart(a: str, b: str) -> Column:
    """A lower bound of the number of elements in which two sets differ, from their bitmaps."""
    return F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))


def may_be_similar(a: str, b: str, threshold: float) -> Column:
    """Length filter, positional filter and bitmaps for two rows with one key."""
    na, nb, pa, pb = (F.col(f"{s}.{c}") for c in ("n", "at") for s in (a, b))
    common = F.when(pa.isNull() | pb.isNull(), F.least(na, nb)).otherwise(F.least(na - pa, nb - pb) + F.least(pa, pb))
    return (
        (F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9)
        & (common >= F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9))
        & (apart(a, b) <= F.floor((na + nb) * (1 - threshold) / (1 + threshold) + 1e-9))
    )


def wanted_sets(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """A shared table of id and words of the lines of rows (rid, text) with these ids, and of some that only share a bit with one."""
    table = shared.table(bit_table(ids.select(F.xxhash64("id.rid", "id.line_no").alias("h")), ID_BITS), "bits")
    lines = all_lines(rows).where(may_be_in(table, F.xxhash64("id.rid", "id.line_no"), ID_BITS))
    sets = shared.table(lines.select("id", word_set(plain("line")).alias("words")), "sets", **HASHES)
    shared.forget(table)
    return sets


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """A shared table: y of each pair (x, y: ids) that is similar enough by sets (id, words)."""
    both = pairs.join(sets.select(F.col("id").alias("y"), F.col("words").alias("wy")), "y").join(sets.select(F.col("id").alias("x"), F.col("words").alias("wx")), "x")
    common = F.size(F.array_intersect("wx", "wy"))
    return shared.table(both.where(common >= (F.size("wx") + F.size("wy") - common) * threshold - 1e-9).select("y").distinct(), "similar")


def first_lines(rows: DataFrame, powers: Column, threshold: float) -> DataFrame:
    """A shared table of the different sets of rows (rid, text) or their cut_lines(): id (of the first line with that set), n, bits, tokens."""

    def flip(a: Column, x: Column) -> Column:
        return a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))

    # whether an odd number of the set's hashes have this value in their last 6 bits
    parity = F.aggregate("words", F.lit(0).cast("long"), flip)
    n = F.size("words")
    size = prefix_size(n, classes(band(n)), threshold)
    tokens = F.slice(rarest_first("words", powers), F.lit(1), size)
    sets = cut_lines(rows).select(F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("check"), F.struct("id", n.alias("n"), parity.alias("bits"), tokens.alias("tokens")).alias("s"))
    return shared.table(sets.groupBy("h", "check").agg(F.min("s").alias("s")).select("s.*"), "firsts")


def heads_met(live: DataFrame, threshold: float) -> DataFrame:
    """A shared table of the rows (key, rid, line_no, n, bits, at) of live whose pair with the earliest of their key passes the filters (near; x: that one's id), and of those with a key of three sets or more."""
    set_ = F.struct("rid", "line_no", "n", "at", "bits")
    heads = live.groupBy("key").agg(F.min(set_).alias("h"), F.count("*").alias("size")).where("size > 1")
    met = live.select("key", set_.alias("l")).join(heads, "key")
    near = (id_of("h") < id_of("l")) & may_be_similar("h", "l", threshold)
    # a key of two sets has no other pair than that of its head
    met = met.select("key", "size", "l.*", near.alias("near"), F.when(near, apart("h", "l")).alias("apart"), F.when(near, id_of("h")).alias("x"))
    return shared.table(met.where(F.col("near") | (F.col("size") > 2)), "met")


def pairs_of_few(live: DataFrame, threshold: float) -> DataFrame:
    """y, x (ids, x the earlier one) and apart of each two rows (key, rid, line_no, n, bits, at) of live with one key, which at most CROWD have, that pass the filters."""
    # dealt out before they are gathered, as hardly any rows of a task share a key
    sets = live.repartition("key").groupBy("key").agg(F.collect_list(F.struct("rid", "line_no", "n", "at", "bits")).alias("sets")).where(F.size("sets") > 1)
    both = sets.select("sets", F.explode("sets").alias("h")).select("h", F.explode("sets").alias("l"))
    both = both.where((id_of("h") < id_of("l")) & may_be_similar("h", "l", threshold))
    return both.select(id_of("l").alias("y"), apart("h", "l").alias("apart"), id_of("h").alias("x"))


def shared_keys(firsts: DataFrame, threshold: float) -> DataFrame:
    """The keys of firsts (n, bits, tokens) that belong to three sets or more, or to two that may be similar by their bitmaps, and whether they are those of crowds."""
    one = F.lit(1 << 32)
    keyed = join_keys(firsts.select("n", "bits", "tokens"), threshold).select("key", (one + F.col("n")).alias("n"), "bits")
    # numbers of fixed size only, so that the sets are counted in a hash table; of two sets the exclusive or is their difference
    counts = keyed.groupBy("key").agg(F.sum("n").alias("n"), F.bit_xor("bits").alias("bits")).where(F.col("n") >= 2 << 32)
    most = F.floor(F.col("n").bitwiseAND(F.lit((1 << 32) - 1)) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    return counts.where((F.col("n") >= 3 << 32) | (F.bit_count("bits") <= most)).select("key", (F.col("n") >= (CROWD + 1) << 32).alias("crowd"))


def later_copies(rows: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """The ids of firsts with a similar set that is earlier: a shared table."""
    keys = shared.table(shared_keys(firsts, threshold).select(F.col("key").alias("h"), "crowd"), "keys")
    table = shared.table(bit_table(keys.select("h"), KEY_BITS), "bits")
    crowds = shared.table(bit_table(keys.where("crowd").select("h"), KEY_BITS), "crowds")
    shared.forget(keys)
    keyed = join_keys(firsts.select("id.rid", "id.line_no", "n", "bits", "tokens"), threshold).where(may_be_in(table, F.col("key"), KEY_BITS))
    live = shared.table(keyed.withColumn("crowd", may_be_in(crowds, F.col("key"), KEY_BITS)), "live")
    shared.forget(table, crowds)

    # a key that shares its bit with a crowd's goes with the crowds, whose way is right for keys of any size
    met = heads_met(live.where("crowd").drop("crowd"), threshold)
    by_heads = met.where("near").select(id_of().alias("y"), "apart", "x").unionByName(pairs_of_few(live.where("not crowd"), threshold))
    by_heads = shared.table(by_heads.groupBy("y", "x").agg(F.min("apart").alias("apart")), "near")
    shared.forget(live)
    nearest = shared.table(by_heads.groupBy("y").agg(F.min(F.struct("apart", "x")).alias("c")).select("c.x", "y"), "nearest")
    many = met.where(F.col("size") > 2)
    ids = by_heads.select(F.explode(F.array("x", "y")).alias("id")).unionByName(many.select(id_of().alias("id")))
    sets = wanted_sets(ids, rows)
    by_head = verified(nearest, sets, threshold)

    done = by_head.select(F.col("y").alias("id"))
    others = by_heads.select("x", "y").join(by_head, "y", "left_anti").join(nearest, ["x", "y"], "left_anti")
    # members of a crowd share many keys: a pair of them is taken up at its smallest common one
    many = many.join(many.groupBy("rid", "line_no").agg(F.sort_array(F.collect_list("key")).alias("keys")), ["rid", "line_no"])
    members = many.select("key", "keys", id_of().alias("id"), "n", "at", "bits")
    a, b = members.alias("a"), members.join(done, "id", "left_anti").alias("b")
    first_key = F.get(F.array_intersect("a.keys", "b.keys"), F.lit(0)) == F.col("a.key")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & may_be_similar("a", "b", threshold) & first_key)
    pairs = pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).join(nearest, ["x", "y"], "left_anti")
    pairs = shared.table(pairs.unionByName(others).distinct(), "pairs")
    shared.forget(met, by_heads, nearest)
    by_key = verified(pairs, sets, threshold)
    found = shared.table(by_head.unionByName(by_key).select(F.col("y").alias("id")), "later")
    shared.forget(by_head, pairs, by_key, sets)
    return found


def id_of(alias: str = "") -> Column:
    dot = f"{alias}." if alias else ""
    return F.struct(F.col(f"{dot}rid").alias("rid"), F.col(f"{dot}line_no").alias("line_no"))


def kept_lines(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A shared table of rid and kept, the numbers of the lines with words that stay, for each row of rows (rid, text) that loses a line."""
    cut = shared.table(cut_lines(rows), "cut", **HASHES)
    counts = shared.table(cut.groupBy(F.col("id.rid").alias("rid")).agg(F.count("*").cast("int").alias("wordy")), "wordy")
    firsts = first_lines(cut, rarity(cut), threshold)
    shared.forget(cut)
    later = later_copies(rows, firsts, threshold)
    stay = firsts.select("id").join(later, "id", "left_anti").groupBy(F.col("id.rid").alias("rid")).agg(F.collect_list("id.line_no").alias("kept"))
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    found = shared.table(counts.join(stay, "rid", "left").select("rid", "wordy", kept.alias("kept")).where(F.col("wordy") > F.size("kept")).select("rid", "kept"), "kept")
    shared.forget(firsts, later, counts)
    return found


def dedup(docs: DataFrame, threshold: float = THRESHOLD, removed: str | None = None) -> DataFrame:
    """docs with the text of each row without its removed lines (n_chars follows, where there is such a column).

    Rows are ordered by doc_id (nulls first), then by text; equal rows in any order, as they are alike. All rows stay, also those that lose all their lines, whose text is
    then empty. Null texts stay null, an empty table gives no rows. Texts and lines may be of any length: work grows with a line's words, and a text is one row.
    Other columns stay, whatever they are called. With `removed` a column of that name has the ascending numbers of the removed lines (or null). threshold: 0.7 to 1.
    """
    if not 0.7 <= threshold <= 1:
        raise ValueError("threshold must be between 0.7 and 1")
    others = [c for c in docs.columns if c.lower() != "text"]
    given = with_row_ids(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*(f"`{c}`" for c in others)).alias("row")))
    lists = kept_lines(given.where("text is not null").select("rid", "text"), threshold)
    table = shared.table(bit_table(lists.select(F.xxhash64("rid").alias("h")), ID_BITS), "bits")
    may = may_be_in(table, F.xxhash64("rid"), ID_BITS)
    whole = given.where(~may).select("row", "text", F.lit(None).cast("array<int>").alias("removed"))
    # lines are cut before the join, so that they are not cut again for each line
    cut = given.where(may).select("rid", "row", F.split("text", "\n", -1).alias("lines")).join(lists, "rid", "left")
    wordy = F.array_compact(F.transform("lines", lambda line, i: F.when(line.rlike(WORDY), i)))
    cut = cut.select("row", "lines", F.when(F.col("kept").isNotNull(), F.array_except(wordy, F.coalesce("kept", F.array().cast("array<int>")))).alias("removed"))
    stays = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed"))
    stays = F.when(F.size("removed") < F.size("lines"), stays).otherwise(F.array().cast("array<int>"))
    cut = cut.select("row", "removed", F.when(F.col("removed").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n")).alias("text"))
    out = cut.unionByName(whole)

    def column(name: str) -> Column:
        if name.lower() == "text":
            return F.col("text").alias(name)
        own = F.col("row").getField(name)
        if name.lower() == "n_chars":
            own = F.when(F.col("removed").isNull(), own).otherwise(F.length("text")).cast(docs.schema[name].dataType)
        return own.alias(name)

    return out.select(*(column(c) for c in docs.columns), *([F.col("removed").alias(removed)] if removed else []))
