"""Line deduplication by an exact set-similarity join, in DataFrame functions alone.

A line's tokens are its distinct k-word shingles, lower-cased; a line of fewer words is one
token, its whole sequence. A line is removed if a line that comes earlier, by (doc_id, line
number), has a Jaccard similarity of at least the threshold with it, whether or not that line
is itself removed. Lines of fewer than ``least_words`` words (1: none but blank ones) stay.

1. *Keys.* One map over the text gives each line two independent 64-bit hashes of its words
   (its key), the size of its token set and its least token hashes, as many as must hold
   ``ALIKE`` of any set that is near (a prefix by hash), or all that it must share if these are fewer.
2. *Repeats.* Lines with equal keys are one set, placed at its first line; the others go.
3. *Suspects.* Only sets that share so many of these tokens with different sets can be near any.
   While such tokens are few (``MOST_BITMAP``) a bitmap, two bits each, picks the lines; beyond it, a join.
4. *Rarity.* The suspects' lines are read again. Tokens are ordered by how many suspects have
   them, counted exactly; tokens of one suspect alone come first and are only counted. Those
   of the half with the greater hashes are not counted and come last, by hash. The leading
   tokens in this order are the prefix from here on.
5. *Leaders.* Sets that share their least or greatest token hash, or a leading token, compare with
   two sets of their bucket, the first and the one whose shared tokens begin soonest: one pair
   each. What matches is removed, and needs no further comparison as the later of a pair. The
   rest meets the leaders among itself in a second round.
6. *Join.* Sets meet on their leading tokens, under the length filter, the positional
   filter and a bound by bits: each token sets one of ``64 * WORDS``, and a bit that the other
   set lacks is a token that it lacks. One side is always a set not removed yet, so that a hot group of near-equal
   lines, which its leaders have removed, does not meet itself.
7. *Verify.* A pair goes on if its common leading tokens and all that can follow them reach
   the threshold; then whole token sets are compared.

Tokens have 64 bits; keys do not depend on them. Texts of suspects are picked by a bitmap of fixed size.

Defined cases: a null text has no lines; an empty text has one empty line, which stays; line
breaks are LF alone; a null id comes before all others; rows equal in id and text are one
document and get one result, rows that share an id alone stand at one place and do not remove
each other's lines of the same number; an empty table gives an empty result;
other columns, whatever their names, pass through ``deduplicated`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BITMAP_BITS = 25
#: Tokens in a bitmap at most (2^26 bits, 16 MB to broadcast); more are met by a shuffled join.
MOST_BITMAP = 1 << 21
#: Tokens with hashes up to this one, the lesser half of all, are counted.
BELOW = -1
#: Tokens that a suspect's leading ones must share with other sets'; that many less one are led with besides.
ALIKE = 3
#: Rounds of leaders before the join.
ROUNDS = 2
#: 64-bit words of a set's bits.
WORDS = 4
BITS = [f"bits{j}" for j in range(WORDS)]
OTHER_SPACE = "\t\x0b\x0c\r"
#: Lower bits that hold a word's place in its line; no array is longer.
PLACE_BITS = 31
PLACE = ["doc_id", "line_no", "text_hash"]


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))


def _plain(df: DataFrame, c: str) -> DataFrame:
    """df with column c in lower case and one space for any run of white space but line breaks."""
    # Four searches of bytes cost a quarter of a regular expression's one.
    odd = F.lit(False)
    for space in OTHER_SPACE:
        odd = odd | F.col(c).contains(space)
    df = df.withColumn(c, F.when(odd, F.translate(F.lower(c), OTHER_SPACE, " " * len(OTHER_SPACE))).otherwise(F.lower(c)))
    return df.withColumn(c, F.when(F.col(c).contains("  "), F.regexp_replace(c, " {2,}", " ")).otherwise(F.col(c)))


def _lines(docs: DataFrame, least_words: int) -> DataFrame:
    """doc_id, text_hash, line_no and the line, its words with one space between them, of every line of at least so many words."""
    lines = _plain(docs.where("text is not null"), "text").select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line != ''")
    return lines.where(F.col("line").rlike(f"^(?:[^ ]++ ){{{least_words - 1}}}")) if least_words > 1 else lines


def _with_tokens(df: DataFrame, k: int) -> DataFrame:
    """df with ``tokens``, the distinct hashes of the shingles of ``line``, in place of it; fewer words are one."""
    df = df.withColumn("hashes", F.transform(F.split("line", " "), lambda w: F.xxhash64(w))).drop("line")
    n = F.size("hashes")
    firsts = F.slice("hashes", F.lit(1), F.greatest(n - F.lit(k - 1), F.lit(0)))
    rolled = F.transform(firsts, lambda w, i: F.xxhash64(w, *[F.get("hashes", i + F.lit(j)) for j in range(1, k)]))
    # No branch's array may hold nulls by its type: such arrays are made distinct as plain numbers.
    return df.withColumn("tokens", F.when(n >= k, F.array_distinct(rolled)).otherwise(F.array(F.xxhash64("hashes")))).drop("hashes")


def _least_overlap(a: str, b: str, num: int, den: int) -> str:
    """The overlap that sets of sizes a and b need."""
    return f"(({num} * ({a} + {b}) + {num + den - 1}) div {num + den})"


def _probe(n: str, num: int, den: int) -> str:
    """Leading tokens, in any order that all sets share, one of which any set that is near has among its own."""
    return f"({n} - (({num} * {n} + {den - 1}) div {den}) + 1)"


def _fits_by_bits(a: str, b: str, num: int, den: int) -> str:
    """Whether sets with sizes n{a}, n{b} and bits {a}0, {a}1, ... can overlap enough: a bit that one lacks is a token it lacks."""
    least = lambda x, y: f"n{x} - ({' + '.join(f'bit_count({x}{j} & ~{y}{j})' for j in range(WORDS))})"
    return f"least({least(a, b)}, {least(b, a)}) >= {_least_overlap(f'n{a}', f'n{b}', num, den)}"


def _named(x: str) -> list[Column]:
    return [F.col(c).alias(f"{x}{j}") for j, c in enumerate(BITS)]


def _alike(n: str, num: int, den: int) -> str:
    """Tokens that a set has in common with any set that is near, among so many less one leading tokens more than _probe's."""
    return f"least({ALIKE}, ({num} * {n} + {den - 1}) div {den})"


def _signed(lines: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Each line's place and key, and leading tokens in an order that all lines share: by the hash of a token's first word.

    So only the leading tokens are made. A place in the line stands in the lower bits of its word's hash, which sort as
    plain numbers. Tokens that begin with the last word taken are all taken, as their order among themselves is open. A
    token that comes again in its line counts once; where too few are left by that, all of the line's tokens lead.
    """
    low = (1 << PLACE_BITS) - 1
    spot = lambda w, i: F.shiftleft(F.xxhash64(w), PLACE_BITS).bitwiseOR(i)
    df = lines.select(*PLACE, F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(0x5EED), "line").alias("k2"), F.transform(F.split("line", " "), spot).alias("spots"))
    # One token is a whole short line: equal words have equal keys, so it need not be looked up.
    df = df.withColumn("m", F.greatest(F.size("spots") - F.lit(k - 1), F.lit(0)))
    df = df.withColumn("probe", F.expr(f"{_probe('m', num, den)} + {_alike('m', num, den)} - 1").cast("int"))
    df = df.withColumn("sorted_", F.sort_array(F.slice("spots", F.lit(1), F.col("m"))))
    # The end is sorted in, so that what stands before it is found without a lambda; it is never null, so that plain numbers are sorted.
    df = df.withColumn("end", F.coalesce(F.get("sorted_", F.col("probe") - 1).bitwiseOR(low), F.lit((1 << 63) - 1)))
    df = df.withColumn("taken", (F.array_position(F.sort_array(F.array_append("sorted_", F.col("end"))), F.col("end")) - 1).cast("int"))
    token = lambda i: F.xxhash64(*[F.shiftright(F.get("spots", i + F.lit(j)), PLACE_BITS) for j in range(k)])
    at = F.transform(F.slice("sorted_", F.lit(1), F.col("taken")), lambda s: s.bitwiseAND(low).cast("int"))
    df = df.withColumn("some", F.array_distinct(F.transform(at, token)))
    short = (F.col("taken") < F.col("m")) & (F.size("some") < F.col("probe"))
    every = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("m") - 1), token))
    return df.select(*PLACE, "k1", "k2", F.when(short, every).otherwise(F.col("some")).alias("prefix"))


def _bitmap(spots: DataFrame) -> DataFrame:
    """(word_, bits_): the numbers s as a bitmap, 64 a row."""
    return spots.groupBy(F.shiftright("s", 6).alias("word_")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits_"))


def _in_bitmap(df: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Rows of df whose s is in the bitmap; the bitmap is broadcast, its size is bounded by that of s."""
    met = df.withColumn("word_", F.shiftright("s", 6)).join(F.broadcast(bitmap), "word_")
    return met.where("(shiftright(bits_, cast(s & 63 as int)) & 1L) = 1").drop("s", "word_", "bits_")


def _shared(every: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows of every whose token may be (few tokens) or is (many) one of the repeated ones."""
    n = repeated.count()
    if n > MOST_BITMAP:
        return every.join(repeated, "token")
    mask = F.lit((1 << min(26, max(10, (64 * n - 1).bit_length()))) - 1).cast("long")
    spots = [t.bitwiseAND(mask).cast("int") for t in (F.col("token"), F.xxhash64("token"))]
    bitmap = _bitmap(repeated.select(F.explode(F.array(*spots)).alias("s")))
    return _in_bitmap(_in_bitmap(every.withColumn("s", spots[0]), bitmap).withColumn("s", spots[1]), bitmap)


def _token_sets(sets: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(sid, tokens) of every set, from the line where it stands."""
    wanted = sets.groupBy(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")).agg(F.collect_list(F.struct("line_no", "sid")).alias("at_"))
    spot = lambda i, h: F.pmod(F.xxhash64(i, h), F.lit(1 << BITMAP_BITS)).cast("int")
    spots = sets.select(spot(F.col("doc_id"), F.col("text_hash")).alias("s"))
    met = _in_bitmap(docs.withColumn("s", spot(F.col("doc_id"), F.col("text_hash"))), _bitmap(spots)).select("doc_id", "text_hash", "text")
    met = met.join(wanted, [met["doc_id"].eqNullSafe(wanted["w_id"]), met["text_hash"] == wanted["w_hash"]])
    # Split below the explode, once for each text.
    split = met.withColumn("lines_", F.split("text", "\n")).select("lines_", F.explode("at_").alias("at_"))
    lines = _plain(split.select("at_.sid", F.element_at("lines_", F.col("at_.line_no") + 1).alias("line")), "line").withColumn("line", F.trim("line"))
    # Rows equal in id and text are one document.
    return _with_tokens(lines, k).select("sid", "tokens").dropDuplicates(["sid"])


def _summed(tokens: DataFrame) -> DataFrame:
    """(sid, low, high, bits) of every set: its least and greatest token, and a bit for each token."""
    bit = "shiftleft(1L, cast(t & 63 as int))"
    bits = [F.expr(f"bit_or(if((shiftright(t, 6) & {WORDS - 1}) = {j}, {bit}, 0L))").alias(c) for j, c in enumerate(BITS)]
    return tokens.select("sid", F.explode("tokens").alias("t")).groupBy("sid").agg(F.min("t").alias("low"), F.max("t").alias("high"), *bits)


def _by_rarity(tokens: DataFrame, below: int, num: int, den: int) -> DataFrame:
    """(sid, n, alone, leading, low, high, bits): of each set's prefix the tokens that others have, in order, and how many stand before them.

    The order: hashes under ``below``, by the number of sets that have them and then by hash,
    before all others by hash. So the frequencies of a share of the tokens suffice; a set with
    too few of these goes on with its others, for which their order stands in. Sets that no
    other can be near are left out.
    """
    sized = tokens.select("sid", F.size("tokens").alias("n"), F.sort_array("tokens").alias("sorted_"))
    sized = sized.withColumn("probe", F.expr(_probe("n", num, den)).cast("int"))
    # Sorted by hash, counted ones come first; others count only as far as the prefix can reach.
    sized = sized.withColumn("counted", (F.array_position(F.sort_array(F.array_append("sorted_", F.lit(below + 1))), F.lit(below + 1)) - 1).cast("int"))
    rows = sized.select("sid", "n", "probe", "counted", F.explode(F.expr("slice(sorted_, 1, greatest(probe, counted))")).alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # One row a token on the side that is hashed: no key of it is hot.
    met = rows.join(counts.hint("shuffle_hash"), "token")
    order = F.struct(F.when(F.col("token") <= F.lit(below), F.col("df")).otherwise(F.lit(1 << 62)).alias("df"), "token")
    shared = met.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "probe", "counted")], F.sort_array(F.collect_list(order)).alias("shared"))
    # Others that no set shares would stand later than all these, so they are not counted.
    shared = shared.withColumn("alone", F.col("counted") - F.size(F.filter("shared", lambda s: s["token"] <= F.lit(below))))
    leading = F.expr("slice(shared, 1, cast(greatest(0, probe - alone) as int))")
    return shared.select("sid", "n", "alone", leading.alias("leading")).where("size(leading) > 0").join(_summed(tokens), "sid")


def _able(pairs: DataFrame, ranked: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose common leading tokens, and all that may follow them, can reach the threshold.

    Common tokens up to the lesser of both last leading tokens stand among both sets' leading
    ones; of the set that ends there, only the tokens that stand neither before nor among its
    leading ones are left. Its prefix may hold more: tokens that were not counted.
    """
    last = F.element_at("leading", -1)
    of = lambda x: ranked.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), last.alias(f"l{x}"), F.expr("n - alone - size(leading)").alias(f"r{x}"), F.col("leading.token").alias(f"t{x}"), *_named(x))
    both = pairs.join(of("b"), "b").join(of("a"), "a").withColumn("c", F.size(F.array_intersect("ta", "tb")))
    both = both.where(_fits_by_bits("a", "b", num, den))
    return both.where(F.expr(f"c + if(la <= lb, ra, rb) >= {_least_overlap('na', 'nb', num, den)}")).select("a", "b")


def _verified(pairs: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """(b): the later sets of pairs (a earlier, b later) that reach the threshold."""
    left = tokens.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").withColumn("both_", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.expr(f"{den} * both_ >= {num} * (size(ta) + size(tb) - both_)")).select("b").distinct()


def removed_lines(
    df: DataFrame, k: int = 5, threshold: tuple[int, int] = (8, 10), least_words: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, line_no) of every line to remove."""
    num, den = threshold
    scratch = Scratch(df.sparkSession)
    docs = _documents(df, id_col, text_col)
    lines = scratch.cut(_signed(_lines(docs, least_words), k, num, den), "lines")

    # A prefix token of one set alone meets nothing. Sets are told apart by their keys, so that repeats of a line do not count.
    prefixes = lines.select("k1", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("k1").alias("one"), F.max("k1").alias("other"))
    repeated = scratch.cut(prefixes.where("one != other").select("token"), "repeated")
    # Copies of a line have the same tokens at the same positions, so shared ones are told apart by these; beyond 64 they are not counted.
    every = lines.select("k1", "k2", *PLACE, F.size("prefix").alias("size"), F.posexplode("prefix").alias("at", "token"))
    suspects = _shared(every, repeated).groupBy("k1", "k2").agg(F.min(F.struct(*PLACE)).alias("p"), F.min("size").alias("size"), F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("at"))
    # A prefix is no longer than its set, and asks for no more in common than the set does.
    suspects = suspects.where(f"size > 64 or bit_count(at) >= {_alike('size', num, den)}")

    # Sets in the order of their places: a range shuffle, then numbers that rise with it.
    sets = scratch.cut(suspects.select("k1", "k2", "p.*"), "unordered")
    order = [F.col("doc_id").asc_nulls_first(), "line_no", "k1", "k2"]
    sets = sets.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("sid", F.monotonically_increasing_id())
    sets = scratch.cut(sets, "sets")
    # From here on of all lines only places and keys are read.
    keys = scratch.cut(lines.select(*PLACE, "k1", "k2"), "keys")
    scratch.drop("unordered", "repeated", "lines")
    tokens = scratch.cut(_token_sets(sets, docs, k), "tokens")
    ranked = scratch.cut(_by_rarity(tokens, BELOW, num, den), "ranked")

    # Leaders, in rounds: what is gone neither leads nor follows in the next.
    keyed = ranked.select("sid", "alone", F.explode(F.array_distinct(F.concat(F.array("low", "high"), "leading.token"))).alias("key"))
    keyed, gone = scratch.cut(keyed, "buckets"), df.sparkSession.createDataFrame([], "b long")
    for step in range(ROUNDS):
        left = keyed.join(gone, F.col("sid") == F.col("b"), "left_anti")
        chosen = left.groupBy("key").agg(F.min("sid").alias("first"), F.min(F.struct("alone", "sid")).alias("least"), F.count("*").alias("met")).where("met > 1")
        stars = left.join(chosen, "key").select("sid", F.explode(F.array("first", "least.sid")).alias("a")).where("a < sid")
        stars = scratch.cut(_able(stars.select("a", F.col("sid").alias("b")).distinct(), ranked, num, den), "stars")
        gone = scratch.cut(gone.union(_verified(stars, tokens, num, den)), f"gone-{step}")

    # The join. The smaller set is found by its index prefix, the larger looks up its probe prefix.
    marked = ranked.join(gone.select(F.col("b").alias("sid"), F.lit(True).alias("gone")), "sid", "left")
    marked = marked.select("sid", "n", "alone", F.coalesce("gone", F.lit(False)).alias("gone"), *BITS, F.posexplode("leading").alias("at", "lead"))
    marked = scratch.cut(marked.select("sid", "n", F.expr("alone + at").alias("pos"), "lead.token", "gone", *BITS), "postings")
    index_length = F.expr(f"n - ((2 * {num} * n + {num + den - 1}) div {num + den}) + 1")
    larger = lambda d: d.select(F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), "token", *_named("x"))
    smaller = lambda d: d.where(F.col("pos") < index_length).select(F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), "token", *_named("y"))
    fits = f"ny <= nx and {den} * ny >= {num} * nx and least(nx - px, ny - py) >= {_least_overlap('nx', 'ny', num, den)} and {_fits_by_bits('x', 'y', num, den)}"
    kept = marked.where("not gone")
    later_larger = larger(kept).join(smaller(marked), "token").where(f"y < x and {fits}").selectExpr("y as a", "x as b")
    later_smaller = smaller(kept).join(larger(marked), "token").where(f"x < y and {fits}").selectExpr("x as a", "y as b")
    opened = scratch.cut(_able(later_larger.union(later_smaller).distinct(), ranked, num, den), "opened")
    more = scratch.cut(_verified(opened, tokens, num, den), "more")

    # Of every key its first line stays, unless an earlier line is near it.
    out = gone.union(more).join(sets.select(F.col("sid").alias("b"), "k1", "k2"), "b").select("k1", "k2", F.lit(True).alias("gone"))
    firsts = keys.groupBy("k1", "k2").agg(F.min(F.struct(*PLACE)).alias("p"), F.count("*").alias("met"))
    judged = firsts.join(out, ["k1", "k2"], "left").where("met > 1 or gone").selectExpr("k1", "k2", "p.doc_id as f_id", "p.line_no as f_no", "coalesce(gone, false) as gone")
    whole = keys.join(judged, ["k1", "k2"])
    whole = whole.where("gone or not (doc_id <=> f_id and line_no = f_no)").select("doc_id", "text_hash", "line_no")
    return scratch.last(whole, "removed")


def _by_document(gone: DataFrame) -> DataFrame:
    lists = gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    return lists.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), "gone")


def line_report(df: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed_lines (numbers from 0, comma-joined)."""
    gone = _by_document(removed_lines(df, **options))
    docs = _documents(df, options.get("id_col", "doc_id"), options.get("text_col", "text"))
    docs = docs.select("doc_id", "text_hash", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))
    met = docs.join(gone, [docs["doc_id"].eqNullSafe(gone["g_id"]), docs["text_hash"] == gone["g_hash"]], "left")
    listed = F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit(""))
    n_removed = F.coalesce(F.size("gone"), F.lit(0))
    return met.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.greatest(n_removed, F.lit(0)).cast("long").alias("n_removed"), listed.alias("removed_lines"))


def deduplicated(df: DataFrame, drop_emptied: bool = True, **options) -> DataFrame:
    """df with its text less the removed lines; rows that lose every line go if ``drop_emptied``."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    gone = _by_document(removed_lines(df, **options))
    text = F.col(text_col).cast("string")
    # The row goes along as one column, so that no name of it can clash.
    keyed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))
    met = keyed.join(gone, [F.col("id").eqNullSafe(F.col("g_id")), F.col("hash") == F.col("g_hash")], "left")
    met = met.withColumn("lines", F.split("text", "\n"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    # The array is named twice, so that it is split once and not for each line.
    left = F.when(F.size("lines") > 0, F.transform(numbers, lambda i: F.element_at("lines", i + 1)))
    met = met.withColumn("left", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(left))
    if drop_emptied:
        met = met.where("gone is null or size(left) > 0")
    new = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(F.array_join("left", "\n"))
    return met.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])
