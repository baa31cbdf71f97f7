"""Line dedup by a segment-partition edit join.

Distinct lines of at least ``SHORTEST`` characters are cut into one segment more than the ``EDITS``
allowed, so two lines within that distance share a segment. Every line indexes its own segments and
probes, for every length it can match, the substrings that can align with a segment there (shift
bounded by the edits left on either side). Pairs whose letter counts are too far apart are left out;
the rest are verified by edit distance over the band of 2 * EDITS + 1 diagonals, all of which one step
updates in parallel as bits of a word. An index key that ``CROWD`` lines share is found by a
frequent-items sketch and refined: its lines join on segments of what remains of them, and meet only if
their letter counts allow it. Links become classes through connected components; the first document of a class
keeps one line, all others of the class go. Lines under SHORTEST characters are duplicates only if equal: two
edits can turn most of them into any other.

Lines are told apart by 128-bit digests; distinct texts have numbers of their own in the join.

Defined cases: lines are compared without outer white space, blank ones do not count; a null text has no
lines; every row is a document of its own, also where rows repeat an id or are equal in all columns, of
which the first then keeps a shared line; a null id comes after all others; an empty table gives an empty
result; very long texts and lines are worked on as a whole; other columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytemill.llm.graph import components
from bytemill.llm.rows import small
from bytemill.llm.text import BLANKS, let, whole
from bytemill.plans.scratch import finish, stage

EDITS = 2
SHORTEST = 16
CROWD, CROWDS = 32, 4096
#: Lines whose class is broadcast because they are the most frequent, and most ids that are ever broadcast.
HEAVY = 512
#: The letters whose counts a sketch holds.
LETTERS = "etaonihsrdlucmpg"
FEW = 200_000


def trimmed(text: Column) -> Column:
    """The lines of a text that are not blank, without outer white space."""
    return F.filter(F.transform(F.split(whole(text), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def rows_of(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, lines), stored: every row under a number of its own, its lines as 128-bit digests in order."""
    number = F.monotonically_increasing_id() if "_row" not in docs.columns else F.col("_row")
    return stage(docs.select(number.alias("_row"), "doc_id", F.transform(trimmed(F.col("text")), _digest).alias("lines")), "rows")


def sketch(line: Column) -> Column:
    """Two bits for each of LETTERS: its count modulo four, coded so that neighbours differ in one bit.

    An edit moves at most two counts by one, so lines within EDITS differ in at most 2 * EDITS bits.
    """
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        count = (F.char_length(line) - F.char_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(3))
        code = F.call_function("shiftright", F.lit(0b10110100), count * 2).bitwiseAND(F.lit(3)).cast("long")
        out = out.bitwiseOR(F.shiftleft(code, 2 * k))
    return out


def _cut_rows(rows: DataFrame, table: list[tuple[int, int, int]]) -> DataFrame:
    """From (id, prefix, r): one row per (less, segment, shift) of the table and text r.

    Each takes the segment of a text that is ``less`` shorter, moved by ``shift``, under the key of that
    length, segment and substring. The table is data, so that the generated code stays small.
    """
    m = EDITS + 1
    choices = F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in table])
    out = rows.withColumn("c", F.explode(choices)).withColumn("n", F.char_length("r") - F.col("c.less"))
    size, late = F.floor(F.col("n") / m).cast("int"), F.col("n") % m + F.col("c.i") - m  # later segments are longer by one
    out = out.withColumns({"a": size * F.col("c.i") + F.greatest(F.lit(0), late) + F.col("c.shift"), "q": size + (late >= 0).cast("int")})
    out = out.filter((F.col("n") >= 0) & (F.col("a") >= 0) & (F.col("a") + F.col("q") <= F.char_length("r")))
    key = F.xxhash64("prefix", "n", "c.i", F.substr("r", F.col("a") + 1, F.col("q")))
    return out.select(key.alias("key"), "id", "r", "a", "q", (F.col("c.less") == 0).alias("same"))


def index_rows(rows: DataFrame) -> DataFrame:
    """The segments of every text."""
    return _cut_rows(rows, [(0, i, 0) for i in range(EDITS + 1)])


def probe_rows(rows: DataFrame) -> DataFrame:
    """The substrings that can align with a segment of a text up to EDITS shorter."""
    shifts = [(less, i, d) for less in range(EDITS + 1) for i in range(EDITS + 1) for d in range(max(-i, less - (EDITS - i)), min(i, less + (EDITS - i)) + 1)]
    return _cut_rows(rows, shifts)


def candidates(lines: DataFrame, used: list | None = None) -> DataFrame:
    """(u, v): ids of different lines that share an aligned segment; ``used`` gets the tables to forget afterwards.

    Under a crowded key, lines meet by the segments of what remains of them, and only if their letter
    counts allow it: many variants of one line share most of its text without being near each other.
    """
    rows = lines.select("id", F.lit(0).cast("long").alias("prefix"), F.col("line").alias("r"))
    indexed, probes = index_rows(rows), probe_rows(rows)
    top = indexed.agg(F.expr(f"approx_top_k(key, {CROWDS}, {8 * CROWDS})").alias("t")).select(F.explode("t").alias("t")).filter(F.col("t.count") >= CROWD)
    crowds = stage(top.select(F.col("t.item").alias("key")), "crowds", few=True)
    used = [] if used is None else used
    used.append(crowds)
    if crowds.isEmpty():
        return _meet(indexed, probes).distinct()
    crowds = F.broadcast(crowds)
    rest = F.concat(F.substr("r", F.lit(1), F.col("a")), F.substr("r", F.col("a") + F.col("q") + 1, F.char_length("r")))
    kept = ["id", F.col("key").alias("prefix"), rest.alias("r")]
    counted = stage(lines.select("id", "line").join(indexed.join(crowds, "key").select("id").unionByName(probes.join(crowds, "key").select("id")).distinct(), "id", "left_semi"), "crowd")
    used.append(counted)
    counted = counted.select("id", sketch(F.col("line")).alias("sketch"))
    again = index_rows(indexed.join(crowds, "key").select(kept)).join(counted, "id")
    asked = probe_rows(probes.join(crowds, "key").select(kept)).join(counted, "id")
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2 * EDITS
    plain = _meet(indexed.join(crowds, "key", "left_anti"), probes.join(crowds, "key", "left_anti"))
    return plain.unionByName(_meet(again, asked, near)).distinct()


def _meet(indexed: DataFrame, probes: DataFrame, near: Column | None = None) -> DataFrame:
    """Pairs under one key; near: a condition on their sketches x and y."""
    more = [] if near is None else ["sketch"]
    left = indexed.select("key", F.col("id").alias("u"), *[F.col(c).alias("x") for c in more])
    right = probes.select("key", F.col("id").alias("v"), "same", *[F.col(c).alias("y") for c in more])
    met = (left["key"] == right["key"]) & (F.col("u") != F.col("v")) & (~F.col("same") | (F.col("u") < F.col("v")))
    return left.join(right, met if near is None else met & near).select("u", "v")


def _past_common(x: Column) -> Column:
    """Struct (s, t) without the characters that both begin with, found by doubling steps downwards."""
    s, t = x["s"], x["t"]
    least = F.least(F.char_length(s), F.char_length(t))

    def step(p: Column, n: Column) -> Column:
        return F.when((p + n <= least) & (F.substr(s, p + 1, n) == F.substr(t, p + 1, n)), p + n).otherwise(p)

    steps = F.transform(F.sequence(F.floor(F.log2(least + 1)).cast("int"), F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return let(F.aggregate(steps, F.lit(0), step), lambda p: F.struct(F.substr(s, p + 1, F.char_length(s)).alias("s"), F.substr(t, p + 1, F.char_length(t)).alias("t")))


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance is at most ``edits``: the band's diagonals are the bits of one word per edit.

    What both begin or end with costs no edit and is left out first.
    """
    full = (1 << (2 * edits + 1)) - 1

    def search(x: Column) -> Column:
        s, t = x["s"], x["t"]

        def step(r: Column, i: Column) -> Column:
            here = F.get(s, i)
            match = F.lit(0)
            for o in range(2 * edits + 1):
                match = match + F.when(here == F.get(t, i + (o - edits)), F.lit(1 << o)).otherwise(F.lit(0))

            def rows(m: Column) -> Column:
                new = [r["r0"].bitwiseAND(m)]
                for d in range(1, edits + 1):
                    old = r[f"r{d - 1}"]
                    moved = r[f"r{d}"].bitwiseAND(m).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[d - 1], 1))
                    new.append(moved.bitwiseAND(F.lit(full)))
                return F.struct(*[v.alias(f"r{d}") for d, v in enumerate(new)])

            return let(match, rows)

        start = F.struct(*[F.lit(sum(1 << (edits + j) for j in range(d + 1))).alias(f"r{d}") for d in range(edits + 1)])
        end = F.size(t) - F.size(s) + edits
        inside = (end >= 0) & (end <= 2 * edits)
        finish = lambda r: F.call_function("getbit", r[f"r{edits}"], F.when(inside, end).otherwise(0)) == 1
        return F.when(inside, F.aggregate(F.sequence(F.lit(0), F.size(s) - 1), start, step, finish)).otherwise(False)

    def middles(x: Column) -> Column:
        n, m = F.char_length(x["s"]), F.char_length(x["t"])
        letters = F.struct(F.split(x["s"], "").alias("s"), F.split(x["t"], "").alias("t"))
        return F.when((n == 0) | (m == 0), n + m <= edits).otherwise(let(letters, search))

    def turned(x: Column) -> Column:
        return let(_past_common(x), lambda y: F.struct(F.reverse(y["s"]).alias("s"), F.reverse(y["t"]).alias("t")))

    return let(F.struct(a.alias("s"), b.alias("t")), lambda x: let(turned(x), lambda y: let(_past_common(y), middles)))


def links(docs: DataFrame) -> DataFrame:
    """(u, v), stored: digests of different lines of at least SHORTEST characters within EDITS of each other."""
    lines = docs.select(F.explode(trimmed(F.col("text"))).alias("line")).filter(F.char_length("line") >= SHORTEST).distinct()
    lines = stage(lines.withColumn("id", F.monotonically_increasing_id()), "lines")
    used = [lines]
    pairs = stage(candidates(lines, used), "pairs")
    asked = stage(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "asked")
    texts = lines.join(small(asked, FEW), "id", "left_semi")
    texts = stage(texts.withColumns({"sketch": sketch(F.col("line")), "h": _digest(F.col("line"))}), "texts")
    first = texts.select(F.col("id").alias("u"), F.col("line").alias("a"), F.col("sketch").alias("x"), F.col("h").alias("hu"))
    second = texts.select(F.col("id").alias("v"), F.col("line").alias("b"), F.col("sketch").alias("y"), F.col("h").alias("hv"))
    both = pairs.join(first, "u").join(second, "v").filter(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2 * EDITS)
    return finish(both.filter(within(F.col("a"), F.col("b"))).select(F.col("hu").alias("u"), F.col("hv").alias("v")), "links", *used, pairs, asked, texts)


def line_classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(h, root, keep, n, links), stored, of every line that is not alone in its class; equal lines share a digest h.

    keep is the row whose line stays: the one of the smallest id, null last, then the first row. links counts the
    other lines within EDITS.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    counted = rows.select("_row", "doc_id", F.explode("lines").alias("h")).groupBy("h").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    linked = links(docs)
    joined = components(linked)
    member = joined.select(F.col("v").alias("h"), F.col("u").alias("root")).unionByName(joined.select(F.col("u").alias("h"), F.col("u").alias("root")).distinct())
    degree = linked.select(F.explode(F.array("u", "v")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("links"))
    member = stage(member.join(degree, "h"), "members")
    many = counted.join(member, "h", "left").filter("n > 1 or root is not null")
    many = stage(many.withColumns({"root": F.coalesce("root", "h"), "links": F.coalesce("links", F.lit(0).cast("long"))}), "many")
    least = many.groupBy("root").agg(F.min("first").alias("keep"))
    return finish(many.join(least, "root").select("h", "root", "keep", "n", "links"), "classes", linked, joined, member, many)


def _tagged(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(_row, pos, h, root, keep, links) of the lines in classes; the most frequent lines meet theirs by broadcast."""
    heavy = F.broadcast(stage(classes.orderBy(F.desc("n"), "h").limit(HEAVY), "heavy", few=True).drop("n"))
    lines = rows.select("_row", F.posexplode("lines").alias("pos", "h"))
    return lines.join(heavy, "h").unionByName(lines.join(heavy, "h", "left_anti").join(classes.drop("n"), "h"))


def line_counts(docs: DataFrame) -> DataFrame:
    """A row for each of docs: doc_id, n_lines, n_removed, n_shared, n_links and first_ids.

    n_shared counts its lines that have a class, n_links the links of its different lines, and first_ids lists the
    ids of the rows in which the lines of its classes stay.
    """
    rows = rows_of(docs)
    classes = line_classes(docs, rows)
    per = _tagged(rows, classes).groupBy("_row", "h", "root", "keep", "links").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("_row", "root", "keep").agg(F.sum("c").alias("c"), F.sum("links").alias("links"))
    stays = (F.col("_row") == F.col("keep.row")).cast("long")
    gone = per.groupBy("_row").agg(F.sum(F.col("c") - stays).alias("gone"), F.sum("c").alias("shared"), F.sum("links").alias("links"), F.sort_array(F.collect_set("keep.id")).alias("ids"))
    none = F.lit(0).cast("long")
    out = rows.select("_row", "doc_id", F.size("lines").cast("long").alias("n_lines")).join(gone, "_row", "left")
    out = out.select("doc_id", "n_lines", *[F.coalesce(c, none).alias(n) for c, n in (("gone", "n_removed"), ("shared", "n_shared"), ("links", "n_links"))], F.coalesce("ids", F.array().cast("array<long>")).alias("first_ids"))
    return finish(out, "line-counts", rows, classes)


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go; lines that stay are trimmed and keep their order."""
    packed = stage(docs.select("doc_id", "text", F.struct("*").alias("_docs"), F.monotonically_increasing_id().alias("_row")), "numbered")
    rows = rows_of(packed)
    tagged = _tagged(rows, line_classes(packed, rows))
    first = F.row_number().over(Window.partitionBy("_row", "root").orderBy("pos")) == 1
    goes = tagged.withColumn("_first", first).filter(~((F.col("_row") == F.col("keep.row")) & F.col("_first")))
    gone = stage(goes.groupBy("_row").agg(F.collect_set("pos").alias("_gone")), "gone")
    lines = F.filter(trimmed(F.col("text")), lambda x, k: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), k))
    out = packed.join(gone, "_row", "left").withColumn("_text", F.array_join(lines, "\n"))
    return out.select(*[F.col("_text").alias("text") if c == "text" else F.col("_docs")[c].alias(c) for c in docs.columns])
