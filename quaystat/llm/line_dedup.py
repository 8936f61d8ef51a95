"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

A line's shingles are its runs of SHINGLE characters. Signatures take the runs of characters from the beginning of each word
to the end of the next (longer than a shingle, so that unlike lines share fewer of them), of lines with few words all shingles;
candidates from the bands are confirmed on all shingles of both lines. Built-in expressions only.

Text moves only where it must: a filter of fixed size (bits) lets lines and documents stay where they are
that cannot have a partner; what it lets through is joined exactly.

Lines of a band are held against one of them, the hub. What is linked to the hub is settled; a line that is unlike it
can still be like another of its lines, and is held against those by the sets in which both differ from the hub,
which are small where the lines are near (see across_hubs).
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystat.llm.bitfilter import bits
from quaystat.llm.common import free_name, written
from quaystat.llm.linkage import components

SHINGLE, SIMILARITY = 8, 0.8
BANDS, ROWS = 11, 3
#: Differences of one hub's lines that are looked through together.
BLOCK = 1 << 15
#: Lines with fewer pairs of words, or with more characters for each, are signed by all their shingles, lines near
#: these bounds both ways.
FEW_WORDS, LONG_WORDS = 8, 24


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, no, line, short, key) for each line with a word; rows that share an id are told apart by tag.

    key stands for the line; short is cheaper and only spares work.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    out = df.filter(df[id_col].isNotNull()).select(df[id_col].alias("doc"), F.hash(text).alias("tag"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    return out.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("short", F.xxhash64("line")).withColumn("key", F.unhex(F.md5("line")))


def shingles(line: Column, k: int = SHINGLE) -> Column:
    """All runs of k characters; of a shorter line the line itself."""
    return F.when(F.length(line) < k, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def signed(src: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, short, doc, no, n, bands) for each distinct line, or two rows for a line that is signed both ways.

    doc and no tell its first place, n how often it stands. One hash orders the shingles; the value of a MinHash
    function is the hash nearest to its constant, by exclusive or. Any shingle of two lines' union is the nearest
    with equal chance, so values agree as often as the lines are similar, at one operation each. Lines meet by key
    once: what follows is grouped where it lies. Words are cut by their blanks and paired by place, which takes no regular expression.
    """
    once = src.groupBy("key").agg(F.first("line").alias("line"), F.first("short").alias("short"), F.min(F.struct("doc", "no")).alias("at"), F.count("*").alias("n"))
    line, words = F.col("line"), F.array_remove(F.split("line", " "), "")
    bound = F.greatest(F.lit(FEW_WORDS), F.length(line) / LONG_WORDS)
    place = ["key", "short", F.col("at.doc").alias("doc"), F.col("at.no").alias("no"), "n"]
    out = once.select(*place, "line", words.alias("words"))
    pairs = F.size("words") - 1
    ways = F.array(
        F.struct(F.lit(0).alias("way"), F.when(pairs >= bound, F.col("words")).alias("x")),
        F.struct(F.lit(1).alias("way"), F.when(pairs < 1.3 * bound, shingles(line, k)).alias("x")),
    )
    by = ["key", "short", "doc", "no", "n", "way"]
    out = out.select(*by[:-1], F.explode(ways).alias("s")).filter("s.x is not null").select(*by[:-1], "s.way", "s.x")
    # Way 0 takes each word with the next, way 1 each shingle with itself.
    out = out.select(*by, "x", F.explode(F.sequence(F.lit(0), F.size("x") - 2 + F.col("way"))).alias("i"))
    out = out.select(*by, F.hash(F.get("x", F.col("i")), F.get("x", F.col("i") + 1 - F.col("way"))).alias("h"))
    rng = random.Random(20_240_611)
    mins = [F.min(F.col("h").bitwiseXOR(F.lit(rng.randint(-(2**31), 2**31 - 1)))).alias(f"m{j}") for j in range(bands * rows)]
    low = out.groupBy(*by).agg(*mins)
    return low.select(*by[:-1], F.array(*(F.xxhash64("way", F.lit(b), *(f"m{b * rows + r}" for r in range(rows))) for b in range(bands))).alias("bands"))


def hashed(line: Column, k: int = SHINGLE) -> Column:
    """The set of a line's shingles as 64-bit hashes. Four bytes for each character: a run is found by its place."""
    cut = lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(b) - 4 * k + 1, F.lit(1)), F.lit(4)), lambda i: F.xxhash64(F.call_function("substring", b, i, F.lit(4 * k))))
    return F.array_distinct(F.get(F.transform(F.array(F.encode(line, "UTF-32")), cut), F.lit(0)))


def compared(pairs: DataFrame, text: DataFrame, k: int = SHINGLE) -> DataFrame:
    """pairs (a, b, ...) with `sa` and `sb`, the sets of both lines' shingles."""
    got = pairs.join(text.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(text.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    return got.select(*pairs.columns, hashed(F.col("la"), k).alias("sa"), hashed(F.col("lb"), k).alias("sb"))


def reaches(common: Column, total: Column, similarity: float) -> Column:
    """Whether sets of together `total` items reach the bound with `common` in both; common is computed once."""
    return F.get(F.transform(F.array(common), lambda c: c >= F.lit(similarity) * (total - c)), F.lit(0))


def alike(similarity: float) -> Column:
    """Whether the Jaccard similarity of sa and sb reaches the bound."""
    smaller, larger = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    reach = reaches(F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb"), similarity)
    return F.when(smaller < F.lit(similarity) * larger, F.lit(False)).otherwise(reach)


def parities(d: Column) -> Column:
    """256 bits of the hashes d: each tells whether an odd number of them falls to it.

    What two lists share cancels out in the exclusive or of their bits, so it has no more bits than they have differences.
    """
    none = F.struct(*(F.lit(0).cast("long").alias(f"s{j}") for j in range(4)))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 2).bitwiseAND(F.lit(63)))
    flip = lambda s, x, j: F.when(x.bitwiseAND(F.lit(3)) == j, s[f"s{j}"].bitwiseXOR(bit(x))).otherwise(s[f"s{j}"]).alias(f"s{j}")
    return F.aggregate(d, none, lambda s, x: F.struct(*(flip(s, x, j) for j in range(4))))


def across_hubs(held: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that are similar, among lines that were held against the same hub and are not in one component yet.

    held: (a, b, linked, root, n, nd, odd, d); b is the hub, n the number of a's shingles, d those nd in which a differs
    from b, as 32-bit hashes, odd their parities: a pair too many can come out, none is lost.

    Of lines x and y, |x ^ y| = |d(x) ^ d(y)|: their similarity follows from n and d alone, without the lines. Sizes
    rule out most pairs, as |d(x)| and |d(y)| differ by |x ^ y| at most, and so do their parities of the rest. Only lines that are not linked to their hub are
    asked, and they meet the hub's lines in blocks of about BLOCK differences that are dealt out by hub and block: no
    task gets a whole hub, and no row is made for a pair that is not similar. The work is the number of unlinked lines
    times the lines of their hub.
    """
    r = (1 - similarity) / (1 + similarity)
    blocks = held.groupBy("b").agg(F.ceil(F.sum("nd") / F.lit(BLOCK)).cast("int").alias("nb"), F.count_if(~F.col("linked")).alias("u"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("u > 0 and lo < hi")
    near = held.join(blocks.select("b", F.greatest("nb", F.lit(1)).alias("nb")), "b")
    block = near.groupBy("b", F.pmod(F.xxhash64("a"), F.col("nb")).cast("int").alias("block")).agg(F.collect_list(F.struct("a", "root", "n", "nd", "odd", "d")).alias("lines"))
    asked = near.filter("not linked").select("b", "a", "root", "n", "nd", "odd", "d", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"))
    total = lambda y: F.col("n") + y["n"]
    common = lambda y: (total(y) - F.col("nd") - y["nd"]) / 2 + F.size(F.array_intersect("d", y["d"])) + 1
    least = lambda y: sum((F.bit_count(F.col("odd")[f"s{j}"].bitwiseXOR(y["odd"][f"s{j}"])) for j in range(4)), F.lit(0))
    could = lambda y: (F.abs(F.col("nd") - y["nd"]) <= r * total(y) + 1e-6) & (least(y) <= r * total(y) + 1e-6)
    alike = lambda y: (y["root"] != F.col("root")) & could(y) & reaches(common(y), total(y), similarity)
    hits = asked.join(block, ["b", "block"]).select("a", F.transform(F.filter("lines", alike), lambda y: y["a"]).alias("hits"))
    return hits.select("a", F.explode("hits").alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def line_classes(src: DataFrame, sign: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(key, root) of lines that are linked to another line, and a test that passes the short of each; src: (key, short, line), sign: its signed().

    Each line is held against the hub of each of its bands, the line that shares the most bands with others. Where a
    band still has lines of several components, across_hubs finds what else can be similar.
    """
    live = sign.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band")
    in_live = bits(live, "band")
    # A line has no band twice: those of its two ways are of other hashes.
    entry = sign.select("key", "short", F.explode("bands").alias("band")).filter(in_live(F.col("band")))
    entry = written(entry, "line-bands")
    tied = entry.join(entry.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1"), "band")
    # Ids follow that order: the hub is the smallest, and links point to where components will find their roots.
    node = tied.groupBy("key", "short").agg(F.sum("c").alias("w")).orderBy(F.desc("w"))
    node = written(node.select("key", "short", F.monotonically_increasing_id().alias("id")), "line-nodes")
    tied = tied.join(node.drop("short"), "key").select("band", "id")
    hub = tied.groupBy("band").agg(F.min("id").alias("hub"))
    tied = written(tied.join(hub, "band").select("band", "id", "hub"), "line-hubs")

    may = bits(node, "short")
    text = src.filter(may(F.col("short"))).groupBy("key").agg(F.first("line").alias("line")).join(node.select("key", "id"), "key").select("id", "line")
    text = written(text, "line-texts")
    pairs = tied.filter("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    # What only one of them has also tells what both have.
    held = compared(pairs, text).select("a", "b", F.size("sa").alias("n"), (F.size("sa") + F.size("sb")).alias("total"), F.array_except("sa", "sb").alias("x"), F.array_except("sb", "sa").alias("y"))
    differs = F.transform(F.concat("x", "y"), lambda x: F.shiftright(x, 32).cast("int"))
    held = held.select("a", "b", reaches(F.col("n") - F.size("x"), F.col("total"), similarity).alias("linked"), "n", differs.alias("d"))
    held = written(held.select("a", "b", "linked", "n", F.size("d").alias("nd"), parities(F.col("d")).alias("odd"), "d"), "line-held", "lz4")
    links = held.filter("linked").select("a", "b")
    first = components(links, "line-components")

    member = tied.join(first.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "hub", F.coalesce("root", "id").alias("root"))
    mixed = member.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).filter("lo < hi and c > 2").select("band")
    left = member.join(mixed, "band").filter("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), "root").distinct()
    more = across_hubs(left.join(held, ["a", "b"]), similarity)
    more = written(compared(more, text).filter(alike(similarity)).select("a", "b"), "line-links")
    both = first if more.isEmpty() else components(links.unionByName(more), "line-components")
    return node.select("key", "id").join(both.withColumnRenamed("node", "id"), "id").select("key", "root"), may


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc, tag, nos): numbers, from 0, of the lines that go: all of a component but its first by (doc, no)."""
    src = lines(df, id_col, text_col)
    sign = written(signed(src), "line-signatures", "lz4")
    classes, may = line_classes(src.select("key", "short", "line"), sign, similarity)
    own = sign.filter((F.col("n") > 1) | may(F.col("short"))).select("key", "short", F.struct("doc", "no").alias("first"), "n")
    own = own.join(classes, "key", "left").filter("n > 1 or root is not null").distinct()
    root = F.coalesce(F.col("root").cast("string").cast("binary"), F.col("key"))
    own = own.select("key", "short", root.alias("root"), "first", "n")
    best = own.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).filter("n > 1").select("root", "kept")
    own = written(own.select("key", "short", "root").join(best, "root").select("key", "short", "kept"), "line-firsts")
    may = bits(own, "short")
    gone = src.filter(may(F.col("short"))).select("doc", "tag", "no", "key").join(own.select("key", "kept"), "key").filter(F.struct("doc", "no") != F.col("kept"))
    return gone.groupBy("doc", "tag").agg(F.collect_set("no").alias("nos"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The input rows with their columns, `text_col` without the lines that go.

    Lines are what \\n separates. Lines without a word stay, and so do rows with a null id, whose lines are no
    copies of others' either; a null text stays null. Rows that share an id are versions of one document: lines
    of the same number in them do not replace each other. A document that loses all lines with a word keeps its row. Very long lines are read whole.
    """
    out, _, _ = _split(df, id_col, text_col, similarity)
    return out.select(*df.columns)


def _split(df: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, str, str]:
    gone = written(removed_lines(df, id_col, text_col, similarity), "lines-gone")
    nos, doc, tag, n = (free_name(df, x) for x in ("__nos", "__doc", "__tag", "__n"))
    gone = gone.withColumnsRenamed({"doc": doc, "tag": tag, "nos": nos})
    may = bits(gone, doc)
    none = F.lit(None).cast("array<int>")
    hit = F.coalesce(may(df[id_col]), F.lit(False))
    changed = df.filter(hit)
    changed = changed.join(gone, (changed[id_col] == gone[doc]) & (F.hash(F.coalesce(changed[text_col], F.lit(""))) == gone[tag]), "left").select(*(changed[c] for c in df.columns), nos)
    whole = df.filter(~hit).select(*df.columns, none.alias(nos)).unionByName(changed)
    parts = F.split(F.col(text_col), "\n", -1)
    stays = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(nos, i)), "\n")
    whole = whole.withColumn(n, F.coalesce(F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)), F.lit(0)))
    return whole.withColumn(text_col, F.when(F.col(nos).isNull(), F.col(text_col)).otherwise(stays)), nos, n


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, n_lines, n_removed, kept_sha256) for each row; n_lines counts all lines of the input text."""
    out, nos, n = _split(df.select(id_col, text_col), id_col, text_col, similarity)
    removed = F.coalesce(F.size(nos), F.lit(0)).cast("long")
    return out.select(id_col, F.col(n).cast("long").alias("n_lines"), removed.alias("n_removed"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("kept_sha256"))
