"""A positional inverted index, and ranking by cover density on it.

Postings are (term, document, field, positions), in buckets by term and sorted in them, so that a query reads the row groups of its
terms and no document. Positions run on over the fields, as if their texts stood in a row. A row holds the postings of one term
and field in a block of documents: words are put in order where their texts lie, and only blocks are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quaystat.operators.search import TOKEN, parse_query, query_terms

BUCKETS = 64
#: Bytes of text in a block of documents, which ends with a whole document.
BLOCK = 1 << 23


@dataclass(frozen=True)
class Field:
    """A column and the weight of its words; without a weight its words are found as parts of the text, but not ranked."""

    column: str
    weight: float | None


#: The weights of the four classes of words are 1, 0.4, 0.2 and 0.1.
CATALOGUE_FIELDS = (Field("object_code", 1.0), Field("title", 1.0), Field("synonyms", 0.4), Field("subtitle", 0.4), Field("description", 0.2), Field("searchable", 0.1), Field("dataset_code", None))


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    fields: tuple[Field, ...]
    buckets: int

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, document_id, field, positions) of the terms: their buckets are known here, so others are not listed."""
        own = sorted({r[0] for r in self.spark.range(1).select(F.explode(F.array(*(_bucket(F.lit(t), self.buckets) for t in terms)))).collect()}) if terms else [-1]
        p = self.spark.read.parquet(f"{self.path}/postings")
        return p.filter(F.col("bucket").isin(*own) & F.col("term").isin(*terms)).select("term", "field", F.explode("places").alias("p")).select("term", "p.document_id", "field", "p.positions")

    def vocabulary(self) -> DataFrame:
        """(term, field, documents)."""
        return self.spark.read.parquet(f"{self.path}/vocabulary")

    def having(self, tokens: list[str], fields: tuple[str, ...]) -> DataFrame:
        """(document_id, token): documents in one of whose fields the token is a part of a word.

        Tokens hold letters and digits only, so they are parts of the text exactly if they are parts of a word: the vocabulary is looked
        through and not the texts, and its words choose the buckets of postings that are read.
        """
        number = [k for k, f in enumerate(self.fields) if f.column in fields]
        token = F.explode(F.array(*(F.lit(t) for t in tokens)).cast("array<string>"))
        words = self.vocabulary().filter(F.col("field").isin(*number)).select("term", "field", token.alias("token")).filter(F.contains("term", F.col("token")))
        words = words.withColumn("bucket", _bucket(F.col("term"), self.buckets))
        p = self.spark.read.parquet(f"{self.path}/postings").select("term", "field", "bucket", F.col("places.document_id").alias("documents"))
        return p.join(words, ["bucket", "term", "field"]).select(F.explode("documents").alias("document_id"), "token").distinct()


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _words(column: str) -> Column:
    """The words of a field in their order, between blanks."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), TOKEN, " ")


def _inverter(fields: int, block: int) -> Callable:
    """Turns Arrow batches (document_id, text), sorted by id, into rows (term, field, documents, places) for each block of documents.

    Words of the text stand between blanks, fields between line feeds that stand as words.
    """

    def invert(docs):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids = docs.column(0).combine_chunks()
        words = pc.split_pattern(docs.column(1).combine_chunks(), " ")
        ends = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        code, terms = coded.indices.to_numpy(), coded.dictionary
        bar = code == terms.index("\n").as_py()
        real = ~bar & (code != terms.index("").as_py())
        row = np.repeat(np.arange(len(ids)), np.diff(ends))
        field = np.cumsum(bar) - row * (fields - 1)
        before = np.concatenate(([0], np.cumsum(real)))
        position = (before[:-1] - before[ends[:-1]][row])[real].astype(np.int32)
        first = begins(ids)
        doc = (np.cumsum(first) - 1)[row[real]]
        key = code[real].astype(np.int64) * fields + field[real]
        if first.all():  # words come by document and position
            order = np.argsort(key, kind="stable")
        else:  # and of documents with one id each position once
            order = np.lexsort((position, doc, key))
            k, d, p = key[order], doc[order], position[order]
            order = order[np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])))[: len(order)]]
        key, doc, position = key[order], doc[order], position[order]
        if not len(key):
            return None
        posting = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
        own = key[posting]
        entry = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bounds = lambda starts, n: pa.array(np.append(starts, n).astype(np.int32))
        places = [ids.take(pa.array(np.flatnonzero(first)[doc[posting]])), pa.ListArray.from_arrays(bounds(posting, len(key)), pa.array(position))]
        listed = pa.ListArray.from_arrays(bounds(entry, len(posting)), pa.StructArray.from_arrays(places, ["document_id", "positions"]))
        term, number = np.divmod(own[entry], fields)
        count = np.diff(np.append(entry, len(posting))).astype(np.int32)
        return pa.RecordBatch.from_arrays([terms.take(pa.array(term)), pa.array(number.astype(np.int32)), pa.array(count), listed], ["term", "field", "documents", "places"])

    def begins(ids):  # noqa: ANN001, ANN202
        """Whether a row's id is not that of the row before; null is an id like others."""
        import numpy as np
        import pyarrow.compute as pc

        a, b = ids[1:], ids[:-1]
        none = pc.not_equal(pc.is_null(a), pc.is_null(b))
        return np.concatenate(([True], pc.or_(pc.fill_null(pc.not_equal(a, b), False), none).to_numpy(zero_copy_only=False)))

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            starts = np.flatnonzero(begins(t.column(0).combine_chunks()))
            size = pc.binary_length(t.column(1).combine_chunks()).to_numpy().astype(np.int64)
            number = (np.cumsum(size) - size)[starts] // block
            cuts = [0, *starts[1:][number[1:] != number[:-1]].tolist()]
            for i, j in zip(cuts, cuts[1:]):
                if (out := invert(t.slice(i, j - i))) is not None:
                    yield out
            held = t.slice(cuts[-1])  # the block, and its last document, may go on
        if held is not None and (out := invert(held)) is not None:
            yield out

    return run


def build(docs: DataFrame, path: str, id_col: str = "document_id", fields: tuple[Field, ...] = CATALOGUE_FIELDS, buckets: int = BUCKETS, block: int = BLOCK) -> Index:
    """Writes the index of the documents' fields.

    A null field has no words. Documents that share an id are one: their positions are those of either. Texts are dealt out by id, blocks
    of postings by bucket; a bucket of very many blocks is written by several tasks.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("document_id"), *(F.col(f.column).alias(f"f{k}") for k, f in enumerate(fields)))
    text = text.repartition("document_id").sortWithinPartitions("document_id")
    text = text.select("document_id", F.concat_ws(" \n ", *(_words(f"f{k}") for k in range(len(fields)))).alias("text"))
    place = StructType([StructField("document_id", text.schema["document_id"].dataType), StructField("positions", ArrayType(IntegerType()))])
    row = StructType([StructField("term", StringType()), StructField("field", IntegerType()), StructField("documents", IntegerType()), StructField("places", ArrayType(place))])
    postings = text.mapInArrow(_inverter(len(fields), block), row).withColumn("bucket", _bucket(F.col("term"), buckets))
    postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "field").write.partitionBy("bucket").parquet(f"{path}/postings")
    index = Index(spark, path, fields, buckets)
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy("term", "field").agg(F.sum("documents").alias("documents")).write.parquet(f"{path}/vocabulary")
    return index


def cover_density(index: Index, query: str) -> DataFrame:
    """(document_id, cover) of the documents that match the query: the sum over its shortest extents that hold every group and
    phrase. An extent of n wanted words counts n over the sum of their inverse weights, divided by one more than the other words in it.

    Groups are words or alternatives, phrases are words in a row, and excluded words rule a document out. A query with neither group
    nor phrase matches nothing.
    """
    groups, phrases, excluded = parse_query(query)
    wanted = sorted({t for g in groups for t in g} | {t for p in phrases for t in p.split()})
    inverse = F.element_at(F.create_map(*(F.lit(x) for k, f in enumerate(index.fields) if f.weight for x in (k, 1 / f.weight))), F.col("field"))
    hit = index.postings(wanted)
    if excluded:
        hit = hit.join(index.postings(sorted(set(excluded))).select("document_id").distinct(), "document_id", "left_anti")
    hit = hit.select("document_id", "term", inverse.alias("inverse"), F.explode("positions").alias("position")).filter("inverse is not null")
    order = Window.partitionBy("document_id").orderBy("position")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumns({"n": F.row_number().over(order), "sum": F.sum("inverse").over(upto)})
    hit = hit.withColumn("here", F.struct("n", "position", (F.col("sum") - F.col("inverse")).alias("before")))
    starts = []
    for k, p in enumerate(phrases):
        w = p.split()
        back = [(F.lag("term", j).over(order) == w[-1 - j]) & (F.lag("position", j).over(order) == F.col("position") - j) for j in range(1, len(w))]
        run = reduce(lambda a, b: a & b, back, F.col("term") == w[-1])
        hit = hit.withColumn(f"run{k}", F.when(run, F.lag("here", len(w) - 1).over(order)))
        starts.append(F.col(f"run{k}"))
    starts += [F.when(F.col("term").isin(*g), F.col("here")) for g in groups]
    if not starts:
        return hit.select("document_id", F.lit(0.0).alias("cover")).limit(0)
    hit = hit.withColumns({f"last{k}": F.last(s, ignorenulls=True).over(upto) for k, s in enumerate(starts)})
    last = [F.col(f"last{k}") for k in range(len(starts))]
    every = reduce(lambda a, b: a & b, [c.isNotNull() for c in last])
    hit = hit.withColumn("begin", F.when(every, F.least(*last) if len(last) > 1 else last[0]))
    shortest = F.col("begin").isNotNull() & F.coalesce(F.col("begin.n") > F.lag("begin.n").over(order), F.lit(True))
    words = F.col("n") - F.col("begin.n") + 1
    others = F.col("position") - F.col("begin.position") + 1 - words
    value = words / (F.col("sum") - F.col("begin.before")) / (1 + others)
    return hit.withColumn("value", F.when(shortest, value)).filter("value is not null").groupBy("document_id").agg(F.sum("value").alias("cover"))


def lexical(index: Index, query: str, synonyms: dict[str, list[str]] | None = None, any_term: float = 0.05, own_term: float = 0.20, own_share: float = 0.45) -> DataFrame:
    """(document_id, cover, any_hit, lexical_score, terms) of the documents that match in any way.

    The targets of synonyms whose phrase is in the query join it. To the cover come any_term if a term of either is a part of the text, own_term
    if one of the query is a part of codes or title, and own_share times the share of the query's terms in title and synonyms.
    """
    own, expanded = query_terms(query, synonyms)
    more = [x for phrase, targets in (synonyms or {}).items() if phrase in query.lower() for x in targets]
    cover = cover_density(index, " ".join([query, *more]))
    all_columns = tuple(f.column for f in index.fields)
    found = index.having(expanded, all_columns).groupBy("document_id").agg(F.collect_set("token").alias("found"))
    part = index.having(expanded, ("searchable", "title", "object_code", "dataset_code", "synonyms")).select("document_id").distinct().withColumn("any_hit", F.lit(True))
    code = index.having(own, ("object_code", "dataset_code", "title")).select("document_id").distinct().withColumn("own_hit", F.lit(True))
    name = index.having(own, ("title", "synonyms")).groupBy("document_id").agg(F.count("*").alias("names"))
    out = cover.join(found, "document_id", "full").join(part, "document_id", "left").join(code, "document_id", "left").join(name, "document_id", "left")
    hit = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    score = F.coalesce("cover", F.lit(0.0)) + hit("any_hit", any_term) + hit("own_hit", own_term) + F.coalesce("names", F.lit(0)) / float(max(1, len(own))) * own_share
    terms = F.filter(F.array(*(F.lit(t) for t in expanded)).cast("array<string>"), lambda t: F.array_contains(F.coalesce("found", F.array().cast("array<string>")), t))
    return out.select("document_id", F.coalesce("cover", F.lit(0.0)).alias("cover"), F.coalesce("any_hit", F.lit(False)).alias("any_hit"), score.alias("lexical_score"), terms.alias("terms"))
