"""A data source of numbered JSON pages with a list of their bounds: `spark.read.format("paged").load(folder)`.

The folder holds `page=N/` with JSON lines and `_index/`, a Parquet table of the pages with the rows and the least and greatest value of
each column. A read is one task for each page that can hold wanted rows, or for up to 64 of them where they are many; what Spark pushes down and what the options ask for is
tested on the bounds first, then on the rows. Options:

* `select`: the columns, comma-separated; others are not parsed
* `filter`: conditions `field eq|ne|gt|ge|lt|le literal` and `substringof('part',field)`, joined by and, or (and binds first)
* `skip`, `top`: rows by their number, before any filter
* `follow`: no list is read, but pages one after the other in one task, until one is short or missing (`page_rows` is a full one's rows)

As a stream, the number of the next row is the offset: a query goes on where its last batch ended, and pages that have come since are read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.json as pj
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # readers are planned in processes of their own

ROW = "row_index"
_PUSHED = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", In: "in", StringContains: "contains", StringStartsWith: "starts", IsNotNull: "valid"}
_TERM = re.compile(r"\s*(?:substringof\('((?:[^']|'')*)'\s*,\s*(\w+)\)|(\w+)\s+(eq|ne|gt|ge|lt|le)\s+('(?:[^']|'')*'|-?[\d.]+|true|false))\s*(and\b|or\b|$)")

Term = tuple[str, str, object]  # operation, column, value


def parse_filter(text: str) -> list[list[Term]]:
    """Alternatives of conditions that must all hold; [[]] is no condition."""
    out: list[list[Term]] = [[]]
    at = 0
    while at < len(text.rstrip()):
        m = _TERM.match(text, at)
        if not m:
            raise ValueError(f"not a filter, at character {at}: {text}")
        part, field, name, how, literal, then = m.groups()
        if field:
            out[-1].append(("contains", field, part.replace("''", "'")))
        else:
            value = literal[1:-1].replace("''", "'") if literal[0] == "'" else literal == "true" if literal in ("true", "false") else float(literal) if "." in literal else int(literal)
            out[-1].append((how, name, value))
        if then == "or":
            out.append([])
        elif then and m.end() >= len(text.rstrip()):
            raise ValueError(f"a filter ends with {then}: {text}")
        at = m.end()
    return out


def matches(term: Term) -> pc.Expression:
    """The condition on rows; rows without a value don't meet it."""
    how, name, value = term
    c = pc.field(name)
    if how in ("eq", "ne", "gt", "ge", "lt", "le"):
        return {"eq": c.__eq__, "ne": c.__ne__, "gt": c.__gt__, "ge": c.__ge__, "lt": c.__lt__, "le": c.__le__}[how](value)
    return {"in": lambda: c.isin(list(value)), "contains": lambda: pc.match_substring(c, value), "starts": lambda: pc.starts_with(c, value), "valid": c.is_valid}[how]()


def possible(term: Term, columns: set[str]) -> pc.Expression | None:
    """The condition on the bounds of a page under which it can hold such rows; None if they don't tell."""
    how, name, value = term
    if f"min_{name}" not in columns:
        return None
    low, high = pc.field(f"min_{name}"), pc.field(f"max_{name}")
    if how == "in":
        values = [v for v in value if v is not None]
        return (low <= max(values)) & (high >= min(values)) if values else None
    tests = {"eq": lambda: (low <= value) & (high >= value), "gt": lambda: high > value, "ge": lambda: high >= value, "lt": lambda: low < value, "le": lambda: low <= value, "valid": low.is_valid, "starts": lambda: (high >= value) & (low < value + "\U0010ffff")}
    return tests[how]() if how in tests else None


def all_of(parts: list[pc.Expression]) -> pc.Expression:
    out = pc.scalar(True)
    for p in parts:
        out = out & p
    return out


def any_of(parts: list[pc.Expression]) -> pc.Expression:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


@dataclass
class Page(InputPartition):
    number: int
    low: int = 0
    high: int | None = None


#: A page is small, and a task of a Python source has a start of its own: more pages than tasks are read several by one.
TASKS, PAGES_A_TASK = 128, 64


@dataclass
class Pages(InputPartition):
    pages: list[Page]


def packed(pages: list[Page]) -> list[Pages]:
    n = max(1, min(PAGES_A_TASK, -(-len(pages) // TASKS)))
    return [Pages(pages[k : k + n]) for k in range(0, len(pages), n)]


class _Folder:
    """What both readers share."""

    def __init__(self, schema: StructType, options: dict):
        self.path = re.sub(r"^file:/+", "/", options["path"]).rstrip("/")
        self.schema = to_arrow_schema(schema)
        self.alternatives = parse_filter(options.get("filter", ""))
        self.skip = int(options.get("skip", 0))
        self.end = self.skip + int(options["top"]) if "top" in options else None
        self.follow = options.get("follow", "false") == "true"
        self.page_rows = int(options.get("page_rows", 500))
        self.pushed: list[Term] = []

    def fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def index(self) -> ds.Dataset:
        fs, root = self.fs()
        return ds.dataset(f"{root}/_index", format="parquet", filesystem=fs)

    def pages(self, low: int, high: int | None) -> list[Page]:
        index = self.index()
        names = set(index.schema.names)
        bounds = lambda terms: [p for p in (possible(t, names) for t in terms) if p is not None]
        span = [pc.field(f"max_{ROW}") >= low] + ([pc.field(f"min_{ROW}") < high] if high is not None else [])
        wanted = all_of(span + bounds(self.pushed)) & any_of([all_of(bounds(a)) for a in self.alternatives])
        return [Page(n, low, high) for n in sorted(index.to_table(["page"], filter=wanted)["page"].to_pylist())]

    def table(self, page: Page) -> pa.Table | None:
        """The wanted rows of a page; None if there is no such page."""
        fs, root = self.fs()
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/page={page.number}", allow_not_found=True)) if f.path.endswith(".json")]
        if not files:
            return None
        kinds = {f.name: f.type for f in self.schema} | {ROW: pa.int64()}
        for _, name, value in [*self.pushed, *(t for a in self.alternatives for t in a)]:
            kinds.setdefault(name, pa.scalar(value).type)  # a filter may name columns that are not selected
        options = pj.ParseOptions(explicit_schema=pa.schema(list(kinds.items())), unexpected_field_behavior="ignore")
        parts = []
        for name in sorted(files):
            with fs.open_input_stream(name) as f:
                parts.append(pj.read_json(f, parse_options=options))
        t = pa.concat_tables(parts)
        self.rows = t.num_rows
        span = [pc.field(ROW) >= page.low] + ([pc.field(ROW) < page.high] if page.high is not None else [])
        t = t.filter(all_of(span + [matches(x) for x in self.pushed]) & any_of([all_of([matches(x) for x in a]) for a in self.alternatives]))
        return t.select(self.schema.names).cast(self.schema).sort_by(ROW) if ROW in self.schema.names else t.sort_by(ROW).select(self.schema.names).cast(self.schema)

    def read(self, page: Page | Pages | None) -> Iterator[pa.RecordBatch]:
        """Also called without a page, where none is wanted."""
        if page is None:
            return
        if isinstance(page, Pages):
            for p in page.pages:
                yield from self.read(p)
            return
        if not self.follow:
            if (t := self.table(page)) is not None:
                yield from t.to_batches()
            return
        while (t := self.table(page)) is not None:
            yield from t.to_batches()
            if self.rows < self.page_rows:
                return
            page = Page(page.number + 1, page.low, page.high)


class PagedReader(_Folder, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _PUSHED and len(f.attribute) == 1:
                self.pushed.append((_PUSHED[type(f)], f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Page] | list[Pages]:
        return [Page(self.skip // self.page_rows, self.skip, self.end)] if self.follow else packed(self.pages(self.skip, self.end))


class PagedStream(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"row": self.skip}

    def latestOffset(self) -> dict:
        top = self.index().to_table([f"max_{ROW}"])[f"max_{ROW}"]
        last = max((v for v in top.to_pylist() if v is not None), default=-1) + 1
        return {"row": max(self.skip, last if self.end is None else min(last, self.end))}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return packed(self.pages(start["row"], end["row"])) if start["row"] < end["row"] else []

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def _folder(self) -> _Folder:
        return _Folder(StructType(), dict(self.options))

    def schema(self) -> StructType:
        """As the list of pages has it: the type of a column is that of its bounds."""
        index = self._folder().index().schema
        kinds = {n.removeprefix("min_"): index.field(n).type for n in index.names if n.startswith("min_")}
        names = [n.strip() for n in self.options["select"].split(",")] if "select" in self.options else list(kinds)
        if missing := [n for n in names if n not in kinds]:
            raise ValueError(f"no column {', '.join(missing)}")
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(pa.schema([(n, kinds[n]) for n in names]))

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, with push-down of filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def write_pages(df: DataFrame, path: str, page_rows: int = 500) -> None:
    """Writes rows, which have their number in row_index, as pages, and the list of pages. Rows of a page come from one task at most."""
    df = df.withColumn("page", F.floor(F.col(ROW) / page_rows))
    df.repartition("page").write.mode("append").partitionBy("page").json(path)
    own = [c for c in df.columns if c != "page"]
    bounds = [f(c).alias(f"{n}_{c}") for c in own for f, n in ((F.min, "min"), (F.max, "max"))]
    df.groupBy("page").agg(F.count("*").alias("rows"), *bounds).write.mode("append").parquet(f"{path}/_index")


def count(spark: SparkSession, path: str) -> DataFrame:
    """The number of rows by the list of pages; no page is opened."""
    return spark.read.parquet(f"{path}/_index").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
