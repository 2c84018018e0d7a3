"""A stored inverted index for BM25: built once, changed by journal entries, searched by reading its terms' buckets.

Postings lie in buckets by a hash of the term, sorted by term inside each file,
so a search opens the buckets of its terms and skips row groups by statistics.
A document's own row (its lengths) lies in a bucket apart, written in the same
pass.  On their way there postings are packed, thousands to a row, so that what
is shuffled is smaller than what is stored.  Document frequencies are kept
beside them.  A document's key puts it in a block; the largest frequency and the
least length that a block has of a term bound what its documents can score with
that term, so a search for the best few skips whole blocks.

An index of forms (``forms``) takes key words, stems each, and files a document
under every form of its words, with their places, so that nearness and phrases
can be told without the text.  An upsert or a removal
writes a journal entry: the new postings, the keys that are gone, and what the
statistics change by.  Compaction writes a new base from what is alive.

Every change is one commit file with the next number; creating a file that
exists fails, so of two writers that saw the same state one must start again.
Readers see the base and the journal as of the last commit.
"""

from __future__ import annotations

import contextlib
import json
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.functions.stem import stem_forms
from tarn.operators.search import bm25_term, idf, place_of
from tarn.operators.skew import join_hot
from tarn.session import discard, exists, hadoop_path, materialize, scratch_path, small_batches

#: Postings that a bucket holds about, and files that a bucket is spread over for each so many of them.
BUCKET_ROWS, FILE_ROWS, MOST_BUCKETS = 200_000, 2_000_000, 4096
#: Postings that a document has about, until they are counted; documents that a block of keys has about.
DOC_POSTINGS, BLOCK_DOCS = 150, 64
#: Postings that a Python worker hands on at once.
SLICE_POSTINGS = 50_000
#: Bytes of postings that are packed at once, a row for each part that they are dealt to, and postings that a part holds about.
PACK_BYTES, PART_POSTINGS = 24 << 20, 750_000
#: Journal entries before an index is compacted.
MOST_ENTRIES = 64
#: The bucket of documents' own rows.
DOCS = -1
#: Queries that are scored at once; more go block by block.
BLOCK_QUERIES = 10_000
#: Pairs of a document and a query that a task adds scores up for about, and postings that it groups by block.
TASK_PAIRS, TASK_POSTINGS = 1_000_000, 500_000


class StaleIndex(RuntimeError):
    """Another writer committed first."""


@dataclass
class State:
    """What the commit files say: the last number, the base's folder and buckets, and the journal's folders in order."""

    number: int = 0
    base: str = ""
    buckets: int = 1
    schema: dict = field(default_factory=dict)
    blocks: int = 1
    forms: bool = False
    journal: list[str] = field(default_factory=list)

    @property
    def parts(self) -> list[str]:
        return [self.base, *self.journal]


class LexicalIndex:
    """An index over rows with one key, a token array, and columns that searches may filter by (``fields``).

    After ``most_entries`` journal entries a change compacts the index.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, most_entries: int = MOST_ENTRIES):
        self.spark, self.root, self.most_entries = spark, (root or scratch_path(spark, "lexical-index")).rstrip("/"), most_entries

    # ---- commits

    def state(self) -> State:
        found = State()
        files, at = hadoop_path(self.spark, f"{self.root}/commits")
        if not files.exists(at):
            return found
        names = sorted(f.getPath().getName() for f in files.listStatus(at))
        for name in (n for n in names if n.isdigit()):
            said = self._said(name)
            found.number = int(name)
            if said["kind"] == "base":
                found.base, found.buckets, found.schema, found.journal = said["path"], said["buckets"], said["schema"], []
                found.blocks, found.forms = said["blocks"], said["forms"]
            else:
                found.journal.append(said["path"])
        return found

    def _said(self, name: str) -> dict:
        files, one = hadoop_path(self.spark, f"{self.root}/commits/{name}")
        stream = files.open(one)
        said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return said

    def _commit(self, seen: State, said: dict) -> None:
        """Make ``said`` the commit that follows what was seen, or drop it if something else did."""
        files, at = hadoop_path(self.spark, f"{self.root}/commits/{seen.number + 1:012d}")
        try:
            stream = files.create(at, False)
        except Exception as e:
            discard(self.spark, said["path"])
            raise StaleIndex(f"commit {seen.number + 1} of {self.root} is taken") from e
        stream.write(bytearray(json.dumps(said).encode()))
        stream.close()

    # ---- writing

    def _write(self, made: Made, docs: int, buckets: int, blocks: int, path: str) -> dict:
        """Write postings and documents' rows in one pass, then what is told by counting terms."""
        small_batches(self.spark)
        bucket = F.when(F.col("term").isNull(), DOCS).otherwise(_bucket(F.col("term"), buckets))
        spread = max(1, math.ceil(docs * DOC_POSTINGS / FILE_ROWS / buckets))
        parts = min((buckets + 1) * spread, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs * DOC_POSTINGS / PART_POSTINGS)))
        rows = _dealt(made, buckets, spread, parts).withColumns({"bucket": bucket, "block": _block(F.col("key"), blocks)})
        rows.sortWithinPartitions("bucket", "term", "block", "key").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        written = self.spark.read.schema(rows.schema).parquet(f"{path}/postings")
        told = written.where(F.col("bucket") != DOCS).groupBy("bucket", "term").agg(F.count("*").alias("df"))
        told.sortWithinPartitions("bucket", "term").write.option("compression", "zstd").parquet(f"{path}/terms")
        return json.loads(rows.schema.json())

    def _lengths(self, docs: DataFrame) -> DataFrame:
        return docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))

    def _new(self, kind: str) -> str:
        return f"{self.root}/{kind}-{scratch_path(self.spark, 'x').rsplit('-', 1)[-1]}"

    def _base(self, made: Made, docs: int, forms: bool, seen: State) -> None:
        path = self._new("base")
        buckets = 2 ** max(0, min(int(math.log2(MOST_BUCKETS)), math.ceil(math.log2(max(1, docs * DOC_POSTINGS / BUCKET_ROWS)))))
        blocks = max(1, math.ceil(docs / BLOCK_DOCS))
        schema = self._write(made, docs, buckets, blocks, path)
        self.spark.read.schema(StructType.fromJson(schema)).parquet(f"{path}/postings").where(F.col("bucket") == DOCS).transform(self._lengths).write.parquet(f"{path}/lengths")
        self._commit(seen, {"kind": "base", "path": path, "buckets": buckets, "blocks": blocks, "forms": forms, "schema": schema})

    def build(self, docs: DataFrame, key: str, tokens: str, fields: list[str] | None = None, forms: bool = False) -> LexicalIndex:
        """Write the base of all ``docs``. ``forms``: ``tokens`` are key words, and every form of a word is filed, with its places."""
        rows = _rows(docs, key, tokens, fields or [])
        self._base(_made(rows, forms), docs.count(), forms, self.state())
        return self

    def upsert(self, docs: DataFrame, key: str, tokens: str, fields: list[str] | None = None) -> None:
        """Index ``docs`` anew: what was indexed under their keys gives way."""
        rows = _rows(docs, key, tokens, fields or [])
        self._journal(rows.select("key"), rows)

    def remove(self, keys: DataFrame, key: str) -> None:
        """Drop the documents of these keys; unknown ones are ignored."""
        self._journal(keys.select(F.col(key).alias("key")), None)

    def _journal(self, gone: DataFrame, rows: DataFrame | None) -> None:
        seen = self.state()
        path = self._new("journal")
        gone.distinct().write.parquet(f"{path}/gone")
        gone = self.spark.read.parquet(f"{path}/gone")
        n = gone.count()
        lost = F.broadcast(gone) if n <= BROADCAST_KEYS else gone
        terms = [self.live(seen).join(lost, "key", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))]
        lengths = [self.docs(seen).join(lost, "key", "left_semi").transform(self._lengths).select((-F.col("n")).alias("n"), (-F.col("total")).alias("total"))]
        if rows is not None:
            self._write(_made(rows, seen.forms), n, seen.buckets, seen.blocks, f"{path}/new")
            terms.append(self.spark.read.parquet(f"{path}/new/terms").select("term", "df"))
            new = self.spark.read.schema(StructType.fromJson(seen.schema)).parquet(f"{path}/new/postings")
            lengths.append(new.where(F.col("bucket") == DOCS).transform(self._lengths))
        reduce(DataFrame.unionByName, terms).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("bucket", _bucket(F.col("term"), seen.buckets)).write.parquet(f"{path}/terms")
        reduce(DataFrame.unionByName, lengths).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.parquet(f"{path}/lengths")
        self._commit(seen, {"kind": "journal", "path": path})
        if len(seen.journal) + 1 >= self.most_entries:
            with contextlib.suppress(StaleIndex):  # the change stands; another writer is at work, and will compact in turn
                self.compact()

    def compact(self) -> None:
        """Write what is alive as a new base; StaleIndex if the index changed meanwhile. What no reader of the new state needs is left to :meth:`vacuum`."""
        seen = self.state()
        n = self.lengths(seen).first().n or 0
        alive = self._alive(seen).drop("bucket", "block")
        self._base(Made(alive, iter, alive.schema), n, seen.forms, seen)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete folders that only states before the last ``keep`` bases refer to, and their commits; the paths deleted. Readers of an older state must be done."""
        files, at = hadoop_path(self.spark, f"{self.root}/commits")
        said = {int(n): self._said(n) for n in sorted(f.getPath().getName() for f in files.listStatus(at)) if n.isdigit()}
        bases = [n for n, s in said.items() if s["kind"] == "base"]
        old = [n for n in said if bases and n < bases[-min(keep, len(bases))]]
        for n in old:
            discard(self.spark, said[n]["path"])
            discard(self.spark, f"{self.root}/commits/{n:012d}")
        return [said[n]["path"] for n in old]

    # ---- reading

    def live(self, seen: State | None = None, terms: list[str] | None = None) -> DataFrame:
        """(key, dl, words, term, tf, block, fields, places if forms are filed): postings that no later entry replaced; of a few terms only, if they are named."""
        seen = seen or self.state()
        if terms is None:
            return self._alive(seen, F.col("bucket") != DOCS).drop("bucket")
        buckets = sorted({bucket_of(t, seen.buckets) for t in terms})
        return self._alive(seen, F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")

    def _shown(self, seen: State, within: Column | None) -> DataFrame:
        rows = self.live(seen)
        return rows if within is None else rows.where(within)

    def docs(self, seen: State | None = None) -> DataFrame:
        """(key, dl, words) of all documents, those without tokens too."""
        return self._alive(seen or self.state(), F.col("bucket") == DOCS).select("key", "dl", "words")

    def _alive(self, seen: State, wanted: Column | None = None) -> DataFrame:
        folders = [f"{seen.base}/postings", *(f"{p}/new/postings" for p in seen.journal)]
        held = [(i, f) for i, f in enumerate(folders) if exists(self.spark, f)]
        reader = self.spark.read.schema(StructType.fromJson(seen.schema))
        rows = [reader.parquet(f).where(F.lit(True) if wanted is None else wanted).withColumn("entry", F.lit(i)) for i, f in held]
        found = reduce(DataFrame.unionByName, rows)
        if seen.journal:
            gone = [self.spark.read.parquet(f"{p}/gone").withColumn("gone", F.lit(i)) for i, p in enumerate(seen.journal, 1)]
            last = reduce(DataFrame.union, gone).groupBy("key").agg(F.max("gone").alias("gone"))
            found = found.join(F.broadcast(last) if last.count() <= BROADCAST_KEYS else last, "key", "left").where("gone IS NULL OR gone <= entry").drop("gone")
        return found.drop("entry")

    def lengths(self, seen: State | None = None) -> DataFrame:
        """One row (n, total): documents and their tokens."""
        seen = seen or self.state()
        return self.spark.read.parquet(*[f"{p}/lengths" for p in seen.parts]).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def frequencies(self, seen: State | None = None) -> DataFrame:
        """(term, df) of all terms that a document has."""
        seen = seen or self.state()
        rows = [self.spark.read.parquet(f"{p}/terms").select("term", "df") for p in seen.parts]
        return rows[0] if len(rows) == 1 else reduce(DataFrame.union, rows).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def search(self, terms: list[str], top_k: int | None = None, within: Column | None = None) -> DataFrame:
        """(key, score) of the documents that have one of a few terms. ``within`` narrows what is scored, by fields; all documents count in the statistics."""
        seen, terms = self.state(), list(dict.fromkeys(terms))
        asked = self.frequencies(seen).where(F.col("term").isin(terms))
        told = asked.select("term", F.col("df").alias("a"), F.lit(0).cast("long").alias("b")).union(self.lengths(seen).select(F.lit(None).cast("string"), "n", "total")).collect()  # a row for each term
        n, total = next((r.a, r.b) for r in told if r.term is None)
        weights = {r.term: math.log(1 + (n - r.a + 0.5) / (r.a + 0.5)) for r in told if r.term is not None}
        rows = self.live(seen, terms)
        if within is not None:
            rows = rows.where(within)
        rows = rows.where(F.col("term").isin(list(weights)))
        weight = reduce(lambda other, t: F.when(F.col("term") == t, F.lit(weights[t])).otherwise(other), weights, F.lit(0.0))
        part = bm25_term(F.col("tf"), F.col("dl"), F.lit((total or 0) / max(1, n or 0)), weight)
        scored = rows.groupBy("key").agg(F.sum(part).alias("score"))
        return scored.orderBy(place_of(F.col("score")).desc(), "key").limit(top_k) if top_k else scored

    def search_many(self, queries: DataFrame, top_k: int, within: Column | None = None) -> DataFrame:
        """(query_id, key, score, rank) of many queries (query_id, term), distinct.

        Only postings of asked terms are dealt, by their document, and meet
        there the list of queries that ask for the term: a document's scores are
        added up where they meet, so pairs of queries and documents are not
        shuffled but for the best of each task.  Queries go in blocks, so a list
        has ``BLOCK_QUERIES`` entries at most.  Where a block asks for too many
        terms to broadcast, postings meet the lists by a shuffle, and terms with
        many postings are dealt over salts.  ``within`` narrows what is scored, by fields.
        """
        seen = self.state()
        sizes = self.lengths(seen).first()
        n, average = sizes.n or 0, (sizes.total or 0) / max(1, sizes.n or 0)
        queries = materialize(queries.select("query_id", "term"), "queries")  # read several times
        asking = queries.select("query_id").distinct().count()
        blocks = max(1, math.ceil(asking / BLOCK_QUERIES))
        rows, df = self._shown(seen, within).select("key", "term", "tf", "dl"), self.frequencies(seen)
        found = []
        for block in range(blocks):
            mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
            side = mine.groupBy("term").agg(F.collect_list("query_id").alias("asks")).join(df, "term").withColumn("idf", idf(F.lit(n), F.col("df")))
            if few(mine):
                met = asked_only(rows, mine).repartition(self._pair_parts(n, math.ceil(asking / blocks)), "key").join(F.broadcast(side.drop("df")), "term")
            else:
                met = join_hot(rows, side, ["term"], "df", df.agg(F.sum("df")).first()[0] or 0, ["key"])
            part = bm25_term(F.col("tf"), F.col("dl"), F.lit(average), F.col("idf")).alias("part")
            found.append(met.select("key", part, F.explode("asks").alias("query_id")).groupBy("query_id", "key").agg(F.sum("part").alias("score")))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(place_of(F.col("score")).desc(), "key"))
        return reduce(DataFrame.union, found).withColumn("rank", rank).where(F.col("rank") <= top_k)

    def _pair_parts(self, docs: int, queries: int) -> int:
        """Partitions by document in which a task holds about ``TASK_PAIRS`` pairs of a document and a query."""
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return min(max(least, math.ceil(docs * queries / TASK_PAIRS)), least * 4)

    def search_best(self, queries: DataFrame, top_k: int, within: Column | None = None) -> DataFrame:
        """The same rows as :meth:`search_many`, without scoring blocks of keys that can't hold any of them.

        A query's blocks are bounded by what their best document could score.
        The ``top_k`` blocks with the highest bounds are scored; of the others,
        those whose bound reaches the score then found at ``top_k`` (all of them
        if fewer were found).  A block meets only the
        queries that need it.  ``within`` narrows what is scored, by fields.
        """
        seen = self.state()
        asked = self._weighted(queries, seen)
        bounds = materialize(self._bounds(asked, seen, within), "block-bounds")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
        first = materialize(bounds.withColumn("place", place).where(F.col("place") <= top_k).select("query_id", "block"), "blocks-first")
        scored = materialize(self._scored(asked, first, seen, within), "scores-first")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        least = scored.withColumn("rank", rank).where(F.col("rank") == top_k).select("query_id", F.col("score").alias("least"))
        least = materialize(least, "scores-least")  # a row for each query at most
        enough = lambda c: F.col(c) >= F.coalesce("least", F.lit(0.0)) - SLACK
        more = bounds.join(first, ["query_id", "block"], "left_anti").join(least, "query_id", "left").where(enough("bound"))
        late = self._scored(asked, materialize(more.select("query_id", "block"), "blocks-more"), seen, within)
        both = scored.union(late.join(least, "query_id", "left").where(enough("score")).select("query_id", "key", "score"))  # only these are sorted
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(place_of(F.col("score")).desc(), "key"))
        return both.withColumn("rank", best).where(F.col("rank") <= top_k)

    def _weighted(self, queries: DataFrame, seen: State) -> DataFrame:
        """(query_id, term, idf, average, df) of the terms that any document has, written."""
        sizes = self.lengths(seen).first()
        n, average = sizes.n or 0, (sizes.total or 0) / max(1, sizes.n or 0)
        queries = materialize(queries.select("query_id", "term"), "queries")
        known = self.frequencies(seen).join(F.broadcast(queries) if few(queries) else queries, "term")
        return materialize(known.select("query_id", "term", idf(F.lit(n), F.col("df")).alias("idf"), F.lit(average).alias("average"), "df"), "weighted-terms")

    def _bounds(self, asked: DataFrame, seen: State, within: Column | None = None) -> DataFrame:
        """(query_id, block, bound): the most that a document of the block may score."""
        side = asked.groupBy("term").agg(F.collect_list("query_id").alias("asks"), F.first("idf").alias("idf"), F.first("average").alias("average"))
        dealt = asked_only(self._shown(seen, within).select("term", "block", "tf", "dl"), asked).repartition("block")  # all terms of a block in one task: its bounds need no other shuffle
        best = dealt.groupBy("block", "term").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
        met = best.join(F.broadcast(side) if few(asked) else side, "term")
        part = bm25_term(F.col("max_tf"), F.col("min_dl"), F.col("average"), F.col("idf")).alias("part")
        return met.select("block", part, F.explode("asks").alias("query_id")).groupBy("query_id", "block").agg(F.sum("part").alias("bound"))

    def _scored(self, asked: DataFrame, needed: DataFrame, seen: State, within: Column | None) -> DataFrame:
        """(query_id, key, score) of the blocks that each query needs.

        The postings of asked terms meet the list of queries that need their
        block; a block's documents are scored where they meet, without another shuffle.
        Of blocks that no query needs nothing is shuffled, and a task holds about
        ``TASK_POSTINGS`` postings and ``TASK_PAIRS`` pairs of a document and a query.
        """
        side = asked.groupBy("term").agg(F.collect_list("query_id").alias("asks"), F.first("idf").alias("idf"), F.first("average").alias("average"))
        need = needed.groupBy("block").agg(F.collect_set("query_id").alias("need"))
        pairs, held = needed.agg(F.count("*"), F.countDistinct("block")).first()
        postings = (asked.select("term", "df").distinct().agg(F.sum("df")).first()[0] or 0) * min(1, held / seen.blocks)
        parts = max(self.spark.sparkContext.defaultParallelism, math.ceil(pairs * BLOCK_DOCS / TASK_PAIRS), math.ceil(postings / TASK_POSTINGS))
        rows = asked_only(self._shown(seen, within).select("key", "term", "block", "tf", "dl"), asked)
        blocks = needed.select("block").distinct()
        rows = rows.join(F.broadcast(blocks) if seen.blocks <= BROADCAST_KEYS else blocks, "block", "left_semi").repartition(min(parts, MOST_BUCKETS), "block")
        docs = rows.groupBy("block", "term").agg(F.collect_list(F.struct("key", "tf", "dl")).alias("docs"))  # a block has about BLOCK_DOCS
        met = docs.join(need, "block").join(F.broadcast(side) if few(asked) else side, "term").withColumn("asks", F.array_intersect("asks", "need")).where(F.size("asks") > 0)
        each = met.select("block", "idf", "average", "asks", F.explode("docs").alias("d"))
        part = bm25_term(F.col("d.tf"), F.col("d.dl"), F.col("average"), F.col("idf")).alias("part")
        scored = each.select("block", F.col("d.key").alias("key"), part, F.explode("asks").alias("query_id")).groupBy("block", "query_id", "key").agg(F.sum("part").alias("score"))
        return scored.select("query_id", "key", "score")


#: Bounds and scores are sums in different orders.
SLACK = 1e-6


#: Up to so many terms of queries are broadcast to postings, and up to so many keys that are gone; more are joined by a shuffle.
BROADCAST_TERMS, BROADCAST_KEYS = 500_000, 1_000_000


def few(asked: DataFrame) -> bool:
    return asked.count() <= BROADCAST_TERMS


def asked_only(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` whose term a query asks for: where queries are few, what the others hold is not shuffled."""
    terms = asked.select("term").distinct()
    return rows.join(F.broadcast(terms) if few(asked) else terms, "term", "left_semi")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def _rows(docs: DataFrame, key: str, tokens: str, fields: list[str]) -> DataFrame:
    return docs.select(F.col(key).alias("key"), *fields, F.array_compact(F.coalesce(F.col(tokens), F.array().cast("array<string>"))).alias("tokens"))


@dataclass
class Made:
    """Rows, how batches of them become postings, and the schema of those: (key, fields, dl, words, term, tf, places)."""

    rows: DataFrame
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    schema: StructType | str


def _made(rows: DataFrame, forms: bool) -> Made:
    """A posting for each term of a document, and one without term for the document itself.

    Documents are independent, so nothing is shuffled.  ``dl`` is what all
    ``tf`` add up to; ``words`` is how many tokens there are.  A batch is
    counted in Arrow and numpy arrays, each of its words stemmed once, and its
    postings are handed on in slices.
    """
    fields = [c for c in rows.columns if c not in ("key", "tokens")]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ["key", *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _counted(batch, forms)

    return Made(rows.select("key", *fields, "tokens"), run, f"{kinds}, dl int, words int, term string, tf int" + (", places array<int>" if forms else ""))


def _postings(rows: DataFrame, forms: bool) -> DataFrame:
    """(key, fields, dl, words, term, tf, places), as they are made."""
    made = _made(rows, forms)
    small_batches(rows.sparkSession)
    return made.rows.mapInArrow(made.run, made.schema)


def _dealt(made: Made, buckets: int, spread: int, parts: int) -> DataFrame:
    """The postings in ``parts`` partitions, those of a bucket in ``spread`` of them at most; what is shuffled is packed."""

    run = made.run

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(run(batches)):
            yield _packed(held, buckets, spread, parts)

    return made.rows.mapInArrow(pack, "part int, postings binary").repartitionById(parts, F.col("part")).mapInArrow(_unpacked, made.schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of about ``PACK_BYTES`` together, in one list that is used again: who takes it may empty it."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        del batch
        if n >= PACK_BYTES:
            yield held
            held.clear()
            n = 0
    if held:
        yield held


def _packed(held: list[pa.RecordBatch], buckets: int, spread: int, parts: int) -> pa.RecordBatch:
    """(part, postings): for each part that gets any its postings in one value, compressed, with a dictionary of their terms. ``held`` is emptied."""
    table = pa.Table.from_batches(held).combine_chunks()
    held.clear()
    terms, code = _coded(table, "term")
    bucket = np.array([DOCS if t is None else bucket_of(t, buckets) for t in terms], np.int64)[code]
    keys, key = _coded(table, "key") if spread > 1 else ([0], 0)
    part = ((bucket - DOCS) * spread + np.array([zlib.crc32(repr(k).encode()) % spread for k in keys], np.int64)[key]) % parts
    order = np.argsort(part, kind="stable")  # a document's postings stay together
    table, part = table.take(pa.array(order)), part[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    at, packs = table.schema.get_field_index("term"), []
    for start, end in zip(starts, np.append(starts[1:], len(part)), strict=True):
        mine = table.slice(start, end - start)
        mine = mine.set_column(at, "term", mine["term"].dictionary_encode())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, mine.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(mine)
        packs.append(sink.getvalue().to_pybytes())
    del table, mine
    pa.default_memory_pool().release_unused()
    return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array(packs, pa.binary())], names=["part", "postings"])


def _coded(table: pa.Table, column: str) -> tuple[list, np.ndarray]:
    """The values of a column, each once, and the number of each row's; null is a value."""
    coded = table[column].combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of packs, in slices."""
    held, n = [], 0
    for batch in batches:
        for pack in batch.column("postings"):
            table = pa.ipc.open_stream(pack.as_buffer()).read_all()
            at = table.schema.get_field_index("term")
            held.append(table.set_column(at, "term", table["term"].cast(pa.string())))
            n += table.num_rows
            if n >= SLICE_POSTINGS:
                yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=SLICE_POSTINGS)
                held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=SLICE_POSTINGS)


def _counted(batch: pa.RecordBatch, forms: bool) -> Iterator[pa.RecordBatch]:
    """The postings of a batch of documents (key, fields, tokens), which have no null among their tokens."""
    tokens = batch.column("tokens")
    words = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(words)), words)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(words) - words, words)
    if forms:
        made = [stem_forms(w) for w in terms.to_pylist()]
        each = np.fromiter(map(len, made), np.int64, len(made))
        filed = pa.array([f for fs in made for f in fs], terms.type).dictionary_encode()
        terms, form = filed.dictionary, filed.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = each[code]  # each token goes under every form of its word
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = form[np.repeat((np.cumsum(each) - each)[code], n) + within]
        doc, place = np.repeat(doc, n), np.repeat(place, n)
    term_of = doc * (len(terms) + 1) + code + 1  # a document's own row stands before its terms'
    order = np.argsort(term_of, kind="stable")  # places stay in order
    found, first, tf = np.unique(term_of[order], return_index=True, return_counts=True)
    own = np.arange(len(words)) * (len(terms) + 1)
    at = np.searchsorted(found, own)
    found, first, tf = np.insert(found, at, own), np.insert(first, at, np.append(first, len(order))[at]), np.insert(tf, at, 0)
    dl, about = np.bincount(doc, minlength=len(words)), batch.select([c for c in batch.schema.names if c != "tokens"])
    place = place[order]
    for i in range(0, len(found), SLICE_POSTINGS):
        mine = found[i : i + SLICE_POSTINGS]
        at, code = mine // (len(terms) + 1), mine % (len(terms) + 1) - 1
        count, start = tf[i : i + SLICE_POSTINGS], first[i : i + SLICE_POSTINGS]
        out = about.take(pa.array(at))
        columns = [pa.array(dl[at], pa.int32()), pa.array(words[at], pa.int32()), terms.take(pa.array(code, mask=code < 0)), pa.array(count, pa.int32())]
        if forms:
            ends = np.concatenate([[0], np.cumsum(count)])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[start[0] : start[0] + ends[-1]], pa.int32()), mask=pa.array(code < 0)))
        names = [*about.schema.names, "dl", "words", "term", "tf", "places"]
        yield pa.RecordBatch.from_arrays([*out.columns, *columns], names=names[: len(out.columns) + len(columns)])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
