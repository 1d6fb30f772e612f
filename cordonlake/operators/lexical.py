"""Lexical retrieval of a set of questions: chunks are counted where they are read, and scored by tasks that have some of the questions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordonlake.functions.text import STOPWORDS, run_lengths, search_terms, words
from cordonlake.session import give_back, giving_back, in_order, materialize, names_at, read_batches

WEIGHT_ROWS = 2_000_000
TASK_ROWS = 100_000
_CELLS = 8_000_000  # scores held at once
_COUNT_ROWS = 500  # texts whose words are held as Python strings at once


_POSTS = "posts array<struct<item:string,n:int>>, dl int"


def _count(body: pa.Array, out: frozenset[str]) -> pa.Array:
    """``posts`` and ``dl`` of texts without the words ``out``, so many texts at a time that few words are held as Python strings."""
    find, parts = re.compile("[a-z0-9]{3,}").findall, []
    for a in range(0, len(body), _COUNT_ROWS):
        ends, items, counts, lengths = [0], [], [], []
        for text in body[a : a + _COUNT_ROWS].to_pylist():
            held = Counter(find(text.lower())) if text else {}
            for word in out & held.keys():
                del held[word]
            items += held.keys()
            counts += held.values()
            ends.append(len(items))
            lengths.append(sum(held.values()))
        pairs = pa.StructArray.from_arrays([pa.array(items, pa.string()), pa.array(counts, pa.int32())], ["item", "n"])
        parts.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(lengths, pa.int32())], ["posts", "dl"]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("posts", pa.list_(pa.struct([("item", pa.string()), ("n", pa.int32())]))), ("dl", pa.int32())]))


def _counter(stopwords: bool):
    """A column function from texts to their ``posts`` and ``dl``: the words of :func:`words` or :func:`search_terms`."""
    out = frozenset() if stopwords else frozenset(STOPWORDS)

    @F.arrow_udf("struct<" + _POSTS.replace("posts ", "posts:").replace("dl ", "dl:") + ">")
    def count(body: pa.Array) -> pa.Array:
        counts = _count(body, out)
        give_back()
        return counts

    return count


def counted(chunks: DataFrame, stopwords: bool = False) -> DataFrame:
    """``chunks`` with ``dl``, the number of its words, and ``posts``, an array of each distinct word and its count.

    Counts are made within the row, in Arrow batches: no word is shuffled. ``stopwords`` keeps the stopwords. A null body has no words.
    """
    return chunks.select("*", _counter(stopwords)(F.col("body")).alias("_counts")).select(*chunks.columns, "_counts.posts", "_counts.dl")


def indexed(chunks: DataFrame, stopwords: bool = False) -> DataFrame:
    """The chunks without their bodies, counted and written once: :func:`document_frequency` and :func:`scored_top_k` take it in place of chunks."""
    return materialize(counted(chunks, stopwords).drop("body"), "index")


def postings(chunks: DataFrame, stopwords: bool = False) -> DataFrame:
    """``term, chunk_id, tf, dl`` of ``chunk_id, body``: one row per chunk and word, with the words of the chunk."""
    one = counted(chunks.select("chunk_id", "body"), stopwords).select("chunk_id", "dl", F.explode("posts").alias("p"))
    return one.select(F.col("p.item").alias("term"), "chunk_id", F.col("p.n").cast("long").alias("tf"), "dl")


def _kinds(tokens: Column) -> Column:
    """The distinct words of a row; sorted first, as ``array_distinct`` compares every string with every other."""
    return F.transform(run_lengths(tokens), lambda p: p["item"])


def document_frequency(chunks: DataFrame, stopwords: bool = False) -> DataFrame:
    """``term, df``: chunks per word, of chunks with a ``body`` or of :func:`indexed` ones. What a partition holds of a word is added up before the shuffle."""
    if "posts" in chunks.columns:
        return chunks.select(F.explode("posts.item").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    tokens = words(F.col("body")) if stopwords else search_terms(F.col("body"))
    return chunks.select(F.explode(_kinds(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def prune_frequent(df: DataFrame, n_chunks: DataFrame, share: float = 0.3) -> DataFrame:
    """Terms in less than ``share`` of the chunks; ``n_chunks`` is one row ``n``."""
    return df.crossJoin(F.broadcast(n_chunks)).where(F.col("df") < share * F.col("n")).drop("n")


def selective_terms(questions: DataFrame, df: DataFrame, keep: int = 8) -> DataFrame:
    """``query_id, term, df``: the ``keep`` rarest words of each question; words without a frequency come last.

    Distinct words of more than two letters; ties go to the word.
    """
    terms = questions.select("query_id", F.explode(F.array_distinct(words(F.col("question")))).alias("term"))
    order = Window.partitionBy("query_id").orderBy(F.col("df").asc_nulls_last(), "term")
    return terms.join(df, "term", "left").withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).select("query_id", "term", "df")


def top_k(scored: DataFrame, k: int, score: str = "score", item: str = "chunk_id") -> DataFrame:
    """``rank`` 1 to k per query by score, ties to the smaller item."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Weights:
    """Weights of the terms of some queries. Each distinct pair of term and weight is a line; query ``q`` adds up the lines ``line[first[q]:first[q + 1]]``."""

    def __init__(self, rows: pa.Table):
        terms, queries = (rows.column(c).combine_chunks().dictionary_encode() for c in ("term", "query_id"))
        self.terms, term = terms.dictionary, terms.indices.to_numpy()
        self.queries, query = queries.dictionary, queries.indices.to_numpy()
        pairs, line = np.unique(np.stack([term, rows.column("weight").to_numpy()], 1), axis=0, return_inverse=True)
        self.term, self.weight = pairs[:, 0].astype(np.int64), pairs[:, 1]
        order = np.argsort(query, kind="stable")
        self.line = line.ravel()[order]
        self.first = np.searchsorted(query[order], np.arange(len(self.queries) + 1))

    def blocks(self, most: int) -> Iterator[tuple[int, int, np.ndarray, list[list[int]]]]:
        """Runs of queries with at most ``most`` lines among them, or one query: from, to, their lines, and for each query its own among these."""
        lo, used = 0, {}
        own: list[list[int]] = []
        for q in range(len(self.queries)):
            lines = self.line[self.first[q] : self.first[q + 1]].tolist()
            if own and len(used) + sum(x not in used for x in lines) > most:
                yield lo, q, np.fromiter(used, np.int64), own
                lo, used, own = q, {}, []
            own.append([used.setdefault(x, len(used)) for x in lines])
        if own:
            yield lo, len(self.queries), np.fromiter(used, np.int64), own


def _search(w: _Weights, files: list[str], impact, k: int, cells: int) -> Iterator[pa.RecordBatch]:
    """The k best chunks of each query, of chunks that come in order of their ids: of equal scores the one that came first is kept.

    What is held are the k best of each query and one table of scores of lines by chunks, of about ``cells`` values.
    """
    q_n = len(w.queries)
    blocks = list(w.blocks(max(1, cells // 512)))
    most = max(len(lines) for _, _, lines, _ in blocks)
    width = max(1, min(8192, cells // most))
    table, room = np.zeros((most, width)), np.empty(width)
    scores, places, floor = [np.zeros(0)] * q_n, [np.zeros(0, np.int64)] * q_n, np.zeros(q_n)  # floor: what a score must exceed
    base = 0
    for batch in read_batches(files, ["chunk_id", "posts", "dl"], width):
        posts, n = batch.column("posts"), batch.num_rows
        flat = posts.flatten()
        sizes = pc.fill_null(pc.list_value_length(posts), 0).to_numpy(zero_copy_only=False)
        term = pc.fill_null(pc.index_in(flat.field("item"), value_set=w.terms), -1).to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        order = order[np.searchsorted(term[order], 0) :]
        chunk = np.repeat(np.arange(n), sizes)[order]
        value = impact(flat.field("n").to_numpy(zero_copy_only=False)[order].astype(float), batch.column("dl").to_numpy(zero_copy_only=False)[chunk].astype(float))
        start = np.searchsorted(term[order], np.arange(len(w.terms) + 1))
        for lo, _, lines, own in blocks:
            table[: len(lines)] = 0
            of = w.term[lines]
            held = start[of + 1] - start[of]
            at = np.repeat(start[of] - np.cumsum(held) + held, held) + np.arange(held.sum())
            table[np.repeat(np.arange(len(lines)), held), chunk[at]] = value[at] * np.repeat(w.weight[lines], held)
            rows = [r if h else None for r, h in zip(table[: len(lines), :n], held.tolist())]
            for q, mine in enumerate(own, lo):
                parts = [rows[x] for x in mine if rows[x] is not None]
                if not parts:
                    continue
                score = parts[0]
                for part in parts[1:]:
                    score = np.add(score, part, room[:n])
                least = floor[q]
                if score.max() <= least + 4e-7:  # rounded, not above it
                    continue
                new = np.flatnonzero(score > least + 4e-7)
                s = np.round(score[new], 6)
                if len(s) > k:
                    good = s >= np.partition(s, len(s) - k)[len(s) - k]
                    new, s = new[good], s[good]
                good = s > least
                s, new = np.concatenate([scores[q], s[good]]), np.concatenate([places[q], new[good] + base])
                best = np.argsort(-s, kind="stable")[:k]
                scores[q], places[q] = s[best], new[best]
                if len(best) == k:
                    floor[q] = s[best[-1]]
        base += n
    sizes = np.array([len(s) for s in scores])
    all_places = np.concatenate(places)
    found, at = np.unique(all_places, return_inverse=True)
    names, all_scores = names_at(files, "chunk_id", found), np.concatenate(scores)
    query, rank = np.repeat(np.arange(q_n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    for a in range(0, len(query), 50_000):
        b = a + 50_000
        yield pa.RecordBatch.from_arrays([w.queries.take(pa.array(query[a:b])), names.take(pa.array(at[a:b])), pa.array(all_scores[a:b]), pa.array(rank[a:b].astype(np.int32))], ["query_id", "chunk_id", "score", "rank"])


def _posts_of(posts: DataFrame, terms: pa.Array) -> DataFrame:
    """``chunk_id, posts, dl`` with the posts of some terms only, without chunks that have none."""
    shared = posts.sparkSession.sparkContext.broadcast(terms)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("posts")
            flat = held.flatten()
            known = pc.is_in(flat.field("item"), value_set=shared.value)
            n = np.bincount(np.repeat(np.arange(batch.num_rows), pc.list_value_length(held).to_numpy(zero_copy_only=False))[known.to_numpy(zero_copy_only=False)], minlength=batch.num_rows)
            left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat.filter(known))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), left, batch.column("dl")], ["chunk_id", "posts", "dl"]).filter(pa.array(n > 0))

    return posts.mapInArrow(giving_back(keep), "chunk_id string, " + _POSTS)


def scored_top_k(chunks: DataFrame, weights: DataFrame, k: int, impact, stopwords: bool = False) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the k best of ``chunks`` (``chunk_id, body``, or :func:`indexed` ones) per query by the sum of weight x impact.

    The counted chunks are written once, in order of their ids and with those words only that a query has (all of them, if the queries have
    more than ``WEIGHT_ROWS`` words). Queries (``query_id, term, weight``) are spread over tasks, about ``TASK_ROWS`` weights each, and a task reads
    the counted chunks from the shared folder and keeps the k best of each of its queries, so neither pairs of chunks and queries nor
    lists of parts of the chunks are shuffled. ``impact(tf, dl)`` works on whole columns. Scores are rounded to 6 decimals before
    they are ranked, so the order of summing cannot turn a tie; chunks that score 0 are not found.
    """
    spark = chunks.sparkSession
    weights = materialize(weights.where("query_id is not null and term is not null").select(F.col("query_id").cast("string"), "term", F.col("weight").cast("double")), "weights")
    named = chunks.where("chunk_id is not null").withColumn("chunk_id", F.col("chunk_id").cast("string"))
    posts = (named if "posts" in chunks.columns else counted(named.select("chunk_id", "body"), stopwords)).select("chunk_id", "posts", "dl")
    terms = weights.select("term").distinct().limit(WEIGHT_ROWS + 1).toArrow().column(0).combine_chunks().cast(pa.string())
    if len(terms) <= WEIGHT_ROWS:
        posts = _posts_of(posts, terms)
    files, cells = in_order(posts, "posts", "chunk_id"), _CELLS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from _search(_Weights(pa.Table.from_batches(rows)), files, impact, k, cells)

    parts = max(2 * spark.sparkContext.defaultParallelism, -(-weights.count() // TASK_ROWS))
    return weights.repartition(parts, "query_id").mapInArrow(giving_back(search), "query_id string, chunk_id string, score double, rank int")


def or_search(terms: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, chunk_id, score, rank``: chunks that hold any of the terms (``query_id, term``), by 0.1 per occurrence."""
    return scored_top_k(chunks, terms.select("query_id", "term", F.lit(0.1).alias("weight")), k, lambda tf, dl: tf)


def bm25_search(questions: DataFrame, chunks: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, chunk_id, score, rank`` by BM25 over each distinct word of a question without stopwords.

    Frequencies and lengths are those of all ``chunks`` (``chunk_id, body``) that have words; ``allowed`` are the chunks that are scored,
    by default all. Frequencies, the number of chunks and their lengths come from one pass.
    """
    terms = questions.select("query_id", F.explode(F.array_distinct(search_terms(F.col("question")))).alias("term"))
    tokens = chunks.select(search_terms(F.col("body")).alias("t")).where(F.size("t") > 0)
    # the empty word stands for the chunk itself
    marked = F.concat(F.array(F.struct(F.lit("").alias("term"), F.size("t").alias("dl"))), F.transform(_kinds(F.col("t")), lambda x: F.struct(x.alias("term"), F.lit(0).alias("dl"))))
    every = tokens.select(F.explode(marked).alias("e")).select("e.*")
    stats = materialize(every.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("words")), "frequencies")
    whole = stats.where("term = ''").first()
    if whole is None:
        return questions.sparkSession.createDataFrame([], "query_id string, chunk_id string, score double, rank int")
    n, mean = whole["df"], whole["words"] / whole["df"]
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(stats.where("term <> ''"), "term").select("query_id", "term", idf.alias("weight"))
    return scored_top_k(chunks if allowed is None else allowed, weights, k, lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)))
