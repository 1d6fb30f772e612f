"""From parsed documents to chunks, tenants and duplicates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from cordonlake.functions.text import bound, checksum, heading, plain, sampled_shingles, starts_mid_sentence
from cordonlake.session import give_back, giving_back, materialize, read_batches, stacked, unique_rows


PAGE_CHARS = 3000
_CHUNK = "chunk_id string, doc_id string, tenant string, source string, ordinal int, n_tokens int, page int, section string, start int, end int, end_page int, end_section string, body string"

_RUN = "doc_id string, tenant string, source string, first_block int, n_blocks int, section string, page int, start long, n_chars long, before string"


def one_per_document(docs: DataFrame) -> DataFrame:
    """Each ``doc_id`` once; rows of one id are repetitions of each other. Texts are not shuffled where rows come from files."""
    return unique_rows(docs, "doc_id")


def token_list(text: Column) -> Column:
    """White-space separated tokens; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of windows of ``size`` tokens; the last is the first that reaches the end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / step).cast("int") * step)
    return F.when(F.size(tokens) > 0, F.sequence(F.lit(0), last, F.lit(step)))


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 76, shortest: int = 40) -> DataFrame:
    """``chunk_id, doc_id, tenant, source, ordinal, n_tokens, body`` of overlapping windows of a document's tokens.

    Bodies are cut within the row, so the tokens of a document exist once. Chunks below ``shortest`` characters are left out and
    leave a gap in ``ordinal``. :func:`placed_chunks` gives the same chunks with their places.
    """
    step = size - overlap

    def cut(t: Column) -> Column:
        return F.transform(windows(t, size, overlap), lambda at: F.struct((at / step).cast("int").alias("ordinal"), F.least(F.lit(size), F.size(t) - at).alias("n_tokens"), F.array_join(F.slice(t, at + 1, size), " ").alias("body")))

    one = docs.select("doc_id", "tenant", "source", F.explode(bound(token_list(F.col("text")), cut)).alias("c")).select("doc_id", "tenant", "source", "c.*")
    out = one.select(F.format_string("%s::fixed-%d::%05d", "doc_id", F.lit(size), "ordinal").alias("chunk_id"), "doc_id", "tenant", "source", "ordinal", "n_tokens", "body")
    return out.where(F.length("body") >= shortest)


def placed_chunks(docs: DataFrame, by_section: bool = False, size: int = 512, overlap: int = 76, shortest: int = 40) -> DataFrame:
    """Chunks with their place: the columns of :func:`fixed_chunks`, ``page``, ``section`` and character ``start`` at which a chunk begins and those
    at which it ends (``end`` is the position after its last character).

    ``by_section``: chunks never cross a section, ``page`` is that on which the section opens, and ``ordinal`` counts those that are kept,
    so it has no gaps. A document is cut where it is read, in one pass over its tokens and blocks; nothing is shuffled.

    Args:
        docs: ``doc_id, tenant, source, text, blocks``; other columns are ignored. ``text`` is the blocks joined by one newline. Without
            blocks pages and sections are null, and the document is one section.
    """
    token, step = re.compile(r"\S+", re.A), size - overlap

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, tenant, source, text, lens, pages, sections in zip(*(pdf[c] for c in ("doc_id", "tenant", "source", "text", "lens", "pages", "sections"))):
                spans = [m.span() for m in token.finditer(text or "")]
                if not spans:
                    continue
                starts = np.array([a for a, _ in spans])
                lens = np.asarray(lens if lens is not None else [], np.int64)
                edge = np.concatenate([[0], np.cumsum(lens + 1)])  # where blocks begin
                place = lambda pos: min(int(np.searchsorted(edge, pos, side="right")) - 1, len(lens) - 1)  # noqa: B023, E731
                new = [i for i in range(len(lens)) if i and sections[i] != sections[i - 1]] if by_section else []
                bounds = [0, *(int(np.searchsorted(starts, edge[i])) for i in new), len(spans)]
                ordinal = 0
                for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                    n, opens = hi - lo, ([0, *new][i] if by_section and len(lens) else None)
                    last = max(0, -(-(n - size) // step)) if n else -1
                    for k in range(last + 1):
                        a, b = lo + k * step, min(hi, lo + k * step + size)
                        body = " ".join(text[x:y] for x, y in spans[a:b])
                        if len(body) < shortest:
                            ordinal += not by_section
                            continue
                        first, end = spans[a][0], spans[b - 1][1]
                        at, to = (place(first), place(end - 1)) if len(lens) else (None, None)
                        look = lambda values, i: None if i is None else values[i]
                        name = f"{doc}::section::{ordinal:05d}" if by_section else f"{doc}::fixed-{size}::{ordinal:05d}"
                        rows.append((name, doc, tenant, source, ordinal, b - a, look(pages, at if opens is None else opens), look(sections, at), first, end, look(pages, to), look(sections, to), body))
                        ordinal += 1
            if rows:
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in _CHUNK.split(", ")])
                for c in ("page", "end_page"):
                    out[c] = out[c].astype("Int32")
                yield out

    return docs.select(F.col("doc_id").cast("string"), "tenant", "source", "text", *_block_arrays()).mapInPandas(cut, _CHUNK)


def span_report(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of :func:`placed_chunks` with ``crosses_section`` and ``mid_sentence``: whether the 60 characters before it end within a sentence."""
    texts = docs.select("doc_id", "text")
    before = F.rtrim(F.substring(F.col("text"), F.greatest(F.lit(1), F.col("start") - 59), F.least(F.lit(60), F.col("start"))), F.lit(" \n"))
    return chunks.join(texts, "doc_id").select(*chunks.columns, (~F.col("section").eqNullSafe(F.col("end_section"))).alias("crosses_section"), starts_mid_sentence(before).alias("mid_sentence"))


def _block_arrays() -> list[Column]:
    return [F.transform("blocks", lambda b: F.coalesce(b["len"], F.lit(0))).alias("lens"), F.transform("blocks", lambda b: b["page"]).alias("pages"), F.transform("blocks", lambda b: b["section"]).alias("sections")]


def section_runs(docs: DataFrame, before: int = 0) -> DataFrame:
    """``doc_id, tenant, source, first_block, n_blocks, section, page, start, n_chars, before``: longest runs of blocks of one section.

    ``start`` is the position of the run in the text, from 0; ``page`` that of its first block; ``before`` the characters that stand ahead of
    it, at most so many. Runs are found where a document is read; nothing is shuffled.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, tenant, source, text, lens, pages, sections in zip(*(pdf[c] for c in ("doc_id", "tenant", "source", "text", "lens", "pages", "sections"))):
                if lens is None or not len(lens):
                    continue
                edge = np.concatenate([[0], np.cumsum(np.asarray(lens, np.int64) + 1)])
                first = [i for i in range(len(lens)) if not i or sections[i] != sections[i - 1]]
                for i, j in zip(first, [*first[1:], len(lens)]):
                    start = int(edge[i])
                    rows.append((doc, tenant, source, i, j - i, sections[i], pages[i], start, int(edge[j] - edge[i] - 1), (text or "")[max(0, start - before) : start]))
            if rows:
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in _RUN.split(", ")])
                out["page"] = out["page"].astype("Int32")
                yield out

    text = F.col("text") if before else F.lit(None).cast("string").alias("text")
    return docs.select(F.col("doc_id").cast("string"), "tenant", "source", text, *_block_arrays()).mapInPandas(find, _RUN)


@F.pandas_udf(ArrayType(IntegerType()))
def _estimated_pages(sizes: pd.Series) -> pd.Series:
    """Page of each line of a text without page marks: a line that takes a page over ``PAGE_CHARS`` opens the next one."""
    out = []
    for line_sizes in sizes:
        page, held, pages = 1, 0, []
        for n in line_sizes:
            held += n + 1 if n else 0
            if held > PAGE_CHARS:
                page, held = page + 1, 0
            pages.append(page)
        out.append(pages)
    return pd.Series(out)


def lines_with_sections(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, line_no, page, section`` of every line that is not blank.

    Form feeds count pages; texts without any get estimated pages of ``PAGE_CHARS`` characters. Headings carry on, ``preamble`` comes before the first.
    """
    trimmed = lambda x: F.length(F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    parts = texts.where("text is not null").select(F.col(id_col).alias("doc_id"), F.split("text", "\n").alias("lines"), F.contains("text", F.lit("\f")).alias("fed"))
    sized = parts.withColumn("pages", F.when(~F.col("fed"), _estimated_pages(F.when(~F.col("fed"), F.transform("lines", trimmed)).otherwise(F.array().cast("array<int>")))))
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\f"), F.lit("")))
    each = F.transform("lines", lambda x, i: F.struct(x.alias("line"), feeds(x).alias("feeds"), F.get("pages", i).alias("est")))
    zipped = sized.select("doc_id", F.posexplode(each).alias("line_no", "z"), "fed")
    lines = zipped.select("doc_id", "line_no", "fed", "z.feeds", "z.est", heading(F.replace(F.col("z.line"), F.lit("\f"), F.lit(""))).alias("head"), (trimmed(F.col("z.line")) > 0).alias("said"))
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    page = F.when(F.col("fed"), 1 + F.sum("feeds").over(so_far)).otherwise(F.col("est")).cast("int")
    marked = lines.withColumn("page", page).withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(so_far), F.lit("preamble")))
    return marked.where("said").select("doc_id", "line_no", "page", "section")


def validity(texts: DataFrame, shortest: int = 200) -> DataFrame:
    """``doc_id, state`` of ``doc_id, text``: ``missing`` (no text), ``short`` (below ``shortest`` characters) or ``valid``; a bad one stops nothing."""
    n = F.length(F.trim("text"))
    return texts.select("doc_id", F.when(F.coalesce(n, F.lit(0)) == 0, "missing").when(n < shortest, "short").otherwise("valid").alias("state"))


def duplicates_by_accession(left: DataFrame, right: DataFrame) -> DataFrame:
    """``doc_id, dropped_for``: documents of ``left`` whose file name holds the accession number of one of ``right`` (both ``doc_id, identifier``).

    An accession number is the first run of ten digits or more once dashes are gone; of several documents the smallest id is taken.
    """
    digits = F.regexp_extract(F.replace("identifier", F.lit("-"), F.lit("")), r"([0-9]{10,})", 1)
    a, b = (x.where(digits != "").select("doc_id", digits.alias("digits")) for x in (left, right))
    keep = b.groupBy("digits").agg(F.min("doc_id").alias("dropped_for"))
    return a.join(keep, "digits").where("doc_id <> dropped_for").groupBy("doc_id").agg(F.min("dropped_for").alias("dropped_for"))


def first_decision(*stages: tuple[str, DataFrame]) -> DataFrame:
    """``doc_id, stage, dropped_for``: of the stages (name, ``doc_id, dropped_for``) that drop a document the first one decides."""
    parts = [df.select("doc_id", F.struct(F.lit(i).alias("i"), F.lit(name).alias("stage"), "dropped_for").alias("s")) for i, (name, df) in enumerate(stages)]
    return stacked(*parts).groupBy("doc_id").agg(F.min("s").alias("s")).select("doc_id", "s.stage", "s.dropped_for")


def duplicates_by_checksum(docs: DataFrame) -> DataFrame:
    """``doc_id, dropped_for``: documents whose plain text another document of a smaller id has."""
    sums = docs.where("text is not null").select("doc_id", checksum(F.col("text")).alias("c"))
    keepers = sums.groupBy("c").agg(F.min("doc_id").alias("dropped_for"), F.count("*").alias("n")).where("n > 1").drop("n")
    return sums.join(keepers, "c").where("doc_id <> dropped_for").select("doc_id", "dropped_for")


TASK_DOCS = 4_000  # documents that a task looks up
_PAIR_CELLS = 2_000_000  # pairs of documents counted at once
_FILTER_BITS = 24


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingle_hashes(words: pa.ListArray, n: int, rows: int = 500) -> pa.ListArray:
    """The distinct sequences of ``n`` words of each text, as hashes of 64 bits; ``words`` are hashes of its words."""
    sizes, values = [], []
    for a in range(0, len(words), rows):
        part = words[a : a + rows]
        w = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        h = np.zeros(max(0, len(w) - n + 1), np.uint64)
        for j in range(n if len(h) else 0):
            h = _mix(h + w[j : j + len(h)] + np.uint64(1))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))
        for lo, hi in zip(np.concatenate([[0], ends]), ends):
            values.append(np.unique(h[lo : max(lo, hi - n + 1)]))
            sizes.append(len(values[-1]))
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _shingles(docs: DataFrame, n: int, sample: bool) -> DataFrame:
    """``doc, s``: the distinct shingles of each document as hashes of 64 bits (of 10 million, two are equal by chance with odds of 1 in 300,000); documents without any are left out."""
    if sample:
        hashed = F.transform(sampled_shingles(F.col("text"), n), lambda h: F.xxhash64(h))
    else:

        @F.arrow_udf("array<bigint>")
        def every(words: pa.Array) -> pa.Array:
            out = _shingle_hashes(words, n)
            give_back()
            return out

        hashed = every(F.transform(F.split(plain(F.col("text")), " "), lambda w: F.xxhash64(w)))
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), hashed.alias("s")).where(F.size("s") > 0)


def _best_holders(left: pa.Table, files: list[str], threshold: float) -> tuple[np.ndarray, ...]:
    """Of each document of ``left`` (``doc, s``): its shingles, the most that one of the documents in ``files`` shares, and that document (the smallest id).

    Shares below the threshold are not followed; ``most`` is 0 where none reaches it.
    """
    ids, lists = left.column("doc").combine_chunks(), left.column("s").combine_chunks()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.argsort(flat, kind="stable")
    known, first = np.unique(flat[order], return_index=True)
    holder, last = np.repeat(np.arange(len(n)), n)[order], np.append(first[1:], len(flat))
    likely = np.zeros(1 << _FILTER_BITS, bool)  # most of what is read is in no list: one look tells
    shift = np.uint64(64 - _FILTER_BITS)
    likely[known >> shift] = True
    need = np.maximum(1, np.ceil((threshold - 5e-7) * n - 1e-6)).astype(np.int64)
    most, best = np.zeros(len(n), np.int64), np.full(len(n), None, object)
    for batch in read_batches(files, ["doc", "s"], max(1, min(256, _PAIR_CELLS // len(n)))):
        batch = batch.take(pc.sort_indices(batch.column("doc")))  # the first of equal ones is the smallest
        names = np.array([*batch.column("doc").to_pylist(), None], object)[:-1]
        sizes = pc.list_value_length(batch.column("s")).to_numpy(zero_copy_only=False)
        h, row = batch.column("s").flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
        kept = np.flatnonzero(likely[h >> shift])
        h, row = h[kept], row[kept]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        same = known[at] == h
        at, row = at[same], row[same]
        held = last[at] - first[at]
        upto = np.cumsum(held)
        count, lo = np.zeros(len(names) * len(n), np.int64), 0
        while lo < len(at):  # some pairs at a time
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIR_CELLS)))
            some = held[lo:hi]
            place = np.repeat(first[at[lo:hi]] - np.cumsum(some) + some, some) + np.arange(some.sum())
            count += np.bincount(np.repeat(row[lo:hi] * len(n), some) + holder[place], minlength=len(count))
            lo = hi
        count = count.reshape(len(names), len(n))
        own = pc.fill_null(pc.index_in(ids, value_set=batch.column("doc")), -1).to_numpy(zero_copy_only=False)
        count[own[own >= 0], np.flatnonzero(own >= 0)] = 0  # a document does not hold itself
        top = count.argmax(0)
        now = count[top, np.arange(len(n))]
        more = (now >= need) & (now > most)
        tied = np.flatnonzero((now >= need) & (now == most))
        more[tied[names[top[tied]] < best[tied]]] = True
        most[more], best[more] = now[more], names[top[more]]
    return n, most, best


def contained(left: DataFrame, right: DataFrame, threshold: float = 0.8, shingle: int = 5, sample: bool = False) -> DataFrame:
    """``doc_id, dropped_for, containment``: documents of ``left`` whose shingles are largely in one of ``right``; ids are unique on each side.

    Containment is measured on all distinct shingles, with ``sample`` on one in sixteen, chosen by its hash. The best document is taken, ties to the
    smaller id. The shingles of ``right`` are written once; documents of ``left`` are spread over tasks that read all of them and count
    what they share, so neither shingles of the right nor pairs of documents are shuffled.
    """
    spark = left.sparkSession
    files = sorted(materialize(_shingles(right, shingle, sample), "shingles").inputFiles())
    kinds = dict(left.dtypes)["doc_id"], dict(right.dtypes)["doc_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            held = pa.Table.from_batches(rows)
            n, most, best = _best_holders(held, files, threshold)
            at = np.flatnonzero(most)
            names = held.column("doc").combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(best[at].tolist(), out_type), pa.array(most[at]), pa.array(n[at])], ["doc_id", "dropped_for", "most", "n"])

    out_type = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kinds[1]]
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-left.where("text is not null").count() // TASK_DOCS))
    found = _shingles(left, shingle, sample).repartition(parts, "doc").mapInArrow(giving_back(find), f"doc_id {kinds[0]}, dropped_for {kinds[1]}, most long, n long")
    return found.select("doc_id", "dropped_for", F.round(F.col("most") / F.col("n"), 6).alias("containment")).where(F.col("containment") >= threshold)


def fold_small_tenants(counts: DataFrame, floor: int) -> DataFrame:
    """``tenant, n, merged`` of ``source, tenant, n``: tenants below ``floor`` go to ``<source>-misc``."""
    return counts.select("tenant", "n", F.when(F.col("n") < floor, F.concat("source", F.lit("-misc"))).otherwise(F.col("tenant")).alias("merged"))


def newest(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in an order, ``position`` from 1; rows with a null key are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def middle(df: DataFrame, key: str, value: Column, item: str) -> DataFrame:
    """The row in the middle (position n // 2 from 0) of each key by value and item."""
    w = Window.partitionBy(key)
    counted = df.withColumn("value", value).withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy("value", item)) - 1)
    return counted.where(F.col("at") == F.floor(F.col("n") / 2)).select(key, item, "value")


def positions(docs: DataFrame, step: int = 3000) -> DataFrame:
    """``doc_id, position, page, section`` of every ``step``-th character, from the running length of the blocks."""
    b = docs.select("doc_id", F.posexplode("blocks").alias("at", "b")).select("doc_id", "at", "b.len", "b.page", "b.section")
    end = F.sum(F.col("len") + 1).over(Window.partitionBy("doc_id").orderBy("at"))
    spans = b.withColumn("end", end).withColumn("begin", F.col("end") - F.col("len") - 1)
    first = F.ceil(F.col("begin") / step).cast("long") * step
    return spans.where(first < F.col("end")).select("doc_id", F.explode(F.sequence(first, ((F.col("end") - 1) / step).cast("long") * step, F.lit(step).cast("long"))).alias("position"), "page", "section")
