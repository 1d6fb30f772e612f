"""Groups of near-duplicate texts by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordonlake.llm.words import mix64, shingle_hashes, word_hashes
from cordonlake.session import materialize, stacked

BITS = 23  # length of a word of the perfect binary Golay code, which decodes every word within 3 errors
SHORT = 64  # shingles; with fewer, min-hashes of one text repeat too often for its fingerprint to be held against others
_SKETCH = "doc string, c1 long, c2 long, n_shingles int, sketch array<long>, keys array<long>"


@cache
def _decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and of the high bits of a word, and the error pattern of each syndrome.

    All three tables follow from the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
    """
    generator = 0b110001110101
    single = []
    for bit in range(BITS):
        rest = 1 << bit
        for high in range(bit, 10, -1):
            if rest >> high & 1:
                rest ^= generator << (high - 11)
        single.append(rest)

    def table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int32)
        for s in bits:
            out = np.concatenate([out, out ^ s])
        return out

    low, high = table(single[:12]), table(single[12:])
    error = np.zeros(1 << 11, np.int32)
    for a in range(-1, BITS):
        for b in range(a if a < 0 else a + 1, BITS):
            for c in range(b if b < 0 else b + 1, BITS):
                bits = [x for x in (a, b, c) if x >= 0]
                pattern = sum(1 << x for x in set(bits))
                syndrome = 0
                for x in set(bits):
                    syndrome ^= single[x]
                error[syndrome] = pattern
    return low, high, error


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the code word nearest to each 23-bit word."""
    low, high, error = _decoder()
    words = words.astype(np.int32)
    return (words ^ error[low[words & 4095] ^ high[words >> 12]]) >> 11


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the code words reached from each word by at most one further error: one or six of them.

    Two words that differ in at most two bits have a word between them that is one step from both, so they share an
    index. Returns the indices, (n, 24), and a mask of those that are the first of their value.
    """
    steps = np.concatenate([[0], 1 << np.arange(BITS)]).astype(np.int32)
    found = np.sort(nearest_codeword(words[:, None] ^ steps), axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, fresh


def _minima(shingles: np.ndarray, owner: np.ndarray, texts: int, slots: int, seed: int) -> np.ndarray:
    """Min-hash values (texts, slots): each round spreads the shingles over 64 slots and takes each slot's minimum.

    An empty slot borrows from others in an order that is the same for all texts.
    """
    rounds, width = -(-slots // 64), 64
    out = np.empty((texts, rounds * width), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        for r in range(rounds):
            h = mix64(shingles + np.uint64((seed * 1000 + r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            slot = owner * width + (h >> np.uint64(58)).astype(np.int64)
            low = np.full(texts * width, top, np.uint64)
            np.minimum.at(low, slot, h)
            low = low.reshape(texts, width)
            lender = np.random.default_rng(seed + r)
            for _ in range(64):
                empty = low == top
                if not empty.any():
                    break
                low = np.where(empty, low[:, lender.permutation(width)], low)
            out[:, r * width : (r + 1) * width] = low
    return mix64(out[:, :slots] + np.arange(slots, dtype=np.uint64))


def _sketches(texts: pd.Series, shingle: int, segments: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Content keys, shingle counts, fingerprints (64 bits to a number) and bucket keys of texts."""
    with np.errstate(over="ignore"):
        words, offsets = word_hashes(texts)
        n = len(texts)
        text_of = np.repeat(np.arange(n), np.diff(offsets))
        place = (np.arange(len(words)) - offsets[text_of]).astype(np.uint64)
        content = np.zeros((n, 2), np.uint64)
        for i, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            np.add.at(content[:, i], text_of, mix64(words ^ mix64(place * np.uint64(c) + np.uint64(i + 1))))
        s, owner = shingle_hashes(words, offsets, shingle)
        order = np.argsort(s, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
        s, owner = s[order], owner[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        s, owner = s[fresh], owner[fresh]
        count = np.bincount(owner, minlength=n)
        low = _minima(s, owner, n, segments * (BITS + 1), 1)
        bits = (low[:, : segments * BITS] & np.uint64(1)).astype(np.int32).reshape(n, segments, BITS)
        words23 = (bits << np.arange(BITS)).sum(2)
        anchors = low[:, segments * BITS :]
        flags = np.pad(bits.reshape(n, -1).astype(np.uint8), ((0, 0), (0, -segments * BITS % 64)))
        sketch = np.packbits(flags, axis=1).view(np.int64)
        found, fresh = codeword_keys(words23.reshape(-1))
        prefix = mix64(anchors + np.arange(segments, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(-1)
        keys = mix64(prefix[:, None] ^ found.astype(np.uint64)).view(np.int64)
        per = fresh.reshape(n, -1)
        flat, ends = keys.reshape(n, -1)[per], np.cumsum(per.sum(1))[:-1]
        return content, count, list(sketch), np.split(flat, ends)


def _shingle_sets(docs: pd.Series, texts: pd.Series, shingle: int) -> dict[str, np.ndarray]:
    """Sorted shingle hashes of each document of a batch, hashed once however often it occurs."""
    once = pd.DataFrame({"doc": docs, "text": texts}).drop_duplicates("doc")
    words, offsets = word_hashes(once["text"])
    hashes, owner = shingle_hashes(words, offsets, shingle)
    bounds = np.searchsorted(owner, np.arange(len(once) + 1))
    return {d: np.unique(hashes[a:b]) for d, a, b in zip(once["doc"], bounds[:-1], bounds[1:])}


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if shared else 0.0


def connect(links: DataFrame) -> DataFrame:
    """Connected components ``id, component`` (the smallest id) of links ``a, b``, by repeated star contraction.

    Each round joins every vertex to the smallest neighbour of its star; the number of rounds grows with the logarithm
    of the longest path. Each round is a written table, only a count comes to the driver.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    size = -1
    while True:
        # large star: neighbours above a vertex link to its smallest neighbour
        both = stacked(edges, edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a vertex, and the vertex, link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = stacked(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), low.withColumnRenamed("m", "v"))
        edges = materialize(small.distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == size:
            break
        size = tuple(state)
    tops = edges.select(F.col("v").alias("u"), "v").distinct()
    return stacked(edges, tops).select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5,
                    segments: int = 24, sketch_sigmas: float | None = 5.0, broadcast_rows: int = 1_000_000, all_links: bool = False, salt_rows: int = 500) -> tuple[DataFrame, DataFrame]:
    """Groups of texts whose shingle sets share at least ``threshold``, directly or through others.

    Method: a fingerprint of ``segments`` words of 23 bits, one bit of a min-hash each, so that two texts of similarity s
    differ in a bit with probability (1 - s) / 2. Every segment is decoded to the indices of the nearby words of the
    Golay code. By the pigeonhole principle two fingerprints with at most 3 * segments - 1 differing bits have a segment
    with at most two, and that segment gives them a common index. As 4,096 indices cannot tell millions of texts
    apart, a bucket is a segment's index together with a min-hash of the segment's own, which similar texts share with
    probability s. So a pair meets in one of 24 segments with probability 0.992 at s = 0.55, 0.999 at 0.6 and more above; with 12 segments it is
    0.91 and 0.97. ``segments`` can be raised for more. Pairs that meet in a bucket are compared in their whole
    fingerprints before their texts are fetched: a pair at the threshold differs in a share of (1 - threshold) / 2 of the bits, and one that differs in
    ``sketch_sigmas`` standard deviations more is not verified. At 5, which a linked pair exceeds less than once in a million times, a pair of similarity
    0.25 passes once in 700 times. Texts of fewer than ``SHORT`` shingles, whose bits depend on each other, are always verified, and with
    None every pair that meets is. Texts of the same words are one class and only its smallest id is compared.

    Buckets are first linked to their smallest member and verified, which takes one pair per member; only members that
    this leaves in different groups are then paired, so a large group of near copies never expands into all its pairs.
    That is enough for the groups, but leaves out links within a group. With ``all_links`` every pair of classes that meets
    in a bucket is verified instead; buckets of more than ``salt_rows`` members are split over several tasks.

    Args:
        df: repeated ids count once (of differing texts the one of the smallest content key). Further columns are ignored.
            Rows with a null id, a null text or no word are in no group.

    Returns:
        ``(doc, class_id, group_id)`` with one row per document that has words; ``(a, b, similarity)``, verified links
        between classes, enough of them to give the groups, or all with ``all_links``. ``class_id`` and ``group_id`` are smallest ids. An empty input gives no rows.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                content, count, bits, keys = _sketches(part["text"], shingle, segments)
                c = content.view(np.int64)
                yield pd.DataFrame({"doc": part["doc"].to_numpy(), "c1": c[:, 0], "c2": c[:, 1], "n_shingles": count, "sketch": bits, "keys": keys})[count > 0]

    texts = df.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    rows = texts.mapInPandas(sketch, _SKETCH)
    docs = materialize(rows, "sketches")
    of = docs.groupBy("doc").agg(F.min(F.struct("c1", "c2")).alias("c")).select("doc", "c.c1", "c.c2")
    reps = of.groupBy("c1", "c2").agg(F.min("doc").alias("rep"))
    classes = of.join(reps, ["c1", "c2"]).select("doc", F.col("rep").alias("class_id"))
    heads = docs.join(reps, (docs["doc"] == reps["rep"]) & (docs["c1"] == reps["c1"]) & (docs["c2"] == reps["c2"]), "left_semi").dropDuplicates(["doc"])
    heads = materialize(heads.select("doc", "n_shingles", "sketch", "keys", F.monotonically_increasing_id().alias("n")), "heads")

    bits, unlike = segments * BITS, (1 - threshold) / 2
    differ = reduce(add, (F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(-(-bits // 64))))
    near = F.lit(True) if sketch_sigmas is None else (F.least("size_a", "size_b") < SHORT) | (differ <= bits * unlike + sketch_sigmas * (bits * unlike * (1 - unlike)) ** 0.5)
    sized = F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b")
    side = {x: heads.select(F.col("n").alias(x), F.col("doc").alias(f"doc_{x}"), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"size_{x}")) for x in "ab"}

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        close = pairs.join(side["a"], "a").join(side["b"], "b").where(near & sized).select("a", "b", "doc_a", "doc_b")
        close = materialize(close, f"{name}_candidates")
        wanted = stacked(close.select(F.col("doc_a").alias("doc")), close.select(F.col("doc_b").alias("doc"))).select(F.xxhash64("doc").alias("h")).distinct()
        # the texts that are to be compared are picked where they are read while their ids are few enough to be broadcast
        h = F.xxhash64("doc")
        few = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
        needed = texts.join(F.broadcast(wanted), h == F.col("h"), "left_semi") if few else texts
        # a document given twice is verified twice; the links are made distinct
        with_a = close.join(needed.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a")), "doc_a")
        both = with_a.join(needed.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(pdf), 1000):
                    p = pdf.iloc[lo : lo + 1000]
                    sets = _shingle_sets(pd.concat([p["doc_a"], p["doc_b"]]), pd.concat([p["text_a"], p["text_b"]]), shingle)
                    yield pd.DataFrame({"a": p["a"], "b": p["b"], "similarity": [_jaccard(sets[x], sets[y]) for x, y in zip(p["doc_a"], p["doc_b"])]})

        measured = both.select("a", "b", "doc_a", "doc_b", "text_a", "text_b").mapInPandas(measure, "a long, b long, similarity double")
        return materialize(measured.where(F.col("similarity") >= threshold).groupBy("a", "b").agg(F.max("similarity").alias("similarity")), name)

    # buckets of one member, which nearly all are, end here; counts are combined before the shuffle, and a bucket that a
    # large group shares is split by the join, whose other side has one row for it
    entries = heads.select(F.explode("keys").alias("key"), "n")
    lowest = entries.groupBy("key").agg(F.min("n").alias("o"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(entries.join(lowest, "key"), "buckets")
    if all_links:
        far = heads.select("n", "sketch", F.col("n_shingles").alias("size_n"))
        salted = shared.join(far, "n").withColumn("salts", F.ceil(F.col("size") / salt_rows).cast("int"))
        one = salted.select("key", F.pmod(F.xxhash64("n"), "salts").cast("int").alias("salt"), F.col("n").alias("a"), F.col("sketch").alias("sketch_a"), F.col("size_n").alias("size_a"))
        every = salted.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("n").alias("b"), F.col("sketch").alias("sketch_b"), F.col("size_n").alias("size_b"))
        links = verified(one.join(every, ["key", "salt"]).where("a < b").where(near & sized).select("a", "b").distinct(), "all_links")
    else:
        star = shared.where("n > o").select(F.col("o").alias("a"), F.col("n").alias("b")).distinct()
        first = verified(star, "star_links")
        # buckets of more than two members can hold links between groups that the star did not try: all members outside the
        # bucket's largest group are paired with every member of another group, so a large group is not paired with itself
        placed = shared.where("size > 2").join(connect(first), F.col("n") == F.col("id"), "left").select("key", "n", F.coalesce("component", "n").alias("g"))
        largest = placed.groupBy("key", "g").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "g")).alias("m"), F.count("*").alias("groups"))
        outside = placed.join(largest.where("groups > 1"), "key").where(F.col("g") != F.col("m.g")).select("key", "n", "g")
        other = placed.select("key", F.col("n").alias("m"), F.col("g").alias("g_m"))
        rest = outside.join(other, "key").where("g <> g_m").select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b")).distinct()
        second = verified(rest.join(star, ["a", "b"], "left_anti"), "links")
        links = stacked(first, second)
    groups = connect(links)
    names = heads.select(F.col("n").alias("id"), F.col("doc").alias("class_id"))
    by_number = names.join(groups, "id").select("class_id", "component")
    smallest = by_number.groupBy("component").agg(F.min("class_id").alias("group_id"))
    of_class = by_number.join(smallest, "component").select("class_id", "group_id")
    members = classes.join(of_class, "class_id", "left").select("doc", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))
    end = {side: heads.select(F.col("n").alias(side), F.col("doc").alias(f"doc_{side}")) for side in "ab"}
    named = links.join(end["a"], "a").join(end["b"], "b")
    return members, named.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"), "similarity")
