"""Passages of test items inside a corpus, by winnowing.

Both sides are cut into words; of every WINDOW successive hashes of K words the smallest is kept (the
rightmost of equals). Two texts that share WINDOW + K - 1 words in a row keep at least one hash in
common. Hits are joined, then extended word by word to both sides; a pair counts if an extended hit is
long enough.

The corpus is read once and never shuffled: a bit map of the items' fingerprints, of at most 16 MB whatever their
number, goes to every task, which drops the corpus fingerprints that it lacks. Only texts with one that it has
leave the task, as 64-bit hashes of their words, which the extension compares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.operators.joins import spread_join
from arrayloom.session import tree_fan, write_through

K = 5
#: The map has about this many bits for each of the items' fingerprints, so one in as many others passes it, but never more
#: than 2 ** MOST_BITS bits.
BITS_EACH = 64
MOST_BITS = 27
#: The entities that are decoded.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


def words_of(text: str) -> list[str]:
    """Words of a text: tags become blanks, entities are decoded once, NFKC, lower case; maximal runs of
    letters or digits."""
    import re
    import unicodedata

    text = re.sub(r"<[^<>\n\r]*>", " ", text)
    text = re.sub(r"\[[^\[\]\n\r]*\]", " ", text)
    text = re.sub("|".join(ENTITIES), lambda m: ENTITIES[m[0]], text)
    text = unicodedata.normalize("NFKC", text).replace("\u200b", "").replace("\u00ad", "").lower()
    return re.findall(r"[^\W_]+", text)


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    import xxhash

    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def winnow(hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints) of a sequence of word hashes."""
    n = len(hashes) - k + 1
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x100000001B3) + hashes[j : j + n]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    places = np.unique(np.arange(n - window + 1) + window - 1 - views.argmin(axis=1))
    return places, grams[places]


def _places(marks: np.ndarray, size: int) -> np.ndarray:
    """Places of fingerprints in a bit map of a power of two bytes."""
    return (marks >> np.uint64(61 - size.bit_length() + 1)).astype(np.int64)


def _hashed(k: int, window: int, bits=None) -> Callable:
    """Rows (key, words, places, marks) of texts: word hashes and fingerprints. With the bit map `bits`, only the
    fingerprints in it, and only texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        there = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if len(known) > 1_000_000:
                    known.clear()
                words = _hashes(words_of(text), known)
                at, found = winnow(words, k, window)
                if there is not None:
                    slot = _places(found, len(there))
                    hit = there[slot >> 3] >> (slot & 7) & 1 == 1
                    at, found = at[hit], found[hit]
                if len(at):
                    rows.append(i)
                    out.append((words.view(np.int64), at.astype(np.int32), found.view(np.int64)))
            lists = [pa.array([o[c] for o in out], pa.list_(t)) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *lists], names=["key", "words", "places", "marks"])

    return run


def hashed_texts(df: DataFrame, key: str, text: str, k: int, window: int, bits=None) -> DataFrame:
    """(row, key, words, marks): a number, the word hashes and the winnowed fingerprints (mark, place) of each text that has
    any; null keys and texts have none. Written, as the numbers must not change."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("key IS NOT NULL AND text IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(_hashed(k, window, bits), f"key {kind}, words array<bigint>, places array<int>, marks array<bigint>")
    marks = F.arrays_zip(F.col("marks").alias("mark"), F.col("places").alias("place"))
    return write_through(out.select(F.monotonically_increasing_id().alias("row"), "key", "words", marks.alias("marks")))


def bit_map(items: DataFrame) -> bytes:
    """The bit map of the fingerprints of hashed texts: maps of the tasks, put together in two steps."""
    number = items.agg(F.coalesce(F.sum(F.size("marks")), F.lit(0))).first()[0]
    size = 1 << min(MOST_BITS, max(16, (number * BITS_EACH).bit_length())) - 3

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        there = np.zeros(size, np.uint8)
        for batch in batches:
            slot = _places(batch.column(0).to_numpy().view(np.uint64), size)
            np.bitwise_or.at(there, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "bits": [there.tobytes()]})

    def unite(maps: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(m.as_buffer(), np.uint8) for m in maps.column("bits")])
        return pa.table({"part": pa.array([0], pa.int32()), "bits": [both.tobytes()]})

    maps = items.select(F.explode("marks.mark").alias("mark")).mapInArrow(fill, "part int, bits binary")
    some = maps.withColumn("part", F.pmod("part", F.lit(tree_fan(items.sparkSession)))).groupBy("part").applyInArrow(unite, "part int, bits binary")
    found = some.groupBy("part").applyInArrow(unite, "part int, bits binary").first()  # one row of at most 16 MB
    return bytes(found.bits) if found else bytes(size)


def _extend(least: int) -> Callable:
    def longest(a: np.ndarray, b: np.ndarray, hits: list[tuple[int, int]]) -> int:
        best, done = 0, {}
        for x, y in hits:
            if done.get(x - y, -1) > x:  # inside a span that is known
                continue
            n = min(x, y)
            differs = np.flatnonzero(a[x - n : x] != b[y - n : y])
            i = n - 1 - differs[-1] if len(differs) else n
            n = min(len(a) - x, len(b) - y)
            differs = np.flatnonzero(a[x : x + n] != b[y : y + n])
            j = differs[0] if len(differs) else n
            done[x - y] = x + j
            best = max(best, int(i + j) if j else 0)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            words = [batch.column(c) for c in ("doc_words", "item_words")]
            for i, hits in enumerate(batch.column("hits").to_pylist()):
                a, b = (w[i].values.to_numpy() for w in words)
                found.append(longest(a, b, sorted((h["x"], h["y"]) for h in hits)))
            out = pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("item"), pa.array(found, pa.int32())], names=["doc", "item", "longest"])
            yield out.filter(pa.compute.greater_equal(out.column("longest"), least))

    return run


def leaks(corpus: DataFrame, doc: str, items: DataFrame, item: str, text: str = "text", least: int = 12, k: int = K) -> DataFrame:
    """(doc, item, longest): texts of the corpus that hold at least `least` successive words of an item, with
    the length of the longest such run that a fingerprint hit. No such pair is missed.

    Null keys and null texts take no part, texts of fewer than `least` words have no such run. Repeated
    rows of a key give one row; a key with several texts counts if any of them holds a run. Both tables
    need the column `text`; other columns are ignored. Words are compared by 64-bit hashes. Hits are grouped by
    pair of texts, so their number is bounded by the fingerprints of the two. Runs jobs while it is called.
    """
    window = least - k + 1
    known = hashed_texts(items, item, text, k, window)
    bits = corpus.sparkSession.sparkContext.broadcast(bit_map(known))
    there = hashed_texts(corpus, doc, text, k, window, bits)
    seen = known.select(F.col("row").alias("item_row"), F.explode("marks").alias("m")).select("item_row", F.col("m.place").alias("y"), "m.mark")
    marks = there.select("row", F.explode("marks").alias("m")).select("row", F.col("m.place").alias("x"), "m.mark")
    hits = spread_join(marks, seen, ["mark"], "row").groupBy("row", "item_row").agg(F.collect_set(F.struct("x", "y")).alias("hits"))
    a = there.select("row", F.col("key").alias("doc"), F.col("words").alias("doc_words"))
    b = known.select(F.col("row").alias("item_row"), F.col("key").alias("item"), F.col("words").alias("item_words"))
    both = spread_join(hits.join(a, "row"), b, ["item_row"], "row").select("doc", "item", "doc_words", "item_words", "hits")
    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in ("doc", "item"))
    found = both.mapInArrow(_extend(least), f"{kinds}, longest int")
    return found.groupBy(F.col("doc").alias(doc), F.col("item").alias(item)).agg(F.max("longest").alias("longest"))
