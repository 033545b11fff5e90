"""Evaluation texts leaking into training text.

Words are canonicalised (compatibility forms, letter case, invisible characters, punctuation) and typed:
numbers, units and names become placeholders, every other word stays. Windows of ``WINDOW`` typed
words are hashed and the windows of documents meet those of the evaluation items by a join on the hash. Each hit
is then settled by its slots: where all slots hold the same words the passage leaked as it is; where they
differ, but each item word is always replaced by the same document word, the item leaked re-parameterised;
anything else is a chance resemblance.

A word that occurs in an item is typed alike wherever it occurs, so two equal passages always have equal
templates: the hash join loses no verbatim leak, whatever its letter case or spacing. What a name is, all items decide
together: a word that they write with a capital within a sentence and never small, in a text that does not
capitalise as a rule (titles, German nouns).

Every window of every whole document is looked up. A bit map of the items' window hashes, of one size
whatever the items' number, goes to the executors and holds back windows that no item can have; the rest are joined.
The items' vocabulary (9 bytes a distinct word) goes along, after its size is counted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumencase.functions.arrow import sliced
from lumencase.staging import cut, small_enough

#: Consecutive words that make a leak; bits of the map of window hashes (2 MB); distinct words of the items at most.
WINDOW, MAP_BITS, VOCABULARY = 12, 24, 20_000_000
#: A text of which a larger share of words is capitalised within sentences tells nothing of names.
CAPITALISES = 0.25
#: Soft hyphen, zero-width space, joiners, word joiner, byte-order mark, direction marks.
INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x200E, 0x200F, 0x180E])
#: Units of measure as whole words: a default, every function takes others.
UNITS = frozenset("mm cm m km metre metres meter meters kilometre kilometres kilometer kilometers millimetre millimetres inch inches foot feet mile miles g kg gram grams kilogram kilograms ton tons second seconds minute minutes hour hours day days week weeks month months year years byte bytes kilobyte kilobytes megabyte megabytes gigabyte gigabytes kb mb gb tb hz khz mhz percent euro euros dollar dollars pound pounds crown crowns degree degrees".split())
NUMBER, UNIT, NAME = "\x01n", "\x01u", "\x01p"
_TOKEN = re.compile(r"[^\W_]+|[.!?:;\n\r]")
_ENDS = frozenset(".!?:;\n\r")


def _hash(text: str) -> int:
    """A 64-bit number for a word, the same in every process."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def tokens_of(text: str) -> list[str]:
    """The words of a text as they are written, and its sentence ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(INVISIBLE))
    return _TOKEN.findall(text)


def folded(word: str) -> str:
    return unicodedata.normalize("NFKC", word.casefold())


def _like_a_name(word: str) -> bool:
    return word[0].isupper() and not word.isupper()


class _Words(dict):
    """Written word -> its number in the arrays ``words``, ``inner`` and ``begin`` (template hashes within and at the beginning of a sentence)."""

    def __init__(self, names: np.ndarray, known: np.ndarray, units: frozenset[str]):
        self.names, self.known, self.units = names, known, units
        self.words, self.inner, self.begin = [""], [0], [0]
        self._arrays = (np.zeros(1, np.uint64), np.zeros(1, np.uint64))
        self.slots = {_hash(x) for x in (NUMBER, UNIT, NAME)}
        for end in _ENDS:
            self[end] = 0

    def _has(self, table: np.ndarray, h: int) -> bool:
        at = int(np.searchsorted(table, np.uint64(h)))
        return at < len(table) and int(table[at]) == h

    def __missing__(self, written: str) -> int:
        word = folded(written)
        h = _hash(word)
        if any(map(str.isdigit, word)):
            inner = begin = _hash(NUMBER)
        elif word in self.units:
            inner = begin = _hash(UNIT)
        elif self._has(self.names, h):
            inner = begin = _hash(NAME)
        else:
            inner = begin = h
            if _like_a_name(written) and not self._has(self.known, h):
                inner = _hash(NAME)
        self.words.append(word), self.inner.append(inner), self.begin.append(begin)
        self[written] = n = len(self.words) - 1
        return n

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of the text's words, their template hashes)."""
        seen = np.array([self[t] for t in tokens_of(text)], dtype=np.int64)
        if len(self.inner) != len(self._arrays[0]):
            old = len(self._arrays[0])
            grown = [np.concatenate([a, np.array(x[old:], dtype=np.uint64)]) for a, x in zip(self._arrays, (self.inner, self.begin), strict=True)]
            self._arrays = (grown[0], grown[1])
        inner, begin = self._arrays
        is_word = seen > 0
        after_end = np.concatenate([[True], ~is_word[:-1]])[: len(seen)]
        numbers = seen[is_word]
        return numbers, np.where(after_end[is_word], begin[numbers], inner[numbers])


def _windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit number for each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
            out ^= out >> np.uint64(29)
    return out


def _vocabulary(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words that are names, of all words) of the items, sorted."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words: dict[int, list[bool]] = {}
            for text in batch.column(1).to_pylist():
                tokens = tokens_of(text)
                named = [t not in _ENDS and i > 0 and tokens[i - 1] not in _ENDS and _like_a_name(t) for i, t in enumerate(tokens)]
                capitalises = sum(named) > CAPITALISES * sum(t not in _ENDS for t in tokens)
                for t, n in zip(tokens, named, strict=True):
                    if t not in _ENDS:
                        one = words.setdefault(_hash(folded(t)), [False, False])
                        if not capitalises:
                            one[0] |= n
                        if capitalises or not _like_a_name(t):
                            one[1] = True
            yield pa.record_batch([pa.array(np.array(list(words), dtype=np.uint64).view(np.int64)), pa.array([a for a, _ in words.values()], pa.bool_()), pa.array([b for _, b in words.values()], pa.bool_())], ["word", "named", "plain"])

    told = items.mapInArrow(read, "word long, named boolean, plain boolean").groupBy("word").agg((F.bool_or("named") & ~F.bool_or("plain")).alias("name"))
    table = told.limit(VOCABULARY + 1).toArrow()
    if table.num_rows > VOCABULARY:
        raise ValueError(f"the items have more than {VOCABULARY} distinct words: give them in several calls")
    words, name = table["word"].to_numpy().view(np.uint64), table["name"].to_numpy()
    return np.sort(words[name]), np.sort(words)


def _finder(vocabulary, units: frozenset[str], window: int, bits=None):
    """Reads (id, text) into rows id, at, hash, words, slots of each window, or of those whose hash the bit map has."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words(*vocabulary.value, units)
        there = None if bits is None else np.unpackbits(bits.value, bitorder="little").view(bool)
        for batch in sliced(batches, 200):
            ids, ats, hashes, words, slots = [], [], [], [], []
            for id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(memo) > 500_000:
                    memo = _Words(*vocabulary.value, units)
                numbers, template = memo.read(text)
                own = _windows(template, window)
                at = np.arange(len(own)) if there is None else np.flatnonzero(there[(own & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)])
                for i in at.tolist():
                    ids.append(id), ats.append(i), hashes.append(int(own[i].view(np.int64)))
                    words.append([memo.words[n] for n in numbers[i : i + window].tolist()])
                    slots.append([t in memo.slots for t in template[i : i + window].tolist()])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(hashes, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(slots, pa.list_(pa.bool_()))], ["id", "at", "hash", "words", "slots"])

    return find


_FOUND = "id long, at int, hash long, words array<string>, slots array<boolean>"


def window_hits(documents: DataFrame, items: DataFrame, window: int = WINDOW, units: frozenset[str] = UNITS) -> DataFrame:
    """doc_id, item_id, doc_at, item_at, slots, swaps, kind: one row per window of a document whose template an item has.

    kind is 'verbatim' if all words agree, 're-parameterised' if only slots differ, no more than half of the window are slots and they
    differ consistently, else 'resemblance'; slots is their number, swaps the item's word and the document's in each. Null
    and short texts have no windows; a repeated row gives its hits again; two texts under one item_id are both looked for.
    """
    spark = documents.sparkSession
    texts = lambda df, id: df.select(F.col(id).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    item_rows = texts(items, "item_id").distinct()
    vocabulary = spark.sparkContext.broadcast(_vocabulary(item_rows))
    theirs = cut(item_rows.mapInArrow(_finder(vocabulary, units, window), _FOUND))
    # at most 2 ** MAP_BITS numbers, whatever the items
    places = theirs.select(F.expr(f"cast(hash & {(1 << MAP_BITS) - 1} as int) as place")).distinct().toArrow()["place"].to_numpy()
    bits = np.zeros(1 << MAP_BITS, dtype=bool)
    bits[places] = True
    bits = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
    ours = texts(documents, "doc_id").mapInArrow(_finder(vocabulary, units, window, bits), _FOUND)
    n = theirs.count()
    right = theirs.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "hash", F.col("words").alias("their_words"))
    met = ours.select(F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), "hash", "words", "slots").join(F.broadcast(right) if small_enough(n, 40 + 24 * window) else right, "hash")
    met = met.withColumn("w", F.arrays_zip(F.col("their_words").alias("a"), F.col("words").alias("b"), F.col("slots").alias("s")))
    met = met.withColumn("swaps", F.expr("array_distinct(transform(filter(w, x -> x.s), x -> struct(x.a as a, x.b as b)))")).withColumn("slots", F.expr("size(filter(w, x -> x.s))"))
    fixed = F.expr("not exists(w, x -> not x.s and x.a != x.b)")  # else a collision of hashes
    bijective = F.expr("size(swaps) = size(array_distinct(swaps.a)) and size(swaps) = size(array_distinct(swaps.b))")
    kind = F.when(F.col("words") == F.col("their_words"), "verbatim").when(fixed & bijective & (2 * F.col("slots") <= window), "re-parameterised").otherwise("resemblance")
    return met.select("doc_id", "item_id", "doc_at", "item_at", "slots", "swaps", kind.alias("kind"))


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id of every document that holds ``window`` consecutive words of an item."""
    return window_hits(documents, items, window).where("kind = 'verbatim'").select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, kind, windows, first_word, last_word: every leak with its kind and the part of the item it covers.

    A re-parameterised leak must replace words consistently over the whole stretch of windows that stand at
    the same offset, not in each alone.
    """
    hits = window_hits(documents, items, window).where("kind != 'resemblance'")
    runs = hits.groupBy("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("offset")).agg(
        F.bool_or(F.col("kind") == "verbatim").alias("verbatim"), F.collect_set("item_at").alias("ats"), F.array_distinct(F.flatten(F.collect_set("swaps"))).alias("swaps")
    )  # no more windows than the item has
    runs = runs.where(F.col("verbatim") | F.expr("size(swaps) = size(array_distinct(swaps.a)) and size(swaps) = size(array_distinct(swaps.b))"))
    return runs.groupBy("doc_id", "item_id").agg(
        F.when(F.bool_or("verbatim"), "verbatim").otherwise("re-parameterised").alias("kind"),
        F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("windows"), F.min(F.array_min("ats")).alias("first_word"), (F.max(F.array_max("ats")) + window - 1).alias("last_word"),
    )


def item_report(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, documents_verbatim, documents_reparameterised of every item, leaked or not."""
    per = leak_report(documents, items, window).groupBy("item_id").agg(F.count_if(F.col("kind") == "verbatim").alias("v"), F.count_if(F.col("kind") != "verbatim").alias("r"))
    return items.select(F.col("item_id").cast("long").alias("item_id")).where("item_id is not null").distinct().join(per, "item_id", "left").select(
        "item_id", F.coalesce("v", F.lit(0)).alias("documents_verbatim"), F.coalesce("r", F.lit(0)).alias("documents_reparameterised")
    )
