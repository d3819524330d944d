"""Tables of keywords, found in one pass over each text, by an Aho-Corasick automaton or through a bit map.

The keywords are counted first.  Up to ``max_chars`` characters they make one automaton, which is sent to the tasks.
Beyond that a bit map of bounded size is sent instead, which holds the hashes of the keywords and of their leads.  A place of
a text is looked up by its leads, then by the lengths that keywords with such leads have; what passes is cut out, once per text
with its first place and its number, and meets the keywords by equality.  The map only saves work: what it lets through by chance
meets no keyword.  Keywords too many for one map are dealt into groups by their hashes, each with a map of its own, and the texts
are read once for each group; else a full map would let through most places of all texts.  No text is copied or shuffled, and nothing
is compared with all keywords.  Texts and keywords are lowered by Spark, which is what the SQL form compares.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from palisade.functions.shared import written
from palisade.functions.text import strip

#: Lengths of leads: a keyword's is the longest that it has.
LEADS = (32, 16, 12, 8, 6, 5, 4, 3, 2, 1)
#: Places of a bit map as powers of two: 32 for each keyword, within these bounds (1 and 64 MB).
MAP_BITS = 23, 29
#: Least places of a map for each of its keywords; with fewer, keywords are dealt into more groups.
LEAST_PLACES = 8
#: Characters hashed and rows put out at once.
PIECE, ROWS = 500_000, 50_000


class _Matcher:
    """The automaton over distinct lowered strings, built once in each Python worker that they are sent to."""

    def __init__(self, words: list[str], names: list[list[str]]):
        self.words, self.names, self.automaton = words, names, None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def hits(self, text: str):
        """(last place, number of the word) of every occurrence, overlapping ones included."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, word in enumerate(self.words):
                self.automaton.add_word(word, k)
            self.automaton.make_automaton()
        return self.automaton.iter(text) if self.words else ()


def _finder(search):
    """Per row what ``search`` finds in its text: names, first place and number of places.

    Rows are their keys as one struct and the lowered text.
    """
    def record(batch, rows, out):
        columns = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, (
                pa.string(), pa.int32(), pa.int64()))]], ["key", "name", "start", "n"])

    def find(batches):
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                for hit in search(text) if text else ():
                    rows.append(row)
                    out.append(hit)
                    if len(rows) >= ROWS:
                        yield record(batch, rows, out)
                        rows, out = [], []
            yield record(batch, rows, out)
    return find


def _by_automaton(shared):
    def search(text):
        words, names, found = shared.value.words, shared.value.names, {}
        for end, k in shared.value.hits(text):
            first, n = found.get(k, (end - len(words[k]) + 1, 0))
            found[k] = first, n + 1
        for k, (start, n) in found.items():
            for name in names[k]:
                yield name, start, n
    return search


class _Hashes:
    """Hashes of all stretches of a text by sums of its characters times powers of an odd number, modulo 2**64."""

    ODD = 0x9E3779B97F4A7C15

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        codes ^= codes >> np.uint64(29)
        self.size = len(codes)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(codes * self._powers(self.ODD, self.size), out=self.sums[1:])
        self.back = self._powers(pow(self.ODD, -1, 2**64), self.size)

    @staticmethod
    def _powers(base: int, n: int):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def stretches(self, at, length: int, whole: bool):
        """Hashes of the stretches of ``length`` from the places ``at`` (an array or a slice)."""
        behind = slice(at.start + length, at.stop + length) if isinstance(at, slice) else at + length
        h = (self.sums[behind] - self.sums[at]) * self.back[at]
        h = (h ^ (h >> np.uint64(32))) + np.uint64(2 * length + whole)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _group(hashes, groups: int):
    return (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(groups)


def _slots(hashes, bits: int):
    """Two places in a bit map for each hash."""
    again = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes >> np.uint64(64 - bits), again >> np.uint64(64 - bits)


def _lead(length: int) -> int:
    return next(q for q in LEADS if q <= length)


def _word_slots(bits: int, groups: int):
    """Places of keywords, those of a group behind those of the groups before it: two of all of it and, if it is longer than that, of its lead."""
    def slots(batches):
        for batch in batches:
            # Keywords stand one behind another, so that numpy hashes a part of the batch at once.
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                words = part.column(0).to_pylist()
                sizes = np.array([len(w) for w in words])
                first, hashes, out = np.cumsum(sizes) - sizes, _Hashes("".join(words)), []
                for length in np.unique(sizes).tolist():
                    at, lead = first[sizes == length], _lead(length)
                    whole = hashes.stretches(at, length, True)
                    own = _group(whole, groups) << np.uint64(bits)
                    held = [whole] if lead == length else [whole, hashes.stretches(at, lead, False)]
                    out += [own + slot for h in held for slot in _slots(h, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).astype(np.int64))], ["slot"])
    return slots


def _bit_maps(words: DataFrame, bits: int, groups: int):
    """For each group a bit map of 2**bits places, put together in chunks."""
    slots = words.select("low").mapInArrow(_word_slots(bits, groups), "slot long").select(
        F.bitmap_bucket_number(F.col("slot") + 1).alias("chunk"), F.bitmap_bit_position(F.col("slot") + 1).cast("int").alias("place"))
    # Dealt before they are put together: a task of many keywords would else sort all of theirs beside its Python worker.
    chunks = written(slots.repartition(F.col("chunk")).groupBy("chunk").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits")), "bit-maps")
    size = 2**bits // 8
    for group in range(groups):
        out, first = np.zeros(size, np.uint8), group * size // 4096 + 1
        for row in chunks.where(F.col("chunk").between(first, first + size // 4096 - 1)).toLocalIterator():
            at = (row["chunk"] - first) * 4096
            out[at:at + 4096] = np.frombuffer(row["bits"], np.uint8)
        yield out


def _by_map(shared, bits: int, lengths: list[int], group: int = 0, groups: int = 1):
    by_lead = {}
    for n in lengths:
        by_lead.setdefault(_lead(n), []).append(n)

    def passing(held, hashes, at, length, whole):
        """Those of the places ``at`` from which a stretch may be a keyword of the group, or a keyword's lead."""
        found = hashes.stretches(at, length, whole)
        if isinstance(at, slice):
            at = np.arange(at.start, at.stop)
        if whole and groups > 1:
            own = _group(found, groups) == group
            at, found = at[own], found[own]
        for k in range(2):
            slot = _slots(found, bits)[k]
            ok = ((held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1) > 0
            at, found = at[ok], found[ok]
        return at

    def search(text):
        held, found = shared.value, {}
        for begin in range(0, len(text), PIECE):
            hashes = _Hashes(text[begin:begin + PIECE + lengths[-1] - 1])
            for lead, own in by_lead.items():
                count = min(PIECE, hashes.size - lead + 1)
                if count <= 0:
                    continue
                places = passing(held, hashes, slice(0, count), lead, False) if own != [lead] else None
                for n in own:
                    # A keyword that is its own lead is looked up once.
                    at = passing(held, hashes, slice(0, count) if n == lead else places[places <= hashes.size - n], n, True)
                    for start in (at + begin).tolist():
                        stretch = text[start:start + n]
                        first, times = found.get(stretch, (start, 0))
                        found[stretch] = first, times + 1
        for stretch, (start, times) in found.items():
            yield stretch, start, times
    return search


def find_keywords(pages: DataFrame, keywords: DataFrame, text: str = "text", keys=("doc_id", "page_num"),
                  max_chars: int = 1_000_000) -> DataFrame:
    """(keys, keyword, start, n) for every keyword of the table (column ``keyword``) that a page holds, whatever their case.

    ``start`` is the first place in the lowered text, ``n`` the number of places, overlapping ones included.  Blank and null
    keywords are passed over, a repeated one counts once, keywords that differ in case alone are all found.  A null or empty
    text holds none.  ``max_chars`` bounds what is collected and sent; it changes no result.  ``keywords`` is read three times, so it
    must give the same rows each time.
    """
    spark = pages.sparkSession
    words = keywords.select("keyword").where(F.length(strip(F.col("keyword"))) > 0).withColumn("low", F.lower("keyword"))
    count, lengths = words.agg(F.approx_count_distinct("low"), F.collect_set(F.length("low"))).first()
    lowered = pages.select(*keys, F.lower(F.col(text)).alias("text"))
    fields = ", ".join(f"`{k}`: {pages.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"key struct<{fields}>, name string, start int, n bigint"
    if count * max(lengths, default=0) <= max_chars:
        sent = words.groupBy("low").agg(F.collect_set("keyword").alias("names")).select("low", "names").toArrow()
        search = _by_automaton(spark.sparkContext.broadcast(_Matcher(*[c.to_pylist() for c in sent.columns])))
        return lowered.select(F.struct(*keys).alias("key"), "text").mapInArrow(_finder(search), schema).select(
            "key.*", F.col("name").alias("keyword"), "start", "n")
    bits = min(max((32 * count).bit_length(), MAP_BITS[0]), MAP_BITS[1])
    groups = max(1, -(-LEAST_PLACES * count // 2**bits))
    searches = [_by_map(spark.sparkContext.broadcast(held), bits, sorted(lengths), group, groups)
                for group, held in enumerate(_bit_maps(words, bits, groups))]
    found = reduce(DataFrame.unionByName, [
        lowered.select(F.struct(*keys).alias("key"), "text").mapInArrow(_finder(search), schema).select(
            "key.*", F.col("name").alias("_low"), "start", "n") for search in searches])
    # One shuffle of the keywords, by what they are joined on; copies go there too.
    names = words.repartition(F.col("low")).distinct()
    return found.join(names, F.col("_low") == F.col("low")).select(*keys, "keyword", "start", "n")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
