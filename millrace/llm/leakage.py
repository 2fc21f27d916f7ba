"""Evaluation texts inside a training corpus, by a distributed positional inverted index.

The index holds, per term and document, the list of word positions. Of every window of `run` words of a test item the two
rarest terms are looked up, rarest first: the list of the first gives (document, shift) pairs, that of the second is
intersected with it at its offset. What is left is compared word by word. A common phrase of at least `run` words contains a
whole window at one shift, so nothing can be missed; common terms are looked up only where a window has no rarer ones, and
lists that no window asks for are not kept.
The index is partitioned by document, one shard per Arrow batch: lists are intersected in the task that built them, so that
neither postings nor texts are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import small_rows

#: Items that one pass over the documents looks for; more are taken up in passes of about so many.
MOST_ITEMS = 50_000
#: Characters that are taken out before words are cut (fixed values).
INVISIBLE = "​‍﻿"


#: Text that is cut and indexed at once.
SLICE_BYTES = 16 << 20
_WORD = re.compile(r"[^\W_]+")


def _lower(text: str) -> str:
    low = text.lower()
    if not low.isascii():
        for c in INVISIBLE:
            low = low.replace(c, "")
    return low


def words_of(text: str) -> list[str]:
    """The runs of letters and digits of the lower-cased text."""
    return _WORD.findall(_lower(text))


class Shard:
    """The words of some texts as numbers, cut by the same rule as `words_of` for all of them at once."""

    def __init__(self, texts: list[str]):
        parts = pc.split_pattern_regex(pa.array([_lower(t) for t in texts], pa.large_string()), r"[^\pL\pN]+")
        flat, row = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
        some = pc.not_equal(flat, "")
        d = flat.filter(some).dictionary_encode()
        self.code, self.words = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()
        self.row = row[some.to_numpy(zero_copy_only=False)].astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=len(texts)))])

    def of(self, row: int) -> list[str]:
        return [self.words[c] for c in self.code[self.start[row] : self.start[row + 1]].tolist()]

    def places(self, terms: set[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, row, position) of the given terms, or all, in order of rows and positions."""
        wanted = np.array([terms is None or w in terms for w in self.words], bool)
        at = np.flatnonzero(wanted[self.code]) if len(self.words) else np.zeros(0, np.int64)
        return self.code[at], self.row[at], at - self.start[self.row[at]]

    def postings(self, terms: set[str] | None) -> dict[str, dict[int, list[int]]]:
        """{term: {row: positions}}."""
        code, row, position = self.places(terms)
        order = np.lexsort((position, row, code))
        code, row, position = code[order], row[order], position[order].tolist()
        cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(row) != 0)) + 1).tolist(), len(position)]
        out: dict[str, dict[int, list[int]]] = {}
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                out.setdefault(self.words[code[i]], {})[int(row[i])] = position[i:j]
        return out


def _shards(b: pa.RecordBatch):
    """(documents, shard) of a batch, in shares of about `SLICE_BYTES` of text."""
    size = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
    for a, z in zip(cuts, cuts[1:]):
        if z > a:
            yield b.column("doc_id")[a:z].to_pylist(), Shard(b.column("text")[a:z].to_pylist())


def postings(docs: DataFrame, terms: set[str] | None = None) -> DataFrame:
    """(term, doc_id, positions) for docs (doc_id, text), all terms or those given."""

    def build(batches):
        for b in batches:
            for ids, shard in _shards(b):
                lists = [(t, ids[row], at) for t, rows in shard.postings(terms).items() for row, at in rows.items()]
                cols = list(zip(*lists)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], names=["term", "doc_id", "positions"])

    return docs.mapInArrow(build, "term string, doc_id bigint, positions array<int>")


def document_frequencies(docs: DataFrame, terms: set[str]) -> dict[str, int]:
    """In how many documents each term occurs; over all documents, counted on the map side first."""

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for _, shard in _shards(b):
                code, row, _ = shard.places(terms)
                once = pc.unique(pa.array(row * max(1, len(shard.words)) + code)).to_numpy() % max(1, len(shard.words))
                n = np.bincount(once, minlength=len(shard.words))
                c.update({shard.words[k]: int(n[k]) for k in np.flatnonzero(n)})
        yield pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], names=["term", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in small_rows(rows, "the items' vocabulary", 5_000_000)}


def _probes(items: dict[int, list[str]], df: dict[str, int], run: int) -> list[tuple]:
    out = set()
    for item, ws in items.items():
        for i in range(len(ws) - run + 1):
            if min(df.get(w, 0) for w in ws[i : i + run]) == 0:
                continue  # some word of the window is nowhere in the corpus
            order = sorted(range(i, i + run), key=lambda j: (df[ws[j]], ws[j], j))
            a, b = order[0], order[1 % run]
            out.add((item, ws[a], a, ws[b], b))
    return sorted(out)


def _runs(item: list[str], doc: list[str], shift: int, run: int) -> list[tuple[int, int]]:
    """(first word of the item, length) of the maximal equal stretches of at least `run` words at one shift."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    out, start = [], None
    for k in range(lo, hi + 1):
        same = k < hi and item[k] == doc[k + shift]
        if same and start is None:
            start = k
        if not same and start is not None:
            if k - start >= run:
                out.append((start, k - start))
            start = None
    return out


def _passes(items: DataFrame, most: int) -> list[DataFrame]:
    """The items in shares of about half of `most`, by a digest of their id."""
    n = items.count()
    parts = 1 if n <= most else -(-2 * n // most)
    return [items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) for k in range(parts)]


def _items(items: DataFrame) -> dict[int, list[str]]:
    by_id: dict[int, list[str]] = {}
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").collect():
        by_id[r.item_id] = max(by_id.get(r.item_id, []), words_of(r.text), key=lambda w: (len(w), w))
    return by_id


def leaked_phrases(docs: DataFrame, items: DataFrame, run: int = 20, most_items: int = MOST_ITEMS) -> DataFrame:
    """(item_id, doc_id, item_word, doc_word, n_words): every maximal common phrase of at least `run` words.

    docs (doc_id bigint, text), items (item_id int, text). Null and blank texts and items of fewer than `run` words have no
    phrases; equal documents each get their rows; repeated items under one id are joined by their longest text. An empty
    table gives no rows.
    """
    return reduce(DataFrame.unionByName, [_phrases(docs, part, run) for part in _passes(items, most_items)])


def _phrases(docs: DataFrame, items: DataFrame, run: int) -> DataFrame:
    spark = docs.sparkSession
    by_id = _items(items)
    texts = docs.where("text is not null").select("doc_id", "text")
    df = document_frequencies(texts, {w for ws in by_id.values() for w in ws})
    probes = _probes(by_id, df, run)
    empty = spark.createDataFrame([], "item_id int, doc_id bigint, item_word int, doc_word int, n_words int")
    if not probes:
        return empty
    by_first: dict[str, list[tuple]] = {}
    for item, t1, o1, t2, o2 in probes:
        by_first.setdefault(t1, []).append((item, o1, t2, o2))
    wanted = {t for p in probes for t in (p[1], p[3])}

    def search(batches):
        for b in batches:
            for ids, shard in _shards(b):
                index = shard.postings(wanted)
                rows = set()
                for t1, asks in by_first.items():
                    for at, first in index.get(t1, {}).items():
                        second: dict[str, frozenset] = {}
                        for item, o1, t2, o2 in asks:
                            if t2 not in second:
                                second[t2] = frozenset(index.get(t2, {}).get(at, ()))
                            if second[t2]:
                                rows.update((item, at, p - o1) for p in first if p - o1 + o2 in second[t2])
                words = {at: shard.of(at) for at in {at for _, at, _ in rows}}
                out = {(item, ids[at], k, k + shift, n) for item, at, shift in rows for k, n in _runs(by_id[item], words[at], shift, run)}
                cols = list(zip(*sorted(out))) or [()] * 5
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["item_id", "doc_id", "item_word", "doc_word", "n_words"])

    return texts.mapInArrow(search, empty.schema)


def near_terms(docs: DataFrame, items: DataFrame, terms: int = 8, least: int = 4, span: int = 50, most_items: int = MOST_ITEMS) -> DataFrame:
    """(item_id, doc_id, n_terms, span): documents in which at least `least` of an item's `terms` rarest words stand within
    `span` words in any order. Words that occur in no document do not count. Nulls, blanks and empty tables give no rows."""
    return reduce(DataFrame.unionByName, [_near(docs, part, terms, least, span) for part in _passes(items, most_items)])


def _near(docs: DataFrame, items: DataFrame, terms: int, least: int, span: int) -> DataFrame:
    spark = docs.sparkSession
    by_id = _items(items)
    texts = docs.where("text is not null").select("doc_id", "text")
    df = document_frequencies(texts, {w for ws in by_id.values() for w in ws})
    pairs = sorted({(i, w) for i, ws in by_id.items() for w in sorted({w for w in ws if df.get(w)}, key=lambda w: (df[w], w))[:terms]})
    schema = "item_id int, doc_id bigint, n_terms int, span int"
    if not pairs:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame(pairs, "item_id int, q_term string")
    index = postings(texts, {t for _, t in pairs})
    lists = index.join(F.broadcast(table), index.term == table.q_term).groupBy("item_id", "doc_id").agg(F.collect_list(F.struct("term", "positions")).alias("lists"))
    lists = lists.where(F.size("lists") >= least)

    def windows(batches):
        for b in batches:
            rows = []
            for item, doc, ls in zip(*(b.column(c).to_pylist() for c in ("item_id", "doc_id", "lists"))):
                pos = np.array([p for x in ls for p in x["positions"]])
                who = np.array([k for k, x in enumerate(ls) for _ in x["positions"]])
                order = np.lexsort((who, pos))
                pos, who, best, a, have = pos[order], who[order], (0, 0), 0, Counter()
                for z in range(len(pos)):
                    have[who[z]] += 1
                    while pos[z] - pos[a] >= span:
                        have[who[a]] -= 1
                        if not have[who[a]]:
                            del have[who[a]]
                        a += 1
                    while have[who[a]] > 1:  # the window need not begin with a term that comes again
                        have[who[a]] -= 1
                        a += 1
                    best = max(best, (len(have), -int(pos[z] - pos[a] + 1)))
                if best[0] >= least:
                    rows.append((item, doc, best[0], -best[1]))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), pa.int32(), pa.int32()])], names=["item_id", "doc_id", "n_terms", "span"])

    return lists.mapInArrow(windows, schema)
