"""Subject areas of documents.

1. Every document is cut into sentences and terms once. All of them fit the leaves: normalised tf-idf vectors are clustered by
   bisecting k-means, cosine distance. A round is one pass over the vectors, in which each document walks down the tree and
   each task sums the vectors of the clusters that are being cut.
2. Every leaf is labelled by its discriminative terms, those more frequent in it than in its language, counted over all
   documents: the subjects of all labelled documents that have these terms give the mixture of the leaf. No label reaches a
   document in another way.
3. Every document takes the mixture of its nearest leaves.
4. A term belongs to the subjects of the mixtures it occurs under, counted over all documents: its weights are how much more
   often it occurs under one subject than under the others. A sentence goes to the subject of its terms, with the mixture of
   the document's leaves as prior. Weights are counted again from the sentences so assigned.
5. Comparisons in passing ("like a ..."): a sentence opening whose subject the rest of the document almost never shares,
   over the whole corpus, does not count as treating that subject.

Terms are 63-bit digests of (language, word), so that terms of different languages never mix. Term weights are sent to all
tasks; a term must stand in one of 100,000 sentences of its language, so there are at most 100,000 times the terms of a mean
sentence, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import written

#: Function words that tell the languages apart (fixed values). A text with none of them is of the language "".
FUNCTION_WORDS = {
    "de": "der die das und nicht für mit ist ein eine zu den im auf bei",
    "en": "the of and is a to in for with not it on by from",
    "es": "el la los las de en que con para una un por no si del",
}


@dataclass(frozen=True)
class Params:
    sample: int | None = None  #: about how many documents fit the leaves, by hash; None: all
    labelled: int | None = None  #: about how many labelled documents give terms their subjects, by hash; None: all
    leaves: int = 32  #: of each language
    rounds: int = 3  #: of k-means in each cut
    least: int = 8  #: documents from which a cluster is cut
    features: int = 1024  #: hashed terms of the vectors that are clustered
    near: int = 3  #: leaves a document is spread over
    leaf_terms: int = 50  #: discriminative terms a leaf is labelled by
    leaf_weight: float = 2.0  #: what the leaves' mixture counts for in a document, beside the weights of its terms
    leaf_bar: float = 0.3  #: by how much it lowers the bar for a sentence
    bar: float = 1.1  #: term weight from which a sentence treats a subject
    rare: float = 1e-5  #: share of the sentences of its language in which a term must stand
    seed: int = 11


_LANGS = [*sorted(FUNCTION_WORDS), ""]
_FENCE = re.compile(r"(?ms)^\s*(```|~~~).*?(?:^\s*\1\s*$|\Z)")
#: What stands before each line of a quotation or comment.
_MARK = re.compile(r"(?:(?:>|\||//|\*(?=\s))\s*)+(?=\S)")
_KIND = re.compile(r"(?P<rule>(?:=+|-{2,}|~{3,}|_{3,})$)|(?P<head>#|=+\s.*\s=+$)|(?P<item>(?:[-+]|\d+[.)])\s)")
_ENDS = (".", "?", "!", "…")
#: Words of a line of its own without closing punctuation, up to which it is a heading.
HEADING_WORDS = 6
#: Sentences from which on those of a document count for less each, so that no text outweighs a subject.
LONG = 32
#: Text handled at once, so that long texts do not multiply in memory.
SLICE_BYTES = 4 << 20


def _closed(line: str) -> bool:
    return line.endswith(_ENDS) or line.rstrip("\"')]").endswith(_ENDS)


def _without_headings(run: list[str]) -> list[str]:
    """The lines of a paragraph without short ones that neither go on from the line before nor into the next."""
    if len(run) == 1:
        return run if _closed(run[0]) or len(run[0].split()) > HEADING_WORDS else []
    out: list[str] = []
    for i, line in enumerate(run):
        if not _closed(line) and (not out or _closed(out[-1])) and len(line.split()) <= HEADING_WORDS:
            after = run[i + 1] if i + 1 < len(run) else None
            # in a narrow paragraph the next line is short and open as well
            if after is None or not after[0].islower() and (_closed(after) or len(after.split()) > HEADING_WORDS):
                continue
        out.append(line)
    return out


def paragraphs(text: str) -> list[str]:
    """Paragraphs outside code blocks and headings, each on one line. A paragraph ends at a blank line, a list item or another
    mark of quotation. Headings are lines marked or underlined as such, and short lines without closing punctuation that stand
    for themselves."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    out: list[str] = []
    run: list[str] = []
    before = ""
    for line in [*text.split("\n"), ""]:
        line, mark, kind = line.strip(), "", ""
        if line and not line[0].isalpha():
            if line[0] in ">|/*" and (m := _MARK.match(line)):
                mark, line = m[0].strip(), line[m.end() :]
            kind = m.lastgroup if (m := _KIND.match(line)) else ""
        if not line or kind or mark != before:
            if kind == "rule" and len(run) == 1:  # underlined
                run = []
            if run and (kept := _without_headings(run)):
                out.append(" ".join(kept))
            run, before = [], mark
        if line and kind not in ("rule", "head"):
            run.append(line)
    return out


def _cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All sentences of some texts, and the text each is of. Sentences go on over line ends; the last of a paragraph may lack
    its closing punctuation."""
    paras, owner = [], []
    for i, t in enumerate(texts):
        ps = paragraphs(t)
        paras += ps
        owner += [i] * len(ps)
    paras = [p if p.isascii() else p.replace("\u200b", "").replace("\u200d", "").replace("\ufeff", "") for p in paras]
    parts = pc.split_pattern(pc.replace_substring_regex(pa.array(paras, pa.large_string()), r"([.?!…])[\s\pZ]+([\"'(`¿¡]*[\pL\pN])", "\\1\n\\2"), "\n")
    sents, of = parts.flatten(), np.array(owner, np.int64)[pc.list_parent_indices(parts).to_numpy()]
    worded = pc.match_substring_regex(sents, r"\pL\pL")
    return sents.filter(worded), of[worded.to_numpy(zero_copy_only=False)]


def sentences(text: str) -> list[str]:
    """The sentences outside code blocks and headings."""
    return _cut([text])[0].to_pylist()


def _digest(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


_SALT = np.array([_digest("language " + g) for g in _LANGS], np.int64)


def _split(sents: pa.Array, between: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Sentence and number of every word, and the words; between: what separates words."""
    parts = pc.split_pattern_regex(sents, between)
    flat, of = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    some = pc.not_equal(flat, "")
    d = flat.filter(some).dictionary_encode()
    return of[some.to_numpy(zero_copy_only=False)], d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _split_pieces(sents: pa.Array, rewrite: Callable[[pa.Array], pa.Array], between: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As `_split` of the rewritten sentences, where neither words nor what is rewritten go over a space: each distinct piece
    between spaces is rewritten and split once."""
    parts = pc.split_pattern(sents, " ")
    d = parts.flatten().dictionary_encode()
    piece_of, code, words = _split(rewrite(d.dictionary), between)
    n = np.bincount(piece_of, minlength=len(d.dictionary))
    piece = d.indices.to_numpy(zero_copy_only=False)
    each, first = n[piece], (np.cumsum(n) - n)[piece]
    at = np.arange(each.sum())
    at += np.repeat(first - (np.cumsum(each) - each), each)
    return np.repeat(pc.list_parent_indices(parts).to_numpy(), each), code[at], words


def _terms(sents: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distinct (sentence, word) and the words: in lower case, of two letters or more; names in camel or snake case are several."""
    of, code, words = _split_pieces(sents, lambda v: pc.utf8_lower(pc.replace_substring_regex(v, r"(\p{Ll})(\p{Lu})", r"\1 \2")), r"\PL+")
    long = np.array([len(w) > 1 for w in words], bool)
    keep = long[code] if len(words) else np.zeros(0, bool)
    pairs, _ = _runs(of[keep].astype(np.int64) << 32 | code[keep])  # sentences stay in order
    return pairs >> 32, pairs & 0xFFFFFFFF, words


def _openings_of(sents: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Numbers (sentences x 3) of the first three words within 48 characters, -1 where there are fewer, and the words: pieces
    of code as one mark, numbers as 0, the rest in lower case."""

    def rewrite(v: pa.Array) -> pa.Array:
        v = pc.replace_substring_regex(v, r"\S*(?:[`_/(]|\p{Ll}\p{Lu}|[\pL\pN]\.[\pL\pN])\S*", " \x01 ")
        return pc.replace_substring_regex(pc.utf8_lower(v), r"\pN+", " 0 ")

    of, code, words = _split_pieces(pc.utf8_slice_codeunits(sents, 0, 48), rewrite, r"[^\pL0\x01]+")
    n = np.bincount(of, minlength=len(sents))
    at = (np.cumsum(n) - n)[:, None] + np.arange(3)
    there = np.arange(3) < n[:, None]
    return np.where(there, np.append(code, 0)[np.where(there, at, len(code))], -1), words


_PACKED = "packed binary"


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _parse_texts(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    sents, doc = _cut(texts)
    of, code, words = _terms(sents)
    n_sent = np.bincount(doc, minlength=len(texts))
    counts = np.zeros((len(texts), len(_LANGS)))
    for k, g in enumerate(_LANGS[:-1]):  # function words counted once a sentence
        own = set(FUNCTION_WORDS[g].split())
        hit = np.array([w in own for w in words], bool)
        counts[:, k] = np.bincount(doc[of[hit[code]]], minlength=len(texts)) if len(words) else 0
    counts[:, -1] = 0.5
    lang = counts.argmax(1)
    opened, first = _openings_of(sents)
    number = np.array([_digest(w) for w in words], np.int64)
    mark = np.array([0 if w == "0" else _digest(w) for w in first] + [0], np.int64)
    salt = _SALT[lang][doc]
    opens = mark[opened]
    opens = np.where(opens == 0, 0, opens ^ salt[:, None])
    per_sent = np.bincount(of, minlength=len(sents))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(np.array(_LANGS, object)[lang].tolist(), pa.string()),
            _lists(per_sent, n_sent, pa.int32()),
            _lists((number[code] if len(words) else code) ^ salt[of], np.bincount(doc[of], minlength=len(texts)), pa.int64()),
            _lists(opens.ravel(), 3 * n_sent, pa.int64()),
        ],
        names=["doc_id", "lang", "lens", "ids", "opens"],
    )


def _packed(b: pa.RecordBatch) -> pa.RecordBatch:
    """A batch as one value, with lists of numbers coded by a dictionary: passes read it without handling each element."""
    columns = []
    for c in b.columns:
        if pa.types.is_list(c.type) and pa.types.is_int64(c.type.value_type):
            c = pa.ListArray.from_arrays(c.offsets, c.values.dictionary_encode())
        columns.append(c)
    b = pa.RecordBatch.from_arrays(columns, names=b.schema.names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["packed"])


def _unpacked(batches):
    """The batches packed in batches of `_PACKED`, one at a time."""
    for b in batches:
        for v in b.column("packed"):
            yield pa.ipc.open_stream(v.as_buffer()).read_next_batch()


def _parse(batches):
    """Per document: its language, the number of distinct terms of each sentence, the terms of all sentences, three opening words
    a sentence, and q as given; in packed batches."""
    for b in batches:
        texts = b.column("text")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                parsed = _parse_texts(b.column("doc_id")[a:z].to_pylist(), texts[a:z].to_pylist())
                yield _packed(parsed.append_column("q", b.column("q")[a:z]))


class _Batch:
    """A batch of parsed documents as flat arrays."""

    def __init__(self, b: pa.RecordBatch):
        def flat(name: str) -> np.ndarray:
            v = b.column(name).flatten()
            v = v.dictionary_decode() if pa.types.is_dictionary(v.type) else v
            return v.to_numpy(zero_copy_only=False).astype(np.int64)

        self.docs = b.column("doc_id").to_numpy(zero_copy_only=False)
        self.langs = np.array(b.column("lang").to_pylist(), object)
        self.lang_no = np.array([_LANGS.index(g) for g in self.langs], np.int64)
        self.lens = flat("lens")
        d = b.column("ids").flatten()
        d = d if pa.types.is_dictionary(d.type) else d.dictionary_encode()
        self.code, self.terms = d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = self.terms[self.code]
        self.n_sent = b.column("lens").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        d = b.column("opens").flatten()
        d = d if pa.types.is_dictionary(d.type) else d.dictionary_encode()
        self.opens, self.open_words = d.indices.to_numpy(zero_copy_only=False).reshape(-1, 3), d.dictionary.to_numpy(zero_copy_only=False).astype(np.int64)
        self.mix: np.ndarray | None = None  # the mixture of the document's leaves, in which the last place is the share of no subject
        self.doc_of_sent = np.repeat(np.arange(len(self.docs)), self.n_sent)
        self.sent_of_term = np.repeat(np.arange(len(self.lens)), self.lens)
        self.doc_of_term = self.doc_of_sent[self.sent_of_term]
        # what a sentence counts for in the corpus: those of a very long document no more than `LONG` together
        self.counts_for = np.minimum(1, LONG / np.maximum(self.n_sent, 1))[self.doc_of_sent]

    def lang_of_terms(self) -> np.ndarray:
        """The number of each term's language; a term has one."""
        out = np.zeros(len(self.terms), np.int64)
        out[self.code] = self.lang_no[self.doc_of_term]
        return out

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, place of a term)."""
        pairs, _ = _runs(self.doc_of_term * len(self.terms) + self.code)
        return pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each is there."""
    v = np.sort(values)
    at = np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])
    return v[at], np.diff(np.append(at, len(v)))


def _lang_names(numbers: np.ndarray) -> pa.Array:
    return pa.array(_LANGS, pa.string()).take(pa.array(numbers, pa.int64()))


@dataclass(frozen=True)
class Leaves:
    stops: np.ndarray  # sorted terms of more than six tenths of the documents of their language
    idf: dict[str, np.ndarray]
    centres: dict[str, np.ndarray]  # leaves x features
    first: dict[str, int]  # the number of each language's first leaf
    n: int
    near: int

    def features(self, x: _Batch):
        """Hashed term counts without stop terms, 512 documents at a time: the first of them, and their counts."""
        width = next(iter(self.idf.values())).shape[0]
        at = np.where(_find(self.stops, x.terms) >= 0, width, x.terms % width)[x.code]
        for a in range(0, len(x.docs), 512):
            m = min(512, len(x.docs) - a)
            lo, hi = np.searchsorted(x.doc_of_term, [a, a + m])
            yield a, np.bincount((x.doc_of_term[lo:hi] - a) * (width + 1) + at[lo:hi], minlength=m * (width + 1)).reshape(m, width + 1)[:, :width]

    def spread(self, x: _Batch) -> tuple[np.ndarray, np.ndarray]:
        """The nearest leaves of each document and its shares in them; a document without features has share 0 in all."""
        leaf, share = np.zeros((len(x.docs), self.near), np.int64), np.zeros((len(x.docs), self.near))
        for a, counts in self.features(x) if self.centres else ():
            for g, c in self.centres.items():
                rows, k = np.flatnonzero(x.lang_no[a : a + len(counts)] == _LANGS.index(g)), min(self.near, len(c))
                mine, v = rows + a, counts[rows].astype(np.float32) * self.idf[g]
                length = np.linalg.norm(v, axis=1, keepdims=True)
                s = (v @ c.T) / np.where(length > 0, length, 1)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                e = np.exp(12 * np.take_along_axis(s, top, 1))
                leaf[mine, :k], share[mine, :k] = top + self.first[g], np.where(length > 0, e / e.sum(1, keepdims=True), 0)
        return leaf, share


def _find(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of ids in sorted keys, -1 for those that are not there."""
    if not len(keys):
        return np.full(len(ids), -1)
    at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
    return np.where(keys[at] == ids, at, -1)


def _stops(docs: DataFrame) -> np.ndarray:
    """Sorted terms of more than six tenths of the documents of their language: no more than twice the distinct terms of a mean document."""

    def count(batches):
        for b in _unpacked(batches):
            x = _Batch(b)
            lang, n = _runs(x.lang_no)
            yield pa.RecordBatch.from_arrays([_lang_names(lang), pa.array(np.full(len(lang), -1), pa.int64()), pa.array(n, pa.int64())], names=["lang", "term", "n"])
            n = np.bincount(x.once()[1], minlength=len(x.terms))
            yield pa.RecordBatch.from_arrays([_lang_names(x.lang_of_terms()), pa.array(x.terms, pa.int64()), pa.array(n, pa.int64())], names=["lang", "term", "n"])

    n = docs.mapInArrow(count, "lang string, term bigint, n bigint").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    n = written(n, "document_counts")
    total = n.where("term = -1").select("lang", F.col("n").alias("docs"))
    return np.array(sorted(r.term for r in n.where("term <> -1").join(F.broadcast(total), "lang").where("n > greatest(4, 0.6 * docs)").select("term").collect()), np.int64)


_SUMS = "key int, n bigint, v array<double>"


def _sums(keys: np.ndarray, n: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Rows of `_SUMS` for the keys that have any documents."""
    some = n > 0
    return pa.RecordBatch.from_arrays([pa.array(keys[some], pa.int32()), pa.array(n[some], pa.int64()), _lists(v[some].ravel(), np.full(int(some.sum()), v.shape[1]), pa.float64())], names=["key", "n", "v"])


def _add(parts: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Documents and the sum of vectors of each key; there are no more keys than leaves."""
    total = parts.groupBy("key").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return {r.key: (r.n, np.array(r.v)) for r in total.collect()}


_VECTORS = "lang int, lens binary, f binary, n binary"


def _narrow(v: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs: passes over vectors move all of them."""
    return v.astype(np.min_scalar_type(v.max(initial=0))).tobytes()


def _vectors(batches):
    """Language, entries of each document (none is 0), their features and counts, of term counts in batches of `_VECTORS`."""
    for b in batches:
        for g, lens, *parts in zip(b.column("lang").to_pylist(), *(b.column(c) for c in ("lens", "f", "n"))):
            lens = np.frombuffer(lens.as_buffer(), np.int32).astype(np.int64)
            f, n = (np.frombuffer(v.as_buffer(), f"u{v.as_buffer().size // lens.sum()}") for v in parts)
            yield g, lens, f, n


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class _Tree:
    """Clusters as far as they are cut: node g is all of language g, the two parts of a node have consecutive numbers."""

    centres: list[np.ndarray | None]
    parts: dict[int, int]  # the first part of each node that is cut

    def add(self, tf: DataFrame, weights: np.ndarray, nodes: list[int], lang_of: dict[int, int]) -> dict[int, tuple[int, np.ndarray]]:
        """Documents and the sum of the normalised vectors of some uncut nodes, over all of tf. weights: languages x features."""
        width, place = weights.shape[1], np.full(len(self.centres), -1)
        langs = np.array([lang_of[k] for k in nodes], np.int64)
        cut, part = np.full(len(self.centres), -1), np.zeros(len(self.centres), np.int64)
        toward, first_of = {}, {}
        for g in set(langs.tolist()):
            own = np.flatnonzero(langs == g)
            place[np.array(nodes)[own]], first_of[g] = np.arange(len(own)), own
            cuts = [k for k in self.parts if lang_of[k] == g]
            # from the first part's centre to the other's; takes counts, as lengths change no sign
            steps = [_unit(self.centres[self.parts[k] + 1] - self.centres[self.parts[k]]) * weights[g] for k in cuts]
            toward[g] = np.array(steps, np.float32).reshape(-1, width).T
            cut[cuts], part[cuts] = np.arange(len(cuts)), [self.parts[k] for k in cuts]

        def run(batches):
            n, total = np.zeros(len(nodes), np.int64), np.zeros((len(nodes), width))
            for g, lens, f, count in _vectors(batches):
                if g not in toward:
                    continue
                start, own = np.cumsum(lens) - lens, first_of[g]
                square = np.add.reduceat((weights[g][f] * count) ** 2, start, dtype=np.float64)
                row = np.repeat(np.arange(len(lens)), lens)
                for a in range(0, len(lens), 512):
                    m, lo, hi = min(512, len(lens) - a), start[a], (start[a + 512] if a + 512 < len(lens) else len(f))
                    v = np.zeros(m * width, np.float32)
                    v[(row[lo:hi] - a) * width + f[lo:hi]] = count[lo:hi]
                    v = v.reshape(m, width)
                    node, right = np.full(m, g), v @ toward[g] > 0
                    while ((at := cut[node]) >= 0).any():
                        node = np.where(at >= 0, part[node] + right[np.arange(m), at], node)
                    some = np.flatnonzero((place[node] >= 0) & (square[a : a + m] > 0))
                    to = place[node[some]]
                    share = np.zeros((m, len(own)), np.float32)
                    share[some, to] = 1 / np.sqrt(square[a : a + m][some])
                    n[own] += np.bincount(to, minlength=len(own))
                    total[own] += share.T @ v
            yield _sums(np.array(nodes), n, total * weights[langs])

        return _add(tf.mapInArrow(run, _SUMS))


def fit_leaves(docs: DataFrame, p: Params) -> Leaves:
    """Leaves by bisecting k-means over all of some parsed documents, for each language."""
    stops = _stops(docs)
    width = p.features

    def count(batches):
        for b in _unpacked(batches):
            x = _Batch(b)
            at = np.where(_find(stops, x.terms) >= 0, -1, x.terms % width)[x.code]
            own, n = _runs((x.doc_of_term * width + at)[at >= 0])
            doc, f = own // width, own % width
            lens = np.bincount(doc, minlength=len(x.docs))
            rows = []
            for g in np.unique(x.lang_no[lens > 0]).tolist():
                mine = x.lang_no[doc] == g
                own_lens = lens[(lens > 0) & (x.lang_no == g)]
                rows.append((g, own_lens.astype(np.int32).tobytes(), _narrow(f[mine]), _narrow(n[mine]), len(own_lens), np.bincount(f[mine], minlength=width).astype(np.float64)))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["lang", "lens", "f", "n", "docs", "df"])

    counted = written(docs.mapInArrow(count, _VECTORS + ", docs bigint, df array<double>"), "tf")
    known = _add(counted.select(F.col("lang").alias("key"), F.col("docs").alias("n"), F.col("df").alias("v")))
    tf = counted.select("lang", "lens", "f", "n")
    weights = np.zeros((len(_LANGS), width), np.float32)
    for g, (n, df) in known.items():
        weights[g] = np.where(df >= min(3, n), np.log((n + 1) / (df + 1)), 0)
    tree = _Tree([None] * len(_LANGS), {})
    lang_of = {g: g for g in range(len(_LANGS))}
    # documents and vectors of the nodes that may still be cut
    open_nodes = {g: (g, n, v) for g, (n, v) in tree.add(tf, weights, sorted(known), lang_of).items() if n > 1} if known else {}
    langs = sorted(open_nodes)
    for g, _, v in open_nodes.values():
        tree.centres[g] = _unit(v)
    wanted = {g: max(2, min(p.leaves, known[g][0] // 8)) - 1 for g in langs}
    while open_nodes:
        fresh = {}
        for g in langs:
            # those whose vectors are not all alike, the largest first
            able = sorted((-n, node) for node, (h, n, v) in open_nodes.items() if h == g and n >= p.least and n - np.linalg.norm(v) > 1e-6 * n)
            for _, node in able[: wanted[g]]:
                noise = 1e-4 * np.random.default_rng([p.seed, node]).random(width)
                fresh[node] = tree.parts[node] = len(tree.centres)
                tree.centres.extend([_unit(tree.centres[node] - noise), _unit(tree.centres[node] + noise)])
                lang_of[fresh[node]] = lang_of[fresh[node] + 1] = g
        got: dict[int, tuple[int, np.ndarray]] = {}
        for _ in range(p.rounds):
            if not fresh:
                break
            got = tree.add(tf, weights, [k for first in fresh.values() for k in (first, first + 1)], lang_of)
            for node, first in list(fresh.items()):
                if first in got and first + 1 in got:
                    tree.centres[first], tree.centres[first + 1] = _unit(got[first][1]), _unit(got[first + 1][1])
                else:  # stays whole
                    del fresh[node], tree.parts[node]
        open_nodes = {k: (lang_of[k], *got[k]) for first in fresh.values() for k in (first, first + 1)}
        for node in fresh:
            wanted[lang_of[node]] -= 1
    # parts of nodes that stayed whole have no place in the tree
    placed = {*langs, *(k for first in tree.parts.values() for k in (first, first + 1))} - set(tree.parts)
    idf, centres, first = {}, {}, {}
    for g in sorted(langs, key=lambda k: _LANGS[k]):
        name = _LANGS[g]
        idf[name], first[name] = weights[g], sum(map(len, centres.values()))
        centres[name] = np.stack([tree.centres[k] for k in sorted(placed) if lang_of[k] == g]).astype(np.float32)
    return Leaves(stops, idf, centres, first, sum(map(len, centres.values())), p.near)


def weigh(n: np.ndarray, totals: np.ndarray, none: float | np.ndarray = 1.0) -> np.ndarray:
    """Weights (terms x subjects and none) from how often terms stand under each subject and none (the last place), and how
    often anything does: log odds of the rates, so that a subject's size does not matter, where one of them has two fifths of
    the rate; 0 for all others. none weighs the rate of none, which is its odds where single sentences are judged."""
    rate = (n + 2 * n.sum(1, keepdims=True) / totals.sum(1, keepdims=True)) / (totals + 2)
    rate[:, -1] *= none
    q = rate / rate.sum(1, keepdims=True)
    w = np.log(q / (1 - q + 1e-9)) + np.log(max(1, n.shape[1] - 1))
    w = np.where(w > 0.6, np.minimum(w, 5), 0)
    w[q.max(1) < 0.4] = 0
    return w


@dataclass(frozen=True)
class Mixtures:
    """The mixture of each leaf (leaves x subjects and none), and its discriminative terms."""

    of_leaf: np.ndarray
    terms: np.ndarray  # in pairs with
    leaf: np.ndarray

    def of_documents(self, x: _Batch, leaf: np.ndarray, share: np.ndarray) -> np.ndarray:
        """A document takes the mixtures of those of its nearest leaves of which it has discriminative terms, two or one twice."""
        mix = np.zeros((len(x.docs), self.of_leaf.shape[1]))
        order = np.argsort(x.terms)
        at = _find(x.terms[order], self.terms)
        marks = np.zeros((len(x.terms), max(1, len(self.of_leaf))), bool)
        marks[order[at[at >= 0]], self.leaf[at >= 0]] = True
        own = np.flatnonzero(marks.any(1)[x.code])
        doc, code = x.doc_of_term[own], x.code[own]
        for j in range(leaf.shape[1] if len(self.of_leaf) else 0):
            has = np.bincount(doc[marks[code, leaf[doc, j]]], minlength=len(x.docs)) >= 2
            mix[has] += (share[:, j, None] * self.of_leaf[leaf[:, j]])[has]
        mix[:, -1] += 1 - mix.sum(1)
        return mix


def leaf_mixtures(docs: DataFrame, labelled: DataFrame, leaves: Leaves, n_subjects: int, p: Params, least: int = 3, lift: float = 1.5) -> Mixtures:
    """The mixture of each leaf from the subjects of its discriminative terms: those that at least `least` of the documents
    nearest to it have, `lift` times as often as all of its language, the best `leaf_terms` of them by documents times log lift.
    Both tables are packed; in labelled, q is the share of each subject in the labels of a document, null without. A term that no
    labelled document has, or whose documents agree on nothing, has no say; a leaf none of whose terms has one treats none of
    the subjects."""

    def place(batches):
        """Documents of each leaf that have a term, by language; the documents themselves count as term -1."""
        for b in _unpacked(batches):
            x = _Batch(b)
            leaf, share = leaves.spread(x)
            leaf = np.where(share[:, 0] > 0, leaf[:, 0], -1) + 1
            k, n = _runs(x.lang_no * (leaves.n + 1) + leaf)
            yield _placed(k // (leaves.n + 1), k % (leaves.n + 1), np.full(len(k), -1), n)
            doc, code = x.once()
            k, n = _runs(leaf[doc] * len(x.terms) + code)
            code = k % max(1, len(x.terms))
            yield _placed(x.lang_of_terms()[code], k // max(1, len(x.terms)), x.terms[code], n)

    def _placed(lang, leaf, term, n):
        return pa.RecordBatch.from_arrays([_lang_names(lang), pa.array(leaf - 1, pa.int32()), pa.array(term, pa.int64()), pa.array(n, pa.int64())], names=["lang", "leaf", "term", "n"])

    each = docs.mapInArrow(place, "lang string, leaf int, term bigint, n bigint")
    n = written(each.groupBy("lang", "leaf", "term").agg(F.sum("n").alias("n")), "leaf_terms")
    of_leaf = n.where("term = -1").select("lang", "leaf", F.col("n").alias("docs"))
    total = of_leaf.groupBy("lang").agg(F.sum("docs").alias("all_docs"))
    everywhere = n.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    rated = n.where(f"term <> -1 and leaf <> -1 and n >= {least}").join(F.broadcast(of_leaf), ["lang", "leaf"]).join(F.broadcast(total), "lang").join(everywhere, ["lang", "term"])
    rated = rated.withColumn("lift", F.col("n") * F.col("all_docs") / (F.col("docs") * F.col("all_n"))).where(F.col("lift") >= lift)
    order = Window.partitionBy("leaf").orderBy((F.col("n") * F.log("lift")).desc(), "term")
    best = rated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.leaf_terms)

    def tell(batches):
        """How much of each subject the labelled documents that have a term have; term -1 is every document."""
        for b in _unpacked(batches):
            b = b.filter(b.column("q").is_valid())
            if not b.num_rows:
                continue
            x = _Batch(b)
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            doc, code = x.once()
            told = np.stack([np.bincount(code, q[doc, k], minlength=len(x.terms)) for k in range(n_subjects + 1)], 1)
            has = told.any(1)  # the terms are those of all documents of the batch
            yield _count(_lang_names(x.lang_of_terms()[has]), x.terms[has][:, None], told[has])
            for g in np.unique(x.lang_no):
                yield _count(_lang_names(np.array([g])), np.array([[-1]]), q[x.lang_no == g].sum(0, keepdims=True))

    told = _sum_counts(labelled.mapInArrow(tell, _COUNTS), n_subjects + 1)
    labelled = written(told.select("lang", "term", *[F.col("n")[k].alias(f"q{k}") for k in range(n_subjects + 1)]), "labelled_terms")
    totals = {r[0]: np.array(r[2:]) for r in labelled.where("term = -1").collect()}
    rows = best.join(labelled, ["lang", "term"], "left").select("lang", "leaf", "term", "n", "lift", *[f"q{k}" for k in range(n_subjects + 1)]).collect()
    mix = np.zeros((leaves.n, n_subjects + 1))
    for r in rows:
        if r.q0 is not None:
            mix[r.leaf] += r.n * np.log(r.lift) * weigh(np.array([r[5:]]), totals[r.lang][None])[0]
    told = mix.sum(1) > 0
    mix[~told, -1] = 1
    return Mixtures(mix / mix.sum(1, keepdims=True), np.array([r.term for r in rows], np.int64), np.array([r.leaf for r in rows], np.int64))


@dataclass(frozen=True)
class Lexicon:
    terms: np.ndarray  # sorted
    weights: np.ndarray  # terms x subjects


def classify(x: _Batch, lex: Lexicon, p: Params) -> np.ndarray:
    """The subject of each sentence of a batch; the number of subjects means none. The mixture of the document's leaves is the
    prior, and lowers the bar for its subjects."""
    s = lex.weights.shape[1]
    at = _find(lex.terms, x.terms)[x.code]
    hit = np.flatnonzero(at >= 0)
    w = lex.weights[at[hit]]
    scores = np.stack([np.bincount(x.sent_of_term[hit], w[:, k], minlength=len(x.lens)) for k in range(s)], 1) if s else np.zeros((len(x.lens), 0))
    doc = np.stack([np.bincount(x.doc_of_sent, scores[:, k], minlength=len(x.docs)) for k in range(s)], 1) + p.leaf_weight * x.mix[:, :s]
    prior = np.log((doc + 0.5) / (doc.sum(1, keepdims=True) + 0.5 * s))
    best = (scores + 0.3 * prior[x.doc_of_sent]).argmax(1) if len(scores) else np.zeros(0, int)
    return np.where((scores + p.leaf_bar * x.mix[x.doc_of_sent, :s] * (scores > 0)).max(1, initial=0) > p.bar, best, s)


def _shares(x: _Batch, found: np.ndarray, s: int) -> np.ndarray:
    """Sentences of each subject, and of none, per document."""
    return np.bincount(x.doc_of_sent * (s + 1) + found, minlength=len(x.docs) * (s + 1)).reshape(-1, s + 1).astype(float)


def _openings(x: _Batch, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The opening words of a batch in order, with terms of any subject as 1, and the place of those of each sentence."""
    words, at = np.unique(np.where(_find(lex.terms, x.open_words) >= 0, 1, x.open_words), return_inverse=True)
    return words, at[x.opens]


def _distinct_rows(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of three numbers from 0 to n - 1, and the place of each row's."""
    _, pair = np.unique(rows[:, 0] * n + rows[:, 1], return_inverse=True)
    _, at, inv = np.unique(pair * n + rows[:, 2], return_index=True, return_inverse=True)
    return rows[at], inv


class _Openings:
    """A set of openings."""

    def __init__(self, rows: np.ndarray):
        self.words, at = np.unique(rows, return_inverse=True)
        at, n = at.reshape(rows.shape), len(self.words)
        self.pairs, pair = np.unique(at[:, 0] * n + at[:, 1], return_inverse=True)
        self.rows = np.unique(pair * n + at[:, 2])

    def has(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether each of some rows of places in words is in the set."""
        n, at = len(self.words), _find(self.words, words)[rows]
        pair = np.where((at >= 0).all(1), _find(self.pairs, at[:, 0] * n + at[:, 1]), -1)
        return (pair >= 0) & (_find(self.rows, pair * n + at[:, 2]) >= 0)


_COUNTS = "lang string, term bigint, b bigint, c bigint, n array<double>"


def _count(lang: pa.Array, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of `_COUNTS`; keys are one term a row, or the three words of an opening."""
    more = [pa.array(keys[:, k], pa.int64()) if keys.shape[1] > 1 else pa.nulls(len(keys), pa.int64()) for k in (1, 2)]
    return pa.RecordBatch.from_arrays([lang, pa.array(keys[:, 0], pa.int64()), *more, _lists(n.ravel(), np.full(len(n), n.shape[1]), pa.float64())], names=["lang", "term", "b", "c", "n"])


def _term_counts(x: _Batch, weight: np.ndarray, found: np.ndarray | None = None):
    """How much of each column of weight (sentences x columns) each term stands under, by language; term -1 is every sentence.
    found: the only column of each sentence that is not 0, if it is known."""
    width = weight.shape[1]
    if found is None:
        n = np.stack([np.bincount(x.code, weight[x.sent_of_term, k], minlength=len(x.terms)) for k in range(width)], 1)
    else:
        of_sent = weight[np.arange(len(found)), found]
        n = np.bincount(x.code.astype(np.int64) * width + found[x.sent_of_term], of_sent[x.sent_of_term], len(x.terms) * width).reshape(-1, width)
    yield _count(_lang_names(x.lang_of_terms()), x.terms[:, None], n)
    for g in np.unique(x.lang_no):
        yield _count(_lang_names(np.array([g])), np.array([[-1]]), weight[(x.lang_no == g)[x.doc_of_sent]].sum(0, keepdims=True))


def _lexicon(counts: DataFrame, s: int, p: Params, judged: bool = False) -> Lexicon:
    """Weights of the terms that speak for a subject; a term must stand in `rare` of the sentences of its language, and in three.
    judged: each sentence was counted under its own subject, not under those of its document."""
    totals = {r.lang: np.array(r.n) for r in counts.where("term = -1 and b is null").select("lang", "n").collect()}

    def run(batches):
        for b in batches:
            n = b.column("n").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            all_n = np.stack([totals[g] for g in b.column("lang").to_pylist()]) if b.num_rows else n
            w = weigh(n, all_n, np.maximum(1, all_n[:, -1] * s / np.maximum(1, all_n[:, :-1].sum(1))) if judged else 1.0) if b.num_rows else n
            w = np.where(w.argmax(1)[:, None] == s, 0, w)[:, :s]
            keep = w.any(1) & (n.sum(1) >= np.maximum(3, p.rare * all_n.sum(1))) if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(b.column("term").to_numpy()[keep], pa.int64()), _lists(w[keep].ravel(), np.full(int(keep.sum()), s), pa.float32())], names=["term", "w"])

    rows = counts.where("term <> -1 and b is null").select("lang", "term", "n").mapInArrow(run, "term bigint, w array<float>").toArrow()
    terms = rows.column("term").to_numpy()
    order = np.argsort(terms)
    return Lexicon(terms[order], rows.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, s)[order])


def _sum_counts(parts: DataFrame, width: int) -> DataFrame:
    sums = parts.groupBy("lang", "term", "b", "c").agg(*[F.sum(F.get("n", F.lit(k))).alias(f"n{k}") for k in range(width)])
    return sums.select("lang", "term", "b", "c", F.array(*[F.coalesce(f"n{k}", F.lit(0.0)) for k in range(width)]).alias("n"))


def document_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, default: str = "software", share: float = 0.25, params: Params = Params()) -> DataFrame:
    """(doc_id, subject, part): the subjects that at least `share` of a document's sentences treat, with that part, or
    `default` if there is none.

    Null and blank texts give no row. A text without sentences gets `default`. Equal texts get equal subjects. Repeated labels
    count once per document and subject; labels of unknown subjects or documents are ignored; without labels every document is
    `default`. Empty tables give no rows. doc_id must be unique.
    """
    p = params
    names = [r.subject for r in areas.where(F.col("subject").isNotNull() & (F.col("subject") != default)).select("subject").distinct().orderBy("subject").collect()]
    s = len(names)
    texts = docs.where("text is not null").where(F.col("text").rlike(r"\S")).select("doc_id", "text")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isin([*names, default])).select("doc_id", "subject").distinct()
    known = known.groupBy("doc_id").agg(F.array(*[F.max((F.col("subject") == n).cast("double")) for n in [*names, default]]).alias("q"))
    if p.labelled is not None:
        every = max(1, -(-known.count() // p.labelled))
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(every)) == 0)
    known = written(known.withColumn("q", F.transform("q", lambda v: v / F.aggregate("q", F.lit(0.0), lambda a, b: a + b))), "labels")
    texts = texts.join(known, "doc_id", "left").select("doc_id", "text", "q")
    parsed = written(texts.mapInArrow(_parse, _PACKED), "parsed")
    fitting = parsed
    if p.sample is not None:
        step = max(1, -(-docs.count() // p.sample))
        fitting = written(texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).mapInArrow(_parse, _PACKED), "sample")
    leaves = fit_leaves(fitting, p)
    mix = leaf_mixtures(fitting, parsed, leaves, s, p)

    def mixed(b: pa.RecordBatch) -> _Batch:
        """A batch with the mixtures of its documents: cheaper to take again in each pass than to write with all terms."""
        x = _Batch(b)
        x.mix = mix.of_documents(x, *leaves.spread(x)).astype(np.float32)
        return x

    def first(batches):
        for b in _unpacked(batches):
            x = mixed(b)
            yield from _term_counts(x, x.mix[x.doc_of_sent] * x.counts_for[:, None])

    lex0 = _lexicon(written(_sum_counts(parsed.mapInArrow(first, _COUNTS), s + 1), "counts"), s, p)

    def again(batches):
        """Terms under the subjects of sentences, and openings with how many of their sentences have a subject that the rest of the document shares."""
        for b in _unpacked(batches):
            x = mixed(b)
            found = classify(x, lex0, p)
            yield from _term_counts(x, np.eye(s + 1)[found] * x.counts_for[:, None], found)
            c = _shares(x, found, s)
            ok = (found < s) & (x.n_sent[x.doc_of_sent] > 3)
            d = x.doc_of_sent[ok]
            shared = c[d, found[ok]] - 1 >= np.maximum(1, 0.15 * (x.n_sent[d] - 1))
            words, opened = _openings(x, lex0)
            keys, inv = _distinct_rows(opened[ok], len(words))
            n = np.stack([np.bincount(inv, minlength=len(keys)), np.bincount(inv, shared, minlength=len(keys))], 1).astype(float)
            yield _count(pa.array([""] * len(keys), pa.string()), words[keys], n)

    counts = written(_sum_counts(parsed.mapInArrow(again, _COUNTS), s + 1), "counts")
    lex = _lexicon(counts, s, p, judged=True)
    few = counts.where("b is not null").select("term", "b", "c", F.get("n", F.lit(0)).alias("n"), F.get("n", F.lit(1)).alias("shared"))
    passing = few.where("n >= 12 and shared <= 0.15 * n").select("term", "b", "c").toArrow()
    known_openings = _Openings(np.stack([passing.column(k).to_numpy() for k in range(3)], 1))

    def final(batches):
        for b in _unpacked(batches):
            x = mixed(b)
            found = classify(x, lex, p)
            hit = np.flatnonzero(found < s)
            words, opened = _openings(x, lex0)
            found[hit[known_openings.has(words, opened[hit])]] = s
            c = _shares(x, found, s)
            n = np.maximum(x.n_sent, 1)[:, None]
            take = (c >= share * n) & (c > 0)
            take[:, s] = False
            take[~take.any(1), s] = True
            d, k = np.nonzero(take)
            part = np.where((k == s) & (x.n_sent[d] == 0), 1.0, c[d, k] / n[d, 0])
            yield pa.RecordBatch.from_arrays([pa.array(x.docs[d], pa.int64()), pa.array([(names + [default])[i] for i in k], pa.string()), pa.array(part)], names=["doc_id", "subject", "part"])

    return parsed.mapInArrow(final, "doc_id bigint, subject string, part double")
