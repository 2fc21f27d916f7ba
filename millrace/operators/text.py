"""Text retrieval: line windows, inverted index statistics and Okapi BM25 for batches of questions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalars import tokens
from millrace.session import small_rows, written

#: The one token of a text without tokens; no question can contain it (fixed value).
EMPTY_TOKEN = "__empty_chunk__"


def line_windows(texts: DataFrame, id_col: str, text_col: str, size: int = 80, overlap: int = 4) -> DataFrame:
    """(id, start_line, end_line, text): windows of `size` lines, each beginning `overlap` lines before the last one's end;
    blank windows are left out. A text of up to `size` lines is one window; null texts give none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the window")
    step = size - overlap
    lines = F.split(F.col(text_col), "\n", -1)
    count = F.when(F.size(lines) <= size, F.lit(1)).otherwise(1 + F.ceil((F.size(lines) - size) / step)).cast("int")
    w = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col), lines.alias("_l"), F.explode(F.sequence(F.lit(0), count - 1)).alias("_w"))
    part = F.slice("_l", F.col("_w") * step + 1, size)
    w = w.select(id_col, (F.col("_w") * step + 1).alias("start_line"), (F.col("_w") * step + F.size(part)).alias("end_line"), F.array_join(part, "\n").alias("text"))
    return w.where(F.col("text").rlike(r"\S"))


def term_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term, tf, dl)."""
    ts = tokens(F.col(text_col))
    ts = F.when(F.size(ts) == 0, F.array(F.lit(EMPTY_TOKEN))).otherwise(ts)
    d = docs.select(F.col(id_col).alias("doc"), ts.alias("ts"))
    return d.select("doc", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("doc", "term", "dl").agg(F.count("*").alias("tf"))


#: Questions are scored against all documents; a larger set than this must be split by the caller.
MOST_QUESTIONS = 20_000
#: Entries of the matrix of term weights that questions are scored by at once.
MOST_WEIGHTS = 2_000_000
_WORD = re.compile("[A-Za-z0-9]+")


def _words(text: str | None) -> list[str]:
    """The same as `tokens`, inside Arrow batches."""
    return [w.lower() for w in _WORD.findall(text or "") if len(w) > 1 and not w.isdigit()]


def bm25(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int = 50, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc, score, rank): Okapi BM25 with a token of a question counted as often as it occurs; scores not above 0 are
    dropped, ties go by doc. queries (query_id, question). An empty corpus or a question without tokens has no hits.

    Term statistics cover all documents. Long questions share common terms with nearly every document, so instead of joining
    posting lists, each batch of documents is one product of its term weights with those of the stated questions, and only its
    best k a question are shuffled.
    """
    spark = queries.sparkSession
    ts = tokens(F.col(text_col))
    bags = docs.select(F.when(F.size(ts) == 0, F.array(F.lit(EMPTY_TOKEN))).otherwise(ts).alias("ts"))
    n_docs, avgdl = bags.agg(F.count("*"), F.avg(F.size("ts"))).first()
    kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    schema = f"query_id {kinds[0]}, doc {kinds[1]}, score double"
    asked = small_rows(queries.select("query_id", tokens(F.col("question")).alias("ts")), "the questions", MOST_QUESTIONS)
    stats = bags.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    stats = written(stats.withColumn("raw", raw), "terms")
    mean = stats.agg(F.avg("raw")).first()[0] or 0.0
    wanted = queries.select(F.explode(tokens(F.col("question"))).alias("term")).distinct()
    idf = {r.term: r.raw if r.raw >= 0 else 0.25 * mean for r in small_rows(stats.join(wanted, "term"), "the questions' terms", 1_000_000)}
    blocks, rows, place, ids = [], [], {}, []
    for r in asked:  # questions in blocks whose weights fit a small matrix
        own = [t for t in r.ts if t in idf]
        if ids and (len(place) + len(own)) * (len(ids) + 1) > MOST_WEIGHTS:
            blocks.append((ids, place, np.array(rows, float).reshape(-1, 3)))
            rows, place, ids = [], {}, []
        rows += [(place.setdefault(t, len(place)), len(ids), idf[t] * (k1 + 1)) for t in own]
        ids.append(r.query_id)
    blocks.append((ids, place, np.array(rows, float).reshape(-1, 3)))
    blocks = [b for b in blocks if b[1]]

    def score(batches):
        for batch in batches:
            keys, texts = np.array(batch.column("doc").to_pylist()), batch.column("text").to_pylist()
            for a in range(0, len(keys), 512):
                part = [_words(t) for t in texts[a : a + 512]]
                dl = np.array([max(1, len(ws)) for ws in part])[:, None]
                cols: list[list] = [[], [], []]
                for ids, place, entries in blocks:
                    weights = np.zeros((len(place), len(ids)))
                    np.add.at(weights, (entries[:, 0].astype(int), entries[:, 1].astype(int)), entries[:, 2])
                    at = [(i, place[w]) for i, ws in enumerate(part) for w in ws if w in place]
                    tf = np.zeros((len(part), len(place)))
                    np.add.at(tf, tuple(np.array(at, int).reshape(-1, 2).T), 1)
                    s = np.round((tf / np.where(tf > 0, tf + k1 * (1 - b + b * dl / avgdl), 1)) @ weights, 6).T
                    top = np.lexsort((np.broadcast_to(keys[a : a + 512], s.shape), -s), axis=1)[:, :k]
                    got = np.take_along_axis(s, top, 1)
                    q, j = np.nonzero(got > 0)
                    for col, new in zip(cols, ([ids[i] for i in q], keys[a : a + 512][top[q, j]].tolist(), got[q, j].tolist())):
                        col += new
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["query_id", "doc", "score"])

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [arrow[kinds[0]], arrow[kinds[1]], pa.float64()]
    if not blocks:
        return spark.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc")
    found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(score, schema)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
