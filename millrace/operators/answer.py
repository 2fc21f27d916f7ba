"""From questions to answers in one batch: prompts, a pluggable model, grounding with one retry, the three routes and a cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import cache_key, render_chunk, truncate_lines
from millrace.operators.grounding import settle, verify
from millrace.operators.retrieve import graph_route, route

#: Phrases of the prompts and of the offline model (fixed values).
NO_CONTEXT = "I do not have enough context to answer."
INSTRUCTION = "Answer from the chunks below only, and cite lines as [path:first-last]."
FORBID = "Do not cite lines outside the chunks: "

Model = Callable[[Column], Column]


def answer_prompt(question: Column, blocks: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(INSTRUCTION), blocks, F.concat(F.lit("Question: "), question))


def retry_prompt(dropped: Column) -> Column:
    return F.concat(F.lit(FORBID), F.array_join(F.transform(dropped, lambda c: F.concat(c.path, F.lit(":"), c.lo.cast("string"), F.lit("-"), c.hi.cast("string"))), ", "))


def router_prompt(question: Column) -> Column:
    """Asks a model for the route of a question, to be read by `scalars.route_of`."""
    ask = 'Choose how to answer: "graph" for who calls or uses a symbol, "community" for how parts of the code work together, else "hybrid". Reply with JSON: {"route": ..., "confidence": 0 to 1, "reason": ...}'
    return F.concat_ws("\n\n", F.lit(ask), F.concat(F.lit("Question: "), question))


def community_prompt(question: Column, communities: Column, blocks: Column) -> Column:
    """Summaries of communities as the wider view, and chunks as the only thing to cite."""
    return F.concat_ws("\n\n", F.lit(INSTRUCTION), F.lit("The communities tell how the code hangs together; do not cite them."), communities, blocks, F.concat(F.lit("Question: "), question))


def reduce_prompt(children: Column) -> Column:
    """Asks for one summary of several; a list without any is an error while it runs."""
    some = F.filter(F.coalesce(children, F.array().cast("array<string>")), lambda c: c.isNotNull())
    return F.when(F.size(some) == 0, F.raise_error(F.lit("no summaries to join"))).otherwise(F.concat(F.lit("Join these summaries into one:\n\n"), F.array_join(some, "\n\n")))


def community_block(community_id: Column, title: Column, summary: Column) -> Column:
    """A community for a prompt; double quotes in its title become single ones."""
    return F.concat(F.lit('<community id="'), community_id.cast("string"), F.lit('" title="'), F.translate(F.coalesce(title, F.lit("")), '"', "'"), F.lit('">\n'), F.coalesce(summary, F.lit("")), F.lit("\n</community>"))


def mock_model(prompt: Column) -> Column:
    """The offline model: it cites the first chunk of the prompt, or says that it has no context."""
    path = F.regexp_extract(prompt, r'<retrieved_chunk path="([^"]+)" lines="(\d+)-(\d+)"', 1)
    lines = F.regexp_extract(prompt, r'<retrieved_chunk path="([^"]+)" lines="(\d+-\d+)"', 2)
    return F.when(path != "", F.concat(F.lit("See ["), path, F.lit(":"), lines, F.lit("]."))).otherwise(NO_CONTEXT)


def answer_with_chunks(questions: DataFrame, chunks: DataFrame, model: Model = mock_model) -> DataFrame:
    """(query_id, answer, kept, valid, retried) for questions (query_id, question) and ranked chunks (query_id, rank, path,
    start_line, end_line, symbol, text). An ungrounded answer is asked for once more, then stripped."""
    block = render_chunk(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol"), truncate_lines(F.col("text")))
    per = chunks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x.b), "\n\n").alias("blocks"))
    asked = questions.join(per, "query_id", "left").select("query_id", answer_prompt(F.col("question"), F.coalesce("blocks", F.lit(""))).alias("prompt"))
    first = asked.select("query_id", model(F.col("prompt")).alias("answer"))
    bad = verify(first, chunks).where("not valid").select("query_id", retry_prompt(F.col("dropped")).alias("prompt"))
    return settle(first, bad.select("query_id", model(F.col("prompt")).alias("answer")), chunks)


def dispatch(questions: DataFrame, nodes: DataFrame, edges: DataFrame, hybrid_chunks: DataFrame, community_chunks: DataFrame, model: Model = mock_model) -> DataFrame:
    """(query_id, route, answer, degraded_from, valid) over all routes at once. The community route falls back to hybrid for
    questions without community chunks. A graph question without a match says so; it does not fail."""
    r = route(questions).select("query_id", "route")
    q = questions.join(r, "query_id")
    have = community_chunks.select("query_id").distinct().withColumn("has", F.lit(True))
    q = q.join(have, "query_id", "left").withColumn("use", F.when((F.col("route") == "community") & F.col("has").isNull(), "hybrid").otherwise(F.col("route")))
    down = F.when(F.col("route") != F.col("use"), F.col("route")).alias("degraded_from")
    info = q.select("query_id", F.col("use").alias("route"), down)
    g = graph_route(q.where("use = 'graph'").select("query_id", "question"), nodes, edges).select("query_id", "answer", F.lit(True).alias("valid"))
    h = answer_with_chunks(q.where("use = 'hybrid'"), hybrid_chunks, model).select("query_id", "answer", "valid")
    c = answer_with_chunks(q.where("use = 'community'"), community_chunks, model).select("query_id", "answer", "valid")
    return info.join(g.unionByName(h).unionByName(c), "query_id")


def with_cache(questions: DataFrame, cache: DataFrame, version: str, model_name: str, top_k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): questions (query_id, repo, question) whose key is in cache (key, answer), and the rest with their key."""
    keyed = questions.withColumn("key", cache_key(F.col("repo"), F.lit(version), F.col("question"), F.lit(None).cast("string"), F.lit(top_k), F.lit(model_name)))
    return keyed.join(cache.select("key", "answer").dropDuplicates(["key"]), "key"), keyed.join(cache.select("key"), "key", "left_anti")


def to_cache(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """`cache` with the grounded answers (key, answer, valid) that it does not hold yet."""
    new = answers.where("valid").select("key", "answer").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    return cache.select("key", "answer").unionByName(new)
