"""Scalar expressions, all built from Spark functions so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of each file suffix (fixed values).
SUFFIX_LANGUAGE = {".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go"}
#: Citations in their quoting dialects: [path:lo-hi], [path="...":lo-hi] and the like (fixed values).
CITATION = "\\[\\s*(?:path\\s*=\\s*)?(?:([\"'`])([^\\s\\]:\"'`/]+(?:/[^\\s\\]:\"'`/]+)*)\\1|([^\\s\\]:\"'`/]+(?:/[^\\s\\]:\"'`/]+)*))\\s*:\\s*(\\d+)\\s*-\\s*(\\d+)\\s*\\]"


def language_of(path: Column) -> Column:
    """Language by the lower-cased suffix; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    return F.element_at(table, suffix)


def module_fqn(path: Column) -> Column:
    """Dotted module name of a path; a trailing __init__ names its package, the root's one is ''."""
    dotted = F.translate(F.regexp_replace(path, r"\.[^./]+$", ""), "/", ".")
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def unresolved(name: Column) -> Column:
    return F.concat(F.lit("<unresolved:"), name, F.lit(">"))


def is_unresolved(name: Column) -> Column:
    return name.startswith("<unresolved:") & name.endswith(">")


def leaf(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def parent(fqn: Column) -> Column:
    """All but the last segment; null where there is only one."""
    return F.when(fqn.contains("."), F.regexp_replace(fqn, r"\.[^.]*$", ""))


def head(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", 1)


def rest(dotted: Column) -> Column:
    """What follows the first dot; '' if there is none."""
    return F.when(dotted.contains("."), F.expr("substring({0}, locate('.', {0}) + 1)".format(_sql(dotted)))).otherwise(F.lit(""))


def _sql(c: Column) -> str:
    return c._jc.toString()


def tokens(text: Column) -> Column:
    """ASCII words in lower case, longer than one character and not all digits; null counts as empty."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))


def chunk_id(repo: Column, path: Column, start: Column, end: Column, text: Column) -> Column:
    span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    return F.sha1(F.concat_ws("|", repo, path, span, text))


def symbol_in(question: Column) -> Column:
    """The first of: a dotted name, a name before a parenthesis, a snake_case name; null if the question holds none."""
    tiers = [r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)\b", r"\b([A-Za-z_]\w*)\s*\(", r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"]
    found = [F.regexp_extract(question, t, 1) for t in tiers]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def citations(text: Column) -> Column:
    """array<struct<path,lo,hi>> of the citations in a text, in order, as written; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    group = [F.regexp_extract_all(t, F.lit(CITATION), F.lit(k)) for k in (2, 3, 4, 5)]
    z = F.arrays_zip(*[g.alias(n) for g, n in zip(group, ("q", "p", "a", "b"))])
    one = lambda x: F.struct(
        F.when(x["q"] != "", x["q"]).otherwise(x["p"]).alias("path"), x["a"].cast("bigint").alias("lo"), x["b"].cast("bigint").alias("hi")
    )
    return F.transform(z, one)


def valid_citations(text: Column) -> Column:
    """`citations` with 0 < lo <= hi, the first of each (path, lo, hi) only."""
    return F.array_distinct(F.filter(citations(text), lambda c: (c.lo > 0) & (c.hi >= c.lo)))


def fenced_json(raw: Column) -> Column:
    """From the first brace to the last of a model's answer, code fences or not; null if there is none."""
    got = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(got != "", got)


def route_of(raw: Column) -> Column:
    """struct<route, confidence, reason> of a model's answer; an unknown route is hybrid; null if there is no JSON."""
    j = F.from_json(fenced_json(raw), "route string, confidence double, reason string")
    known = j.route.isin("graph", "hybrid", "community")
    ok = j.route.isNotNull() | j.confidence.isNotNull() | j.reason.isNotNull()
    return F.when(
        ok,
        F.struct(
            F.when(known, j.route).otherwise("hybrid").alias("route"),
            F.coalesce(j.confidence, F.lit(0.5)).alias("confidence"),
            F.when(F.coalesce(j.reason, F.lit("")) == "", "llm").otherwise(j.reason).alias("reason"),
        ),
    )


def cache_key(repo: Column, version: Column, question: Column, hint: Column, top_k: Column, model: Column) -> Column:
    """sha256 of the six fields joined by U+001F; the question is stripped and a missing hint is `auto`."""
    strip = F.regexp_replace(F.coalesce(question, F.lit("")), r"^\s+|\s+$", "")
    fields = [F.coalesce(repo, F.lit("")), F.coalesce(version, F.lit("")), strip, F.coalesce(hint, F.lit("auto")), F.coalesce(top_k.cast("string"), F.lit("")), F.coalesce(model, F.lit(""))]
    return F.sha2(F.concat_ws("\u001f", *fields), 256)


def repo_version(head_sha: Column, last_indexed_at: Column) -> Column:
    return F.concat(F.coalesce(head_sha, F.lit("")), F.lit(":"), last_indexed_at.cast("string"))


def permalink(base: Column, repo: Column, sha: Column, path: Column, lo: Column, hi: Column) -> Column:
    """A link to lines of a file at a commit; '' without a commit."""
    url = F.concat(base, F.lit("/"), repo, F.lit("/blob/"), sha, F.lit("/"), path, F.lit("#L"), lo.cast("string"), F.lit("-L"), hi.cast("string"))
    return F.when(F.coalesce(sha, F.lit("")) == "", F.lit("")).otherwise(url)


def command_after_mention(body: Column, login: str) -> Column:
    """What follows the first mention of @login, without leading :,- and blanks; null if nothing does."""
    got = F.regexp_extract(F.coalesce(body, F.lit("")), rf"(?is)@{login}\b(.*)$", 1)
    got = F.regexp_replace(F.regexp_replace(got, r"^[\s:,\-]+", ""), r"\s+$", "")
    return F.when(got != "", got)


def render_chunk(path: Column, lo: Column, hi: Column, symbol: Column, text: Column) -> Column:
    name = F.when(symbol.isNotNull(), F.concat(F.lit(' symbol="'), symbol, F.lit('"'))).otherwise(F.lit(""))
    return F.concat(F.lit('<retrieved_chunk path="'), path, F.lit('" lines="'), lo.cast("string"), F.lit("-"), hi.cast("string"), F.lit('"'), name, F.lit(">\n"), text, F.lit("\n</retrieved_chunk>"))


def truncate_lines(text: Column, most: int = 80) -> Column:
    """The first lines of a text, with a marker if any were left out."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    left = F.size(lines) - most
    return F.when(left <= 0, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n... ("), left.cast("string"), F.lit(" more lines)")))


def parse_summary(raw: Column, most_title: int = 80) -> Column:
    """struct<title, summary> of a model's answer; without JSON that holds a summary, the whole text, with its first line as title."""
    j = F.from_json(fenced_json(raw), "title string, summary string")
    whole = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    first = F.substring(F.substring_index(whole, "\n", 1), 1, most_title)
    has = F.coalesce(j.summary, F.lit("")) != ""
    return F.struct(F.when(has, F.coalesce(j.title, F.lit(""))).otherwise(first).alias("title"), F.when(has, j.summary).otherwise(whole).alias("summary"))


def without_provider(model: Column, prefix: str = "ollama") -> Column:
    """A model's name without the prefix of a local provider."""
    return F.regexp_replace(model, f"^{prefix}[:/]", "")


def has_provider(model: Column, prefix: str = "ollama") -> Column:
    return F.coalesce(model.rlike(f"^{prefix}[:/]"), F.lit(False))
