"""Which source files are hand-written, and which are generated, minified, vendored or data blobs.

Every chunk gives evidence (comment markers, line shapes, literals, numbered names, word shingles shared with known upstream
files), which is added up per file and graded as log-odds. Labels are then inferred by belief propagation (sum-product) over the
directory tree of each repository: a file holds its evidence, and a directory favours like labels among its children and with
its parent. A file that names its tool or its origin, or is plainly data, is decided by itself; one with weak signs or none is
decided with its neighbours. A tree needs one pass up and one down; each pass is one aggregation per level of depth, so a
repository of any size is never held in one task.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
SHINGLE, SIMILAR = 5, 0.8
#: Suffixes of programming languages; other files are settings or prose (fixed values).
CODE = (".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".go", ".java", ".c", ".h", ".cpp", ".rs", ".rb", ".php", ".cs", ".kt", ".swift", ".scala")

_WORDS = re.compile(r"\w+")
_COMMENT = re.compile(r"^\s*(?:#|//|/\*+!?|\*|--|<!--)\s?(.*)$")
_GENERATED = re.compile(
    r"(?i)\b(?:code generated by\b.*do not edit|@generated\b|auto-?generated\b(?! by hand)|machine[- ](?:written|generated|made)\b|(?:this file (?:was|is)|file) (?:produced|generated|created|emitted|written) (?:automatically )?by \S|generated (?:by|from|on build|automatically)\b|produced by \S+; changes are lost|(?:manual|hand)[- ]?(?:edits|changes) (?:will be|are) (?:overwritten|lost)|do not (?:edit|modify)(?: by hand)?\b.*(?:generat|regenerat|overwrit)|<auto-generated\b)"
)
_VENDORED = [
    re.compile(p, re.I)
    for p in (
        r"^!?@package\s+(?P<p>[\w@/.-]+?)@v?\d",
        r"^!?part of (?P<p>[\w./-]+) v?\d[\w.]*",
        r"^!?(?P<p>[\w./-]+) v?\d+\.\d+(?:\.\d+)?\s*(?:\||$|-|\()",
        r"^!?copyright \(c\)(?: [\d, -]+)? (?:the )?(?P<p>[\w./-]+) (?:authors|contributors|project|developers|foundation)\b",
        r"^!?released by the (?P<p>[\w./-]+) (?:maintainers|authors|project)\b",
        r"\bupstream (?:home|source|url)\s*:\s*(?:https?://)?(?P<p>[\w-]+)",
        r"\b(?:vendored|copied|imported|taken|adapted) (?:verbatim )?from (?:the )?(?P<p>[\w.-]+)(?: project| package| library)? v?\d",
    )
]
_ORIGIN = re.compile(r"^\s*(?:(?:const|let|var|export const)\s+)?__?(?:package_)?origin__?\s*(?::=|=)\s*[\"'](?P<p>[\w./-]+)[\"']", re.I)


#: A notice in the name of a team is a repository's own.
_OWN_TEAM = re.compile(r"(?i)\bteam\W*$")


def own_name(package: str, repo: str | None) -> bool:
    flat = lambda x: re.sub(r"[^a-z0-9]", "", (x or "").lower())
    return flat(package) == flat(repo) or flat(package).startswith(flat(repo)) and len(flat(repo)) > 3


_STRING = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"\b\d[\w.]*")
_NUMBERED = re.compile(r"(?m)^.*?(?:[A-Za-z]_?\d{2,}\b|\[\d{2,}\]|number=\d+)")
_STATEMENT = re.compile(r"(?m)^\s*(?:async )?(?:def|class|func|function|return|if|for|while|try|switch|type|interface|with|raise|throw)\b|^\s*[^\s\"'\d\[(].*(?:=>|\)\s*\{?\s*$)")
_MARKS = re.compile(r"[;{}()=]")


def chunk_evidence(text: str, repo: str | None, shingles: dict[tuple, tuple[int, ...]]) -> dict:
    marker = origin = 0
    code = []
    for x in text.split("\n"):
        if not (y := x.strip()):
            continue
        if not y[0].isalnum() and (c := _COMMENT.match(x)):
            body = c[1].strip()
            if _GENERATED.search(body):
                marker = 1
            for p in _VENDORED:
                m = p.search(body)
                if m and not own_name(m["p"], repo) and not _OWN_TEAM.search(body):
                    origin = 1
        else:
            code.append(x)
            if "rigin" in x.lower() and (m := _ORIGIN.match(x)) and not own_name(m["p"], repo):
                origin = 1
    n_code = sum(map(len, code))
    # of long lines, those that are code without blanks, not one long text or number list
    dense = sum(len(x) for x in code if len(x) > 220 and x.count(" ") < 0.06 * len(x) and len(_MARKS.findall(x)) > 0.04 * len(x))
    joined = "\n".join(code)
    bare = _NUMBER.sub("0", _STRING.sub("S", joined))
    names = _IDENT.findall(bare)
    shapes = len({x.replace(" ", "") for x in _IDENT.sub("n", bare).split("\n")}) if code else 0
    words = _WORDS.findall(text)
    n_sh, best = max(0, len(words) - SHINGLE + 1), Counter()
    for w in zip(*(words[i:] for i in range(SHINGLE))):
        if w in shingles:
            best.update(shingles[w])
    return {
        "marker": marker,
        "origin": origin,
        "n_code": n_code,
        "dense": dense,
        "n_lines": len(code),
        "n_shapes": shapes,
        "numbered": len(_NUMBERED.findall(joined)),
        # letters of names; what is longer than names are is data
        "named": sum(len(x) for x in names if len(x) < 32) - names.count("S"),
        "statements": len(_STATEMENT.findall(joined)),
        "n_shingles": n_sh,
        "shared": max(best.values(), default=0),
    }


_FIELDS = ("marker", "origin", "n_code", "dense", "n_lines", "n_shapes", "numbered", "named", "statements", "n_shingles", "shared")


def _slope(x: np.ndarray, low: float, high: float, most: float) -> np.ndarray:
    """Log-odds that rise from 0 at low to `most` at high, and fall alike below, by half as much at most."""
    return np.clip((x - low) / (high - low), -0.5, 1) * most


def file_potentials(e: dict[str, np.ndarray], paths: list[str]) -> np.ndarray:
    """Log potentials (files x LABELS) from the files' summed evidence and their names. Evidence is graded: a file that names its
    tool or its origin needs no neighbours, one that only looks like the output of a tool is decided with those beside it."""
    low = [x.lower() for x in paths]
    code = np.array([x.endswith(CODE) for x in low], bool)
    n, lines = np.maximum(1, e["n_code"]), np.maximum(1, e["n_lines"])
    enough = np.minimum(1, e["n_code"] / 400)  # small files show less
    score = np.zeros((len(paths), len(LABELS)))
    score[:, 0] = np.where(code, HAND, HAND + 4)
    score[:, 1] = 7.0 * e["marker"]
    repeats, numbered = 1 - e["n_shapes"] / lines, e["numbered"] / lines
    score[:, 1] += np.where(code, enough * np.minimum(_slope(repeats, 0.3, 0.6, 6), _slope(numbered, 0.05, 0.5, 6)), 0)
    score[:, 1] += [1.0 * bool(_TOOL_NAME.search(x)) for x in low]
    score[:, 2] = np.where(code, enough * _slope(e["dense"] / n, 0.2, 0.6, 7), -4.0) + [0.5 * bool(_SMALL_NAME.search(x)) for x in low]
    score[:, 3] = 8.0 * e["origin"] + np.minimum(1, e["n_shingles"] / 8) * np.maximum(0, _slope(e["shared"] / np.maximum(1, e["n_shingles"]), SIMILAR / 2, SIMILAR, 9))
    literal = _slope(1 - e["named"] / n, 0.68, 0.88, 7) - 12 * np.minimum(0.5, e["statements"] / lines)
    score[:, 4] = np.where(code, enough * literal, -4.0)
    # lines of one literal repeat one shape; that is no sign of a tool
    score[:, 1] -= np.where(code & (literal > 3) & (e["marker"] == 0), np.maximum(0, score[:, 1]), 0)
    return score


_TOOL_NAME = re.compile(r"(?:_pb2?|\.pb|_gen|\.g|\.gen|\.generated|_generated)\.[a-z]+$|_pb2?_grpc\.")
_SMALL_NAME = re.compile(r"[._-](?:min|bundle)\.[a-z]+$")
#: Log-odds of a file without signs to be hand-written, before its neighbours are heard. It is less than LIKE, so that such a file
#: among copies or outputs of a tool counts as one of them.
HAND = 1.5
#: Log-odds that a child has its directory's label rather than another, and the same between directories.
LIKE = 1.7


def _send(belief: np.ndarray) -> np.ndarray:
    """Messages (rows x labels) through the compatibility of like labels, normalised."""
    k = len(LABELS)
    compat = np.full((k, k), 1.0)
    np.fill_diagonal(compat, math.exp(LIKE))
    b = np.exp(belief - belief.max(1, keepdims=True))
    out = np.log(b @ compat)
    return out - out.mean(1, keepdims=True)


_VEC = [f"b{i}" for i in range(len(LABELS))]


def _message(df: DataFrame, keep: list[str]) -> DataFrame:
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], *[f"{v} double" for v in _VEC]])

    def run(batches):
        for b in batches:
            m = _send(np.stack([b.column(v).to_numpy() for v in _VEC], 1)) if b.num_rows else np.zeros((0, len(_VEC)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(m[:, i]) for i in range(len(_VEC))]], names=[*keep, *_VEC])

    return df.select(*keep, *_VEC).mapInArrow(run, schema)


def _total(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col("parent").alias(key)).agg(*[F.sum(v).alias(v) for v in _VEC])


def propagate(files: DataFrame) -> DataFrame:
    """`files` (node, parent, b0..b4: log potentials) with beliefs in place of potentials. A directory's path names its
    parent; the root of a repository is a path without a slash."""
    up_files = written(_message(files.where("parent is not null"), ["node", "parent"]), "up")
    own = written(_total(up_files, "dir"), "dirs")
    deepest = own.agg(F.max(F.size(F.split("dir", "/"))).alias("d")).first().d
    if deepest is None:
        return files
    # every ancestor of a directory is a node as well
    parts = F.split("dir", "/")
    every = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir")).distinct()
    parent = F.when(F.col("dir").contains("/"), F.regexp_replace("dir", "/[^/]*$", "")).alias("parent")
    nodes = every.join(own, "dir", "left").select("dir", parent, F.size(F.split("dir", "/")).alias("depth"), *[F.coalesce(v, F.lit(0.0)).alias(v) for v in _VEC])
    nodes = written(nodes, "nodes")
    below = nodes.where(F.col("depth") == deepest)
    levels = {deepest: written(below, f"level{deepest}")}
    sent = {}
    for d in range(deepest, 1, -1):
        sent[d] = written(_message(levels[d], ["dir", "parent"]), f"sent{d}")
        add = _total(sent[d], "to")
        at = nodes.where(F.col("depth") == d - 1).join(add, F.col("dir") == F.col("to"), "left")
        at = at.select("dir", "parent", "depth", *[(nodes[v] + F.coalesce(add[v], F.lit(0.0))).alias(v) for v in _VEC])
        levels[d - 1] = written(at, f"level{d - 1}")
    full = levels[1]
    done = [full]
    for d in range(2, deepest + 1):
        up = sent[d].select(F.col("dir").alias("s_dir"), *[F.col(v).alias(f"s{v}") for v in _VEC])
        # what the parent says without what it heard from this child
        ask = up.join(sent[d].select("dir", "parent"), F.col("s_dir") == F.col("dir")).join(done[-1].select(F.col("dir").alias("p_dir"), *[F.col(v).alias(f"p{v}") for v in _VEC]), F.col("parent") == F.col("p_dir"))
        down = _message(ask.select("dir", *[(F.col(f"p{v}") - F.col(f"s{v}")).alias(v) for v in _VEC]), ["dir"])
        down = down.select(F.col("dir").alias("m_dir"), *[F.col(v).alias(f"m{v}") for v in _VEC])
        here = levels[d].join(down, F.col("dir") == F.col("m_dir")).select("dir", "parent", "depth", *[(F.col(v) + F.col(f"m{v}")).alias(v) for v in _VEC])
        done.append(written(here, f"full{d}"))
    all_dirs = done[0]
    for x in done[1:]:
        all_dirs = all_dirs.unionByName(x)
    p = all_dirs.select(F.col("dir").alias("p_dir"), *[F.col(v).alias(f"p{v}") for v in _VEC])
    ask = up_files.join(p, F.col("parent") == F.col("p_dir")).select("node", *[(F.col(f"p{v}") - F.col(v)).alias(v) for v in _VEC])
    down = _message(ask, ["node"]).select(F.col("node").alias("m_node"), *[F.col(v).alias(f"m{v}") for v in _VEC])
    return files.join(down, F.col("node") == F.col("m_node"), "left").select("node", "parent", *[(F.col(v) + F.coalesce(F.col(f"m{v}"), F.lit(0.0))).alias(v) for v in _VEC])


def label_files(chunks: DataFrame, upstream: DataFrame) -> DataFrame:
    """(repo, path, label, confidence) for every file in chunks (repo, path, text).

    Repeated chunks count once; null texts give no evidence; a null repo is a repository of its own; rows with a null path are
    left out. An empty file is handwritten. Empty tables give no rows; without upstream files only the other evidence counts.
    """
    known: dict[tuple, set[int]] = {}
    for r in upstream.where("text is not null").select("upstream_id", "text").toLocalIterator():  # a fixed table, as its problem states
        words = _WORDS.findall(r.text)
        for i in range(len(words) - SHINGLE + 1):
            known.setdefault(tuple(words[i : i + SHINGLE]), set()).add(r.upstream_id)
    shingles = {k: tuple(v) for k, v in known.items()}
    rows = chunks.where("path is not null").select("repo", "path", F.coalesce("text", F.lit("")).alias("text"))
    # repeated rows are equal texts at one place; their hash is enough to drop them
    rows = rows.dropDuplicates(["repo", "path", "text"])
    shape = "repo string, path string, " + ", ".join(f"{f} bigint" for f in _FIELDS)

    def look(batches):
        for b in batches:
            repos, paths, texts = (b.column(c).to_pylist() for c in ("repo", "path", "text"))
            es = [chunk_evidence(t, r, shingles) for t, r in zip(texts, repos)]
            yield pa.RecordBatch.from_arrays([b.column("repo"), b.column("path"), *[pa.array([e[f] for e in es], pa.int64()) for f in _FIELDS]], names=["repo", "path", *_FIELDS])

    sums = [F.max(f).alias(f) if f in ("marker", "origin") else F.sum(f).alias(f) for f in _FIELDS]
    per_file = rows.mapInArrow(look, shape).groupBy("repo", "path").agg(*sums)

    def potential(batches):
        for b in batches:
            pot = file_potentials({f: b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in _FIELDS}, b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("repo"), b.column("path"), *[pa.array(pot[:, i]) for i in range(len(_VEC))]], names=["repo", "path", *_VEC])

    pots = per_file.mapInArrow(potential, "repo string, path string, " + ", ".join(f"{v} double" for v in _VEC))
    # the root holds the repository; slashes in its name are no levels
    root = F.concat(F.when(F.col("repo").isNull(), "-").otherwise("+"), F.regexp_replace(F.coalesce("repo", F.lit("")), "/", ":"))
    node = F.concat(root, F.lit("/"), F.col("path"))
    pots = written(pots.select("repo", "path", node.alias("node"), F.regexp_replace(node, "/[^/]*$", "").alias("parent"), *_VEC), "potentials")
    beliefs = propagate(pots.select("node", "parent", *_VEC))
    top = F.greatest(*_VEC)
    z = sum((F.exp(F.col(v) - top) for v in _VEC), F.lit(0.0))
    label = F.lit(LABELS[0])
    for v, name in list(zip(_VEC, LABELS))[::-1]:
        label = F.when(F.col(v) == top, name).otherwise(label)
    out = beliefs.select(F.col("node").alias("b_node"), label.alias("label"), (1 / z).alias("confidence"))
    return pots.select("repo", "path", "node").join(out, F.col("node") == F.col("b_node")).select("repo", "path", "label", "confidence")
