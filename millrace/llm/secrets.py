"""Credentials in source code and settings: found through a trigram index, verified by regular expressions, masked in place."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.trigrams import TrigramIndex, required_trigrams

_NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|signing[_-]?key|license[_-]?key|licence[_-]?key|private[_-]?key|secret[_-]?key|auth[_-]?key|encryption[_-]?key|bearer|credentials?)"
_VALUE = r"[^\s\"'`]"
#: In comments, values end where code would go on.
_BARE = re.compile(r"[^\s\"'`<>(){}\[\],;\\]+")
#: Rules: name, pattern; the group `v` is the secret. Names are compared without regard to case.
RULES = {
    "private_key": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----",
    "url": r"[A-Za-z][\w+.-]*://[^\s:/@\"'`]*:(?P<v>[^\s/\"'`]+)@[\w.-]",
    "connection": r"(?:password|pwd)\s*=\s*(?P<v>[^;\"'`\s]+)\s*;|;\s*(?:password|pwd)\s*=\s*(?P<v2>[^;\"'`\s]+)",
    "header": r"(?:authorization|x-[a-z-]*(?:key|token))[\"'`]?\s*[:=,]\s*[\"'`]?(?:(?:basic|bearer|token)\s+)?(?P<v>[^\s\"'`]+)",
    "quoted": r"(?<![A-Za-z])(?P<k>[\w.-]*" + _NAME + r")(?:_?\d+)?[\"'`]?\]?\s*(?::\s*[A-Za-z_][\w.<>\[\]| ]*?)?\s*(?:=>|:=|==?|:|,)\s*(?:[A-Za-z]{0,3})(?P<q>\"\"\"|'''|[\"'`])(?P<v>(?:(?!(?P=q))[^\n])*)(?P=q)?",
    "plain": r"(?P<k>[\w.-]*" + _NAME + r")(?:_?\d+)?[\"']?\s*(?:=>|:=|=|:)\s*(?P<v>" + _VALUE + r"+)\s*(?:[#;].*)?$",
    "prose": r"\b(?:[\w-]*" + _NAME + r"|log[io]n|api key)\b(?P<v>[^\n]*)",
    "jwt": r"(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "vendor": r"(?P<v>\b(?:AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16})\b|\b(?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{30,}|\b(?:xoxa|xoxb|xoxp|xoxr|xoxs)-[A-Za-z0-9-]{10,}|\b[a-z]{2,4}(?:_live_|_test_|_prod_)[A-Za-z0-9]{16,})",
}
_CASED = {"private_key", "jwt", "vendor"}
_RE = {k: re.compile(p, 0 if k in _CASED else re.I) for k, p in RULES.items()}
#: Suffixes of settings files, where values stand without quotes (fixed values).
SETTINGS = (".env", ".ini", ".yaml", ".yml", ".toml", ".cfg", ".conf", ".properties", ".json")
#: Values that stand for a secret without being one (fixed values).
PLACEHOLDERS = re.compile(
    r"(?i)^(?:.*(?:change[_-]?me|replace[_-]?me|your[_-]|placeholder|redacted|dummy|example|insert[_-]|todo|fixme|none|null|undefined|secret[_-]?here|password[_-]?here).*|\W*|(.)\1+|x{3,}.*|\*+.*|<.*|\$.*[{(].*|\$[A-Z_]+|%[sd]|%\(.*|\{.*|env[:(.].*|vault[:(.].*|file:.*|ref\+.*|arn:.*)$"
)
_LOOKUP = re.compile(r"(?i)environ|getenv|process\.env|import\.meta\.env|vault|keyring|secrets?manager|get_secret|\$\{|\{\{")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_NOT_SECRET_NAME = re.compile(r"(?i)(?:^|[_.-])public[_.-]?\w*$|public(?=[A-Z])\w*$")
_COMMENT = re.compile(r"^\s*(?:#|//|/?\*|--|;|<!--)")
_TRAIL = re.compile(r"\s(?:#|//|/\*)\s.*$")


def looks_live(value: str) -> bool:
    """Whether a value looks made by a generator or by a person told to mix characters, rather than a word or a placeholder."""
    v = value.strip()
    if len(v) < 7 or " " in v or PLACEHOLDERS.match(v) or _UUID.match(v) or re.match(r"(?i)[a-z][\w+.-]*://", v) or v.startswith("data:"):
        return False
    upper, lower, digit = (bool(re.search(p, v)) for p in ("[A-Z]", "[a-z]", r"\d"))
    mark = bool(re.search(r"[^A-Za-z0-9]", v))
    if digit and (upper or lower):
        return bool(re.search(r"[A-Za-z].*\d|\d.*[A-Za-z]", v)) and not re.fullmatch(r"v?\d+(?:[.-]\d+)+[\w.-]*", v)
    if digit:
        return len(v) >= 12 and mark is False and len(set(v)) > 5
    if upper and lower and mark:
        # words in a row are a name, not a secret
        return len(v) >= 10 and not re.fullmatch(r"(?:[A-Z]?[a-z]{2,}[._/ -]?)+", v)
    if upper and not lower:
        return len(v) >= 16 and not mark and len(re.findall(r"[AEIOU]", v)) < 0.42 * len(v)
    if upper and lower:
        return len(v) >= 12 and len(re.findall(r"[a-z][A-Z]|[A-Z]{2}", v)) > 0.3 * len(v)
    return len(v) >= 16 and not mark and bool(re.search(r"[^aeiouy]{5}", v))


def _random_word(v: str) -> bool:
    """Stricter, for prose: several changes of kind among the characters."""
    if not looks_live(v) or len(v) < 8:
        return False
    kinds = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "m" for c in v]
    if set(kinds) <= {"u"}:
        return len(v) >= 16
    if set(kinds) <= {"l", "m"} or set(kinds) <= {"d", "m"} or re.fullmatch(r"[\w]+(?:\.\w+)*\(\)?", v) or re.fullmatch(r"(?:[a-z]+_)+[a-z\d]+|[A-Za-z]+\d{1,3}", v):
        return False
    return sum(a != b for a, b in zip(kinds, kinds[1:])) >= 3


#: A line of a key's body, bare or as a piece of a comment or of a joined string.
_KEY_LINE = re.compile(r"(?:\s|//\s|[#*>|\"'`(]|[+.,]\s*(?=[\"'`]))*(?P<v>[A-Za-z0-9+/=]+)(?:\\[nr])*[\s\"'`)+,;.\\]*$")
_KEY_HEAD = re.compile(r"[\s\"'`#*>|/]*[A-Za-z][A-Za-z-]*: ")
_KEY_REST = re.compile(r"[A-Za-z0-9+/=]{8,}(?:[A-Za-z0-9+/=]|\\[nr]| (?=[A-Za-z0-9+/=]{8}))*")
#: Of a key without an END line, lines of at least so many characters are body, and one shorter line after them.
_FULL_LINE = 16


def _key_block(lines: list[str], at: int) -> tuple[list[tuple[int, int, int]], int]:
    """Spans of the body of a private key, and the line after it. The key goes up to its END line, else up to the first line that
    is not body, as where the text is cut inside the key or only names the marker."""
    spans, col = [], _RE["private_key"].search(lines[at]).start()
    rest = lines[at][col:]
    head = re.match(r"-----BEGIN [^-]*-----", rest).end()
    end = rest.find("-----END")
    if end >= 0:
        return [(at, col + head, col + end)], at + 1
    if m := _KEY_REST.search(rest, head):
        spans.append((at, col + m.start(), col + m.end()))
    body = []
    for j in range(at + 1, len(lines)):
        stop = lines[j].find("-----END")
        line = lines[j] if stop < 0 else lines[j][:stop]
        m = _KEY_LINE.match(line)
        if m:
            body.append((j, m.start("v"), m.end("v")))
        if stop >= 0:
            return spans + body, j + 1
        if not (m or line.strip(" \t\r\"'`#*>|/") == "" or _KEY_HEAD.match(line)):
            break
    after = at + 1
    for j, a, z in body:
        full = z - a >= _FULL_LINE
        if not full and (after == at + 1 or not re.search(r"[A-Z0-9+/=]", lines[j][a:z])):
            break
        spans.append((j, a, z))
        after = j + 1
        if not full:
            break
    return spans, after


def find_secrets(text: str, settings: bool, rules: set[str] | None = None) -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """(line, rule, spans to mask) of each secret; lines count from 1, spans are (line index, from, until)."""
    rules = set(RULES) if rules is None else rules
    out: dict[int, tuple[str, list]] = {}
    lines = text.split("\n")
    after = 0
    for i, line in enumerate(lines):
        if i < after:
            continue
        if "private_key" in rules and _RE["private_key"].search(line):
            spans, after = _key_block(lines, i)
            out[i] = ("private_key", spans)
            continue
        comment = bool(_COMMENT.match(line))
        for rule in ("url", "connection", "header", "quoted", "plain", "jwt", "vendor", "prose"):
            if rule not in rules or i in out and rule in ("prose", "jwt", "vendor"):
                continue
            if rule == "plain" and not (settings or comment) or rule == "prose" and not (comment or _TRAIL.search(line)):
                continue
            scan, base = line, 0
            if rule == "prose" and not comment:
                base = _TRAIL.search(line).start()
                scan = line[base:]
            for m in _RE[rule].finditer(scan):
                g = m.groupdict()
                name = "v" if g.get("v") is not None else "v2"
                value, a, z = g.get(name) or "", base + m.start(name), base + m.end(name)
                if rule == "prose":
                    words = [w for w in re.finditer(r"[^\s,;'\"`]+", value) if _random_word(w[0].strip(".:()"))]
                    if not words or _LOOKUP.search(value) and "until" not in value and "move" not in value:
                        continue
                    a, z = a + words[0].start(), a + words[0].end()
                    value = words[0][0]
                elif rule == "url":
                    if PLACEHOLDERS.match(value) or len(value) < 4 or re.fullmatch(r"[a-z]{1,9}", value):
                        continue
                elif not looks_live(value) or g.get("k") and _NOT_SECRET_NAME.search(g["k"]):
                    continue
                if rule == "plain" and not settings and not _BARE.fullmatch(value):
                    continue
                spans = [(i, a, z)]
                if rule == "quoted":
                    # pieces joined by + belong to the same secret
                    more = re.compile(r"\s*\+\s*[\"'`]([^\"'`\n]*)[\"'`]")
                    end = m.end()
                    while n := more.match(line, end):
                        spans.append((i, n.start(1), n.end(1)))
                        end = n.end()
                old = out.get(i)
                out[i] = (old[0] if old else rule, (old[1] if old else []) + spans)
    return [(i + 1, rule, spans) for i, (rule, spans) in sorted(out.items())]


def redact(text: str, found: list[tuple[int, str, list[tuple[int, int, int]]]]) -> str:
    """The text with every character of the secrets replaced by a star; length, lines, quotes and keys stay."""
    lines = text.split("\n")
    for _, _, spans in found:
        for i, a, z in spans:
            lines[i] = lines[i][:a] + "*" * (z - a) + lines[i][z:]
    return "\n".join(lines)


_FOUND = "chunk_id string, lines array<int>, rules array<string>, masked string"


def scan(chunks: DataFrame) -> DataFrame:
    """`_FOUND` for the rows of chunks (chunk_id, path, text) that hold secrets. Each batch of rows is indexed by trigrams, the
    lists that a rule requires are intersected, and the rule's expression runs on those rows only."""
    queries = {k: required_trigrams(p, re.I) for k, p in RULES.items()}
    wanted = {g for q in queries.values() for c in q for g in c}

    def run(batches):
        for b in batches:
            ids, paths, texts = (b.column(c).to_pylist() for c in ("chunk_id", "path", "text"))
            index = TrigramIndex(texts, wanted)
            rules: dict[int, set[str]] = {}
            for rule, q in queries.items():
                for row in index.rows(q):
                    rules.setdefault(row, set()).add(rule)
            out = []
            for row in sorted(rules):
                text = texts[row]
                found = find_secrets(text, (paths[row] or "").lower().endswith(SETTINGS), rules[row]) if text else []
                if found:
                    out.append((ids[row], [f[0] for f in found], [f[1] for f in found], redact(text, found)))
            cols = list(zip(*out)) or [()] * 4
            types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["chunk_id", "lines", "rules", "masked"])

    rows = chunks.where(F.col("text").isNotNull() & F.col("chunk_id").isNotNull()).select("chunk_id", "path", "text")
    return rows.mapInArrow(run, _FOUND)


def detect(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, texts) for chunks (chunk_id, path, text).

    places: chunk_id, line_no, rule; one row per chunk and line. texts: chunk_id, text, with the secrets masked, of the chunks that
    have any. Null texts and rows without an id have no secrets; repeated rows give each place once; a chunk id with several
    texts gets the places of each; empty tables give no rows.
    """
    hits = scan(chunks)
    at = F.explode(F.arrays_zip("lines", "rules")).alias("x")
    places = hits.select("chunk_id", at).select("chunk_id", F.col("x.lines").alias("line_no"), F.col("x.rules").alias("rule")).groupBy("chunk_id", "line_no").agg(F.min("rule").alias("rule"))
    texts = hits.select("chunk_id", F.col("masked").alias("text")).distinct()
    return places, texts
