import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from millrace.llm import subjects as S
from millrace.llm.subjects import Params, document_subjects, sentences

TERMS = {"law": "court verdict plaintiff statute appeal clause".split(), "music": "violin orchestra melody chord tempo choir".split()}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    docs, labels, truth = [], [], {}
    for i in range(300):
        kind = rng.choice(["law", "music", "both", "none"])
        ss = []
        for k in range(8):
            s = {"law": "law", "music": "music", "both": ["law", "music"][k % 2], "none": None}[kind]
            w = rng.sample(TERMS[s], 2) if s else ["queue", "cache"]
            ss.append(f"The {w[0]} table keeps a {rng.choice(['red', 'blue', 'late', 'open'])} link to each {w[1]} in the run_{k}() view.")
        docs.append((i, "# head\n\n" + " ".join(ss) + "\n\n```\nviolin violin violin.\n```\n"))
        truth[i] = {"both": {"law", "music"}, "none": {"software"}}.get(kind, {kind})
        if i % 3 == 0:
            labels += [(i, s, 1) for s in truth[i]]
    docs += [(900, " \n"), (901, None), (902, "Heading only"), (903, "The court met. " * 20_000)]
    areas = spark.createDataFrame([("law", ""), ("music", ""), ("software", ""), ("sport", ""), (None, "")], "subject string, description string")
    labels = labels + labels[:3] + [(1, "unknown", 1), (99999, "law", 1), (None, "law", 1), (2, None, 1)]
    ddf = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as lang", "2 as mix")
    return ddf, spark.createDataFrame(labels, "doc_id bigint, subject string, annotator_id int"), areas, truth


def found(out):
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    return got


def right(got, truth):
    held = [i for i in truth if i % 3]
    return sum(got[i] == truth[i] for i in held) / len(held)


def test_subjects(corpus):
    ddf, ldf, areas, truth = corpus
    got = found(document_subjects(ddf, ldf, areas, params=Params(leaves=8)))
    assert right(got, truth) >= 0.9
    assert 900 not in got and 901 not in got and got[902] == {"software"} and got[903] == {"law"}
    assert document_subjects(ddf.limit(0), ldf, areas).count() == 0
    assert {r.subject for r in document_subjects(ddf, ldf.limit(0), areas).collect()} == {"software"}


def test_leaves_decide(corpus, monkeypatch):
    """One leaf in place of all leaves nothing to tell subjects apart by: labels reach documents through leaves only."""
    ddf, ldf, areas, truth = corpus
    fit = S.fit_leaves

    def one(sample, p):
        v = fit(sample, p)
        mean = {g: c.mean(0, keepdims=True) for g, c in v.centres.items()}
        return S.Leaves(v.stops, v.idf, mean, {g: i for i, g in enumerate(mean)}, len(mean), v.near)

    monkeypatch.setattr(S, "fit_leaves", one)
    assert right(found(document_subjects(ddf, ldf, areas, params=Params(leaves=8))), truth) < 0.5


def test_more_labels_than_are_read(corpus):
    """Beyond `labelled` documents a sample by hash is read; nothing is refused."""
    ddf, ldf, areas, truth = corpus
    got = found(document_subjects(ddf, ldf, areas, params=Params(leaves=8, labelled=60, sample=150)))
    assert right(got, truth) >= 0.9


def test_many_labels(spark, corpus):
    ddf, ldf, areas, truth = corpus
    many = spark.range(1_000_000, 1_300_000).selectExpr("id as doc_id", "'law' as subject", "1 as annotator_id")
    got = found(document_subjects(ddf, ldf.unionByName(many), areas, params=Params(leaves=8, labelled=400_000)))
    assert right(got, truth) >= 0.9


def test_all_documents_and_labels_count(spark):
    """A subject that only some documents have, none of them in a sample of 8,000 by hash: every document and label takes part."""
    rng = random.Random(7)
    # what a sample of about 8,000 of these documents, and of as many labels, would leave out
    ids = spark.range(9_000).selectExpr("id", "pmod(xxhash64(id), 2) <> 0 AND pmod(xxhash64(id, 11), 2) <> 0 AS out").collect()
    docs, labels, truth = [], [], {}
    for i, out in ids:
        s = "music" if out else "law" if i % 2 else None
        w = [rng.sample(TERMS[s], 2) if s else ["queue", "cache"] for _ in range(4)]
        docs.append((i, " ".join(f"The {a} table keeps a {rng.choice(['red', 'blue', 'late'])} link to each {b}." for a, b in w)))
        truth[i] = {s or "software"}
        labels.append((i, s or "software", 1))
    areas = spark.createDataFrame([("law", ""), ("music", ""), ("software", "")], "subject string, description string")
    got = found(document_subjects(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject string, annotator_id int"), areas))
    music = [i for i in truth if truth[i] == {"music"}]
    assert len(music) > 2_000 and sum(got[i] == {"music"} for i in music) / len(music) >= 0.9


def test_weights_and_mixtures():
    number = lambda w: S._digest(w) ^ int(S._SALT[1])
    w = S.weigh(np.array([[9.0, 0, 0], [3, 3, 3], [0, 0, 9], [5, 0, 50]]), np.array([[10.0, 10, 10]] * 4))
    assert w[0].argmax() == 0 and w[0, 0] > 1 and not w[1].any() and w[2].argmax() == 2 and w[3, 0] == 0
    b = S._parse_texts([1, 2, 3], ["The court heard the court. A court met.", "The court met the violin.", "Not a thing."])
    x = S._Batch(b)
    assert list(x.langs) == ["en"] * 3 and x.n_sent.tolist() == [2, 1, 1]
    m = S.Mixtures(np.array([[1.0, 0, 0], [0, 1, 0]]), np.array([number("court"), number("violin")]), np.array([0, 1]))
    got = m.of_documents(x, np.zeros((3, 1), int), np.ones((3, 1)))
    assert got.tolist() == [[1, 0, 0], [0, 0, 1], [0, 0, 1]]  # one term once is not enough


def test_parsing():
    b = S._parse_texts([1, 2], ["", "Der fooBar_bazQux2 ist HTTPServer. 3 x."])
    x = S._Batch(b)
    want = {S._digest(w) ^ int(S._SALT[S._LANGS.index("de")]) for w in ("der", "foo", "bar", "baz", "qux", "ist", "httpserver")}
    assert x.n_sent.tolist() == [0, 1] and set(x.ids.tolist()) == want
    assert pa.types.is_string(b.schema.field("lang").type) and b.column("lang").to_pylist() == ["", "de"]
    assert sentences("# a.\nOne two. Three!\nno end\n```\ncode.\n```\n- four?") == ["One two.", "Three!", "- four?"]


def test_words_are_cut_once_a_piece(monkeypatch):
    """What regular expressions cut grows with the distinct pieces of a batch, not with its text; the words are those of whole sentences."""
    read, split = [], S._split

    def counted(v, *rest):
        read.append(pc.sum(pc.binary_length(v)).as_py() or 0)
        return split(v, *rest)

    monkeypatch.setattr(S, "_split", counted)
    texts = ["The fooBar_baz2qux run() of x.y met 12a violins, a\u00a0court and\tthe ÉCOLE. Then  the court met."] * 500
    S._parse_texts(list(range(500)), texts)
    assert len(read) == 2 and sum(read) < 0.1 * sum(map(len, texts))
    rng = random.Random(2)
    odd = ["".join(rng.choice("abAÉßǅ09٣ .,\t\u00a0\x01`_/(") for _ in range(rng.randrange(1, 80))) for _ in range(2_000)]
    of, code, words = S._terms(pa.array(odd, pa.large_string()))
    got = [set() for _ in odd]
    for i, w in zip(of, code):
        got[i].add(words[w])
    assert len(of) == sum(map(len, got)) and (np.diff(of) >= 0).all()
    spaced = pc.utf8_lower(pc.replace_substring_regex(pa.array(odd), r"(\p{Ll})(\p{Lu})", r"\1 \2"))
    assert got == [{w for w in ws if len(w) > 1} for ws in pc.split_pattern_regex(spaced, r"\PL+").to_pylist()]


def test_vectors_and_openings():
    """Numbers of any size come back from the bytes they take; openings are found as rows of three."""
    for most in (0, 255, 256, 65_536):
        f, n = np.array([3, 0, most]), np.array([1, most, 2])
        rows = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *(pa.array([v]) for v in (np.array([2, 1], np.int32).tobytes(), S._narrow(f), S._narrow(n)))], names=["lang", "lens", "f", "n"])
        ((g, *got),) = S._vectors([rows])
        assert g == 1 and [v.tolist() for v in got] == [[2, 1], f.tolist(), n.tolist()]
    rng = np.random.default_rng(4)
    words, rows = np.arange(0, 60, 3), rng.integers(0, 20, (900, 3))
    keys, inv = S._distinct_rows(rows, 20)
    assert (keys[inv] == rows).all() and len(keys) == len(set(map(tuple, rows.tolist())))
    some = words[rows[:300]] + rng.integers(0, 2, (300, 1))
    known = set(map(tuple, some.tolist()))
    assert S._Openings(some).has(words, rows).tolist() == [tuple(r) in known for r in words[rows].tolist()]
    assert not S._Openings(np.zeros((0, 3), np.int64)).has(words, rows).any()
