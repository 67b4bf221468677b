"""Queries without SQL against plain versions: secrets, weak supervision, and the pipeline as a whole."""

import collections
import hashlib
import itertools
import math
import re

import duckdb
import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from pixelmill.llm import language, near_duplicates, pieces, secrets_crf, weak_quality
from tests.llm.test_llm import brute_lines

SF = "/root/testdata/sf0.001"


# ---- secrets

def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets_of_the_whole_table(spark):
    larger = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    rows = entry.queries()["op8_secrets"](spark, larger).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and any(r.n_assign + r.n_access + r.n_hex for r in rows)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert ",".join(":".join(s) for s in spans if s[0] != "crf") == text and r.n_added == sum(s[0] == "crf" for s in spans)
        own = [(int(a), int(b)) for k, a, b in spans if k == "crf"]
        assert all(0 <= a < b <= len(texts[r.doc_id]) and not any(x < b and a < y for x, _, y in base) for a, b in own)


def total(tags, scores, change):
    s = sum(scores[k][t - 1] if t else 0.0 for k, t in enumerate(tags)) + sum(change[a][b] for a, b in itertools.pairwise(tags))
    return s + (secrets_crf.FORBIDDEN if tags[0] == 2 else 0.0)


def test_viterbi_against_all_taggings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 7):
        for _ in range(20):
            change = rng.normal(size=(3, 3))
            change[0, 2] = secrets_crf.FORBIDDEN
            scores = rng.normal(size=(n, 2)) * 2
            best = max(itertools.product(range(3), repeat=n), key=lambda t: total(t, scores, change))
            got = secrets_crf.Field(np.zeros((1, 2)), change).viterbi(scores)
            assert abs(total(got, scores, change) - total(best, scores, change)) < 1e-9 and not any(a == 0 and b == 2 for a, b in itertools.pairwise(got))


def likelihood(field, features, tags):
    """Mean log likelihood of chains by summing over all taggings."""
    out = 0.0
    for f, y in zip(features, tags):
        scores = field.scores(f)
        every = [total(t, scores, field.change) for t in itertools.product(range(3), repeat=len(y))]
        top = max(every)
        out += total(list(y), scores, field.change) - top - math.log(sum(math.exp(e - top) for e in every))
    return out / len(tags)


def test_field_climbs_the_likelihood_of_all_taggings():
    rng = np.random.default_rng(2)
    tags = [np.array(t) for t in ([0, 1, 2, 0], [1, 2, 2], [0, 0, 1], [0, 0, 0, 0, 1], [1])] * 3
    features = [np.stack([rng.integers(0, 4, len(y)) * 3 + y] + [secrets_crf._AT[g] + rng.integers(0, 2, len(y)) for g in list(secrets_crf.GROUPS)[1:]], 1) for y in tags]
    steps = [likelihood(secrets_crf.train(features, tags, steps=n), features, tags) for n in (0, 1, 3, 10, 40)]
    assert all(a < b for a, b in itertools.pairwise(steps)) and steps[-1] > -0.1


# ---- weak supervision

def plain_posteriors(votes):
    """Expectation-maximisation over single rows."""
    n = len(votes[0])
    odds_of = lambda v, model: model["prior"] + sum(model[k, x] for k, x in enumerate(v))
    q, last, model = [1 / (1 + math.exp(-sum(v))) for v in votes], None, None
    for _ in range(weak_quality.STEPS):
        good, bad = sum(q), sum(1 - x for x in q)
        model = {"prior": math.log((good + 1) / (bad + 1))}
        for k in range(n):
            for x in (-1, 0, 1):
                g = sum(p for p, v in zip(q, votes) if v[k] == x)
                b = sum(1 - p for p, v in zip(q, votes) if v[k] == x)
                model[k, x] = math.log(((g + 1) / (good + 3)) / ((b + 1) / (bad + 3)))
        if last and all(abs(model[k] - last[k]) < weak_quality.SETTLED for k in model):
            break
        q, last = [1 / (1 + math.exp(-odds_of(v, model))) for v in votes], model
    return lambda v: 1 / (1 + math.exp(-odds_of(v, model)))


def test_posteriors_against_rows_one_by_one(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    names = list(weak_quality.rules())
    rows = weak_quality.judge(given).collect()
    votes = [tuple(r[c] for c in names) for r in rows]
    posterior = plain_posteriors([v for v, r in zip(votes, rows) if not r.base_failed])
    assert len(set(votes)) > 5
    for v, r in zip(votes, rows):
        assert abs(r.quality - posterior(v)) < 1e-6 and r.kept == (not r.base_failed and r.quality >= 0.5)


# ---- the pipeline

def plain_pipeline(rows):
    """(doc_id, copies) and texts by plain versions of the first four stages, from (doc_id, text, lang, source)."""
    model = corpus_pipeline.language.Model(*MODEL)
    lang, score = model.score([t for _, t, _, _ in rows])
    rows = [r for r, x, p in zip(rows, lang, score) if x != "und" and p >= corpus_pipeline.SURE]
    texts = brute_lines([(i, t) for i, t, _, _ in rows])
    changed = {i for i, t, _, _ in rows if texts[i] != t}
    rows = [(i, texts[i], x, s) for i, _, x, s in rows if i not in changed or texts[i].strip(" \t\n\r\f\v")]
    ids = {i: near_duplicates.shingles(near_duplicates.word_hashes(t)) for i, t, _, _ in rows}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        if near_duplicates.similarity(ids[a], ids[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


MODEL = None


def test_pipeline_against_plain_stages(spark, tmp_path):
    global MODEL
    real = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None and len(r.text) < 4000][:110]
    rows = [tuple(r) for r in real]
    rows += [(1000 + k, r.text + " one more word", r.lang, r.source, len(r.text)) for k, r in enumerate(real[:8])]
    rows += [(1100 + k, real[20 + k].text + "\n" + real[9].text + "\n" + real[10].text, real[0].lang, "src0", 1) for k in range(4)] + [(1200, "123 456", None, None, 7)]
    given = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    given.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    fitted = language.fit(docs.filter(~language.held_out(docs["doc_id"])))
    MODEL = (fitted.langs, fitted.priors, fitted.matrix)
    kept = plain_pipeline([(r[0], r[1], r[2], r[3]) for r in rows])
    assert 60 < len(kept) < len(rows) - 5

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", kept)
    copies = {i: taken // size if size else 0 for i, size, _, _, taken in con.execute(entry.oracle_sql()["op9_mixing"]).fetchall()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    count = collections.Counter(r.doc_id for r in got)
    texts = {i: t for i, t, _, _ in kept}
    sized = {i for i, t in texts.items() if t.split()}
    assert {i: count[i] for i in sized} == {i: copies[i] for i in sized} and set(count) <= set(texts)
    vocabulary = pieces.Vocabulary()
    assert all(r.lossless and r.n_tokens == len(r.ids) and pieces.decode_ids(vocabulary, np.array(r.ids, np.int64)) == texts[r.doc_id] for r in got)
    by_source = collections.defaultdict(list)
    for r in got:
        by_source[r.doc_id].append(r.ids)
    assert any(len(x) == 2 and x[0] != x[1] for x in by_source.values())
