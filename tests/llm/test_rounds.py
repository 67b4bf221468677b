"""Leaders of buckets: a crowd that shares a passage costs about one pair per member and bucket, however other groups go on."""

import numpy as np

from pixelmill.llm import near_duplicates


def test_crowd_forms_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    own = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    passage, base = own(60), own(150)
    texts = [" ".join([*own(60), *passage, *own(30)]) for _ in range(250)]
    texts += [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 150, 10)]
    pair = own(40)  # part of the crowd, and alike
    texts += [" ".join([*pair, *passage, f"y{k}"]) for k in range(2)]
    formed, entries = [], []
    with_texts, shared = near_duplicates.with_texts, near_duplicates.shared_buckets

    def counted(pairs, texts):
        formed.append(pairs.count())
        return with_texts(pairs, texts)

    def seen(nodes):
        entries.append((found := shared(nodes)).count())
        return found

    monkeypatch.setattr(near_duplicates, "with_texts", counted)
    monkeypatch.setattr(near_duplicates, "shared_buckets", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()}
    assert {k: v for k, v in got.items() if k != v} == {**dict.fromkeys(range(251, 265), 250), 266: 265}
    assert sum(formed) <= entries[0], (formed, entries)


def left_over(spark, monkeypatch, texts):
    """Texts that the exact filter gets, and the class of every text."""
    got = set()
    rare = near_duplicates.rare_pairs

    def seen(left, held):
        got.update(r.text for r in left.join(held, "node").collect())
        return rare(left, held)

    with monkeypatch.context() as m:
        m.setattr(near_duplicates, "rare_pairs", seen)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        return got, {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()}


def test_what_crowds_leave_does_not_hang_on_other_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    own = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    crowds = []
    for _ in range(6):
        passage = own(60)
        crowds += [" ".join([*own(40), *passage]) for _ in range(4)]
    copies = []
    for k in range(8):
        base = own(100)
        copies += [" ".join(base), " ".join([*base[:50], f"x{k}", *base[51:]])]
    few, of_few = left_over(spark, monkeypatch, crowds)
    many, of_many = left_over(spark, monkeypatch, [*crowds, *copies])
    assert few and few == many, (len(few), len(many))
    assert of_few == {k: k for k in range(24)}
    assert of_many == {k: k if k < 24 else k - k % 2 for k in range(40)}


def test_a_compared_pair_is_not_left_open(spark, monkeypatch):
    rng = np.random.default_rng(5)
    own = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    texts = []
    for _ in range(12):
        passage = own(60)
        texts += [" ".join([*own(40), *passage]) for _ in range(2)]
    left, found = left_over(spark, monkeypatch, texts)
    assert not left and found == {k: k for k in range(24)}
