"""Each operator against brute force on a small table with awkward rows."""

import itertools
import math
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from biorec.llm import dedup, jaccard, langid, licenses, mixing, pieces, tokens, topk, toxicity, urls
from biorec.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, sid string, fold string, digest string, path string"
LONG = " ".join(f"w{i * i % 997}" for i in range(4000))
BASE = " ".join(f"base{i}" for i in range(60))
NEAR = [" ".join(f"base{i}" if i != 10 * k else f"new{k}" for i in range(60)) for k in range(1, 5)]
TEXTS = [None, "", " \n\t", "one", "One", "one two three", "ONE two  three", LONG, LONG + " end", BASE, *NEAR, BASE.upper(), "a b\tc\n", "abc", "日本語 テキスト", "x" * 500, "you idiot", "idiot<|endoftext|>s", "Licensed under the MIT License.", "café ▁ mark"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 4 == 0 else "en" if i % 2 else "fr", None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(TEXTS)]
    rows += [(9, BASE, "en", "s0", None), (None, BASE, None, None, None)]
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "p") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_jaccard(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), 10**9), r["doc_id"])
    want = sorted(((r["doc_id"], len(sets[i]), least[root(i)]) for i, r in enumerate(rows)), key=str)
    assert sorted(map(tuple, jaccard.ngram_components(docs).collect()), key=str) == want
    assert jaccard.ngram_components(empty).count() == 0
    kept = jaccard.keep_one_per_component(docs)
    assert kept.columns == docs.columns and kept.where("text = 'ONE two  three'").count() == 0


def brute_components(rows):
    """(doc_id, size, component) of rows (doc_id, text), by comparing all pairs of different sets."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    each = sorted(set(sets) - {frozenset()}, key=len)
    parent = {x: x for x in each}

    def root(x):
        while parent[x] is not x:
            x = parent[x]
        return x

    for i, x in enumerate(each):
        for y in each[i + 1 :]:
            if 100 * len(x) < 75 * len(y):
                break
            if 100 * len(x & y) >= 75 * len(x | y):
                parent[root(x)] = root(y)
    least = {}
    for (d, _), x in zip(rows, sets):
        if x and d is not None:
            least[root(x)] = min(least.get(root(x), d), d)
    return sorted(((d, len(x), least.get(root(x)) if x else d) for (d, _), x in zip(rows, sets)), key=str)


@pytest.fixture(scope="module")
def families():
    """Near copies around the threshold, passages that texts share, repeated rows of one id and of none."""
    import random

    rng = random.Random(7)
    out, n = [], 0
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    for size, copies, edits in ((80, 60, 3), (40, 60, 2), (120, 50, 6), (30, 40, 1), (200, 30, 9)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(size)] = word()
            out.append((n, " ".join(t[: size - rng.randrange(3)])))
            n += 1
    for k in range(120):
        own = [word() for _ in range(5 + k % 25)]
        out.append((n, " ".join([*own, *passage])))
        n += 1
    out += [(5000, " ".join(passage))] * 1000 + [(None, " ".join(passage[:50]))] * 1000 + [(None, out[3][1])] * 5
    return out


@pytest.mark.parametrize("how", [{}, {"block": 8, "block_bytes": 1 << 12, "tile_rows": 4}])
def test_jaccard_families(spark, families, how):
    """Also with tiles of many blocks, families of many blocks, and salted tiles."""
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(6)
    sizes, label = jaccard.link_sets(docs, **how)
    assert sorted(map(tuple, jaccard.components_of(sizes, label).collect()), key=str) == brute_components(families)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7)], "u long, v long")
    assert sorted(map(tuple, components(edges).collect())) == [(i, 0) for i in range(1, 51)] + [(101, 100), (102, 100)]


def brute_groups(docs, digest):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    out = []
    for d, t in rows:
        same = [(x, y) for x, y in rows if norm(y) == norm(t)]
        keep = min(same, key=lambda r: (-len(r[1]), r[0] is None, r[0]))[0]
        out.append((d, keep, len(same), d == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [dedup.sha256, lambda t: F.substring(F.md5(t.cast("binary")), 1, 1)])
def test_exact(docs, empty, digest):
    got = dedup.exact_groups(docs, digest).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(docs, digest)
    assert dedup.exact_groups(empty, digest).count() == 0


@pytest.mark.parametrize("digest", [dedup.sha256, lambda t: F.substring(F.md5(t.cast("binary")), 1, 1)])
def test_exact_arrivals(docs, tmp_path, digest):
    """Two arrivals with one state folder give what one run gives, also where digests of different arrivals clash."""
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    early = docs.where("coalesce(doc_id, 9) % 2 = 1")
    state = str(tmp_path / "state")
    first = dedup.exact_groups(early, digest, state).select(columns).collect()
    assert sorted(map(tuple, first), key=str) == brute_groups(early, digest)
    later = dedup.exact_groups(docs.where("coalesce(doc_id, 9) % 2 = 0"), digest, state)
    assert sorted(map(tuple, later.select(columns).collect()), key=str) == brute_groups(docs, digest)
    # The locators lead to landed rows that hold the texts that stay.
    landed = dedup._all_landed(docs.sparkSession, state)
    back = landed.join(later.select("locator", "keep_id").distinct(), "locator")
    assert back.where("not (doc_id <=> keep_id)").count() == 0 and back.count() == later.select("locator").distinct().count()


def test_language_landmarks_are_bounded(spark):
    """More languages than landmarks: no more landmarks than asked for, and each language has its weights."""
    rows = [(i, f"{'abcdefghij'[i % 10] * 3}{i} {'abcdefghij'[i % 10] * 5} words", f"l{i % 10}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, landmarks=4)
    assert model.landmarks.shape[1] == 4 and model.weights.shape == (4, 10) and langid.fit(docs).landmarks.shape[1] > 100



@pytest.mark.parametrize("step", ["_stream", "_clashing"])
def test_exact_repeated_after_a_failure(docs, tmp_path, monkeypatch, step):
    """A call that fails after landing, or after the stream, and is made again counts its rows once; other rows meanwhile count too."""
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    early, late = docs.where("coalesce(doc_id, 9) % 2 = 1"), docs.where("coalesce(doc_id, 9) % 2 = 0")
    states = [str(tmp_path / s) for s in "abc"]
    for state in states:
        dedup.exact_groups(early, state_dir=state)
        with monkeypatch.context() as m:
            plain = getattr(dedup, step)
            m.setattr(dedup, step, lambda *args: (step == "_stream" and plain(*args)) or 1 / 0)
            with pytest.raises(ZeroDivisionError):
                dedup.exact_groups(late, state_dir=state, arrival="late" if state == states[1] else None)
    want = brute_groups(docs, dedup.sha256)
    again = lambda df, state, **how: sorted(map(tuple, dedup.exact_groups(df, state_dir=state, **how).select(columns).collect()), key=str)
    assert again(late, states[0]) == want
    assert again(late, states[1], arrival="late") == want and again(late, states[1], arrival="late") == want
    other = docs.sparkSession.createDataFrame([(*r[:1], r[1], *r[2:]) for r in [(70, "text of another arrival", None, None, None, 1, "x", "y", "z", "p")]], SCHEMA)
    assert again(other, states[2]) == sorted([*want, (70, 70, 1, True)], key=str)


def test_exact_extreme_ids(spark):
    rows = [(-(2**63), "a"), (2**63 - 1, "a"), (-(2**63), "b "), (0, "b"), (None, "a ")]
    got = dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id", "group_size", "kept").collect()
    low = -(2**63)
    assert sorted(map(tuple, got), key=str) == sorted([(low, None, 3, False), (2**63 - 1, None, 3, False), (None, None, 3, True), (low, low, 2, True), (0, low, 2, False)], key=str)


def test_dedup_stages(spark, empty):
    """One row of each text and of each component, with repeated and null ids."""
    near = [BASE, BASE, BASE + " ", NEAR[0], NEAR[1], LONG, LONG + " end"]
    ids = [9, 9, 9, 30, None, None, None]
    rows = [*zip(ids, near), (30, "another text with words of its own"), (None, None), (None, ""), (41, "  "), (40, "a b"), (40, "a  b"), (40, "a  b"), (39, "ab"), (None, "c"), (None, "c")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    exact = dedup.keep_one_copy(docs)
    assert exact.columns == docs.columns and dedup.keep_one_copy(empty).count() == 0
    got = sorted(((r["doc_id"], r["text"]) for r in exact.collect()), key=str)
    assert got == sorted([(9, BASE + " "), (30, NEAR[0]), (None, NEAR[1]), (None, LONG), (None, LONG + " end"), (30, rows[7][1]), (41, "  "), (40, "a  b"), (None, "c")], key=str)
    kept = jaccard.keep_one_per_component(docs)
    assert kept.columns == docs.columns and jaccard.keep_one_per_component(empty).count() == 0
    got = sorted(((r["doc_id"], " ".join((r["text"] or "").split()[:3])) for r in kept.collect()), key=str)
    first = lambda t: " ".join(t.split()[:3])
    assert got == sorted([(9, first(BASE)), (None, first(LONG)), (30, first(rows[7][1])), (None, ""), (None, ""), (41, ""), (40, "a b"), (39, "ab"), (None, "c")], key=str)


def test_mix(spark, docs, empty):
    plan = mixing.mix_plan(docs).collect()
    size = {}
    for r in docs.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        more = {s for s in size if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * size[s] if s in full else level * weight[s] for s in size}
    own = {(r["source_size"], r["target"]) for r in plan}
    assert len(own) == len(size) and all(any(a == size[s] and math.isclose(b, target[s]) for a, b in own) for s in size)
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2 for r in plan)
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, plan))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_sources(empty).count() == 0
    # Names that the operator uses itself, and many rows without an id.
    clash = docs.select("doc_id", "text", "source", *[F.lit(i).alias(c) for i, c in enumerate(("doc", "_source", "_rate", "_copies", "key", "named", "copies", "target"))])
    assert mixing.mix_sources(clash).columns == clash.columns and mixing.mix_sources(clash).count() == mixed.count()
    alone = spark.createDataFrame([(None, f"text number {i}", "a" if i % 2 else "b") for i in range(2000)], "doc_id long, text string, source string")
    taken = mixing.mix_plan(alone).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.1 for r in taken)
    # Rows equal in all: each draws for itself, and reruns agree, however the rows are dealt out.
    equal = spark.createDataFrame([(1 if i % 3 else None, "one text " * 2, "a" if i % 2 else None) for i in range(3000)] + [(5, "x", "b")], "doc_id long, text string, source string")
    plans = [mixing.mix_plan(equal.repartition(n)).groupBy("doc_id", "target", "copies").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken")).collect() for n in (3, 5)]
    assert sorted(map(str, plans[0])) == sorted(map(str, plans[1])) and sum(r["n"] for r in plans[0]) == 3001
    for target in {r["target"] for r in plans[0]}:
        assert target < 5 or abs(sum(r["taken"] for r in plans[0] if r["target"] == target) / target - 1) < 0.05
    assert mixing.mix_sources(equal).count() == sum(r["n"] * r["copies"] for r in plans[0])


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [r["text"] or "" for r in docs.collect()]
    want = sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs, path).collect()) == want
    assert tokens.token_counts(empty, path).count() == 0


@pytest.mark.parametrize("chunk, fan", [(64, 16), (64, 2), (1 << 15, 16)])
def test_pieces(docs, empty, chunk, fan):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(library.encode(r["text"] or "") for r in docs.collect())
    out = pieces.decode_pieces(pieces.encode_pieces(docs, path, chunk, fan), path)
    rows = out.collect()
    assert sorted(list(r["ids"]) for r in rows) == want
    assert all(r["decoded"] == library.decode(list(r["ids"])) for r in rows)
    assert pieces.encode_pieces(empty, path).count() == 0


def test_toxicity(spark, empty):
    clean = [f"the plain text number {i} about rivers and {i * 7}" for i in range(300)]
    bad = [f"you are an {w} and number {i}" for i, w in enumerate(["idiot", "moron", "loser", "clown"] * 15)]
    rows = [(i, t) for i, t in enumerate(clean + bad)] + [(900, None), (901, ""), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fold", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(360)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["predicted"] == int(300 <= r["doc_id"] < 360) for r in out) / len(out) > 0.97
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.score_toxicity(empty, labels).count() == 0 and toxicity.score_toxicity(docs, labels.limit(0)).count() == len(rows)


def test_label_model(spark):
    """Expectation maximisation as Spark aggregates, against the same model row by row."""
    import random

    rng = random.Random(3)
    rows = []
    for i in range(400):
        toxic = rng.random() < 0.2
        low = sum((rng.random() < (0.4 if toxic else 0.01)) << k for k in range(6))
        label = int(toxic) if rng.random() < 0.4 else -1
        rows.append((low, 0, low & 3, int(low.bit_count() > 1) | (int(low == 0) << len(toxicity.PLAIN) - 1), label))
    df = spark.createDataFrame(rows, "low long, high long, own long, votes long, label int").repartition(3)
    patterns = df.groupBy(*toxicity.PARTS, "label").agg(F.count(F.lit(1)).alias("n"))
    got = toxicity.fit_label_model(patterns)

    import numpy as np

    x = np.array([[(r[i] >> k) & 1 for i, n in enumerate(toxicity.PARTS.values()) for k in range(n)] for r in rows], float)
    label = np.array([r[4] for r in rows])
    want = toxicity.LabelModel()
    mean, cov, share = want.mean.copy(), want.covariance.copy(), want.share
    for _ in range(toxicity.ROUNDS):
        shrunk = cov + np.diag(np.diag(cov) * 0.1 + 1e-3)
        log = [-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(shrunk), x - m) for m in mean]
        p = 1 / (1 + np.exp(-np.clip(log[1] - log[0] + np.log(share / (1 - share)), -30, 30)))
        p = np.where(label >= 0, label, p)
        new = [((q[:, None] * x).sum(0) + x.mean(0)) / (q.sum() + 1) for q in (1 - p, p)]
        share = min(max(p.mean(), 1e-4), 0.5)
        cov = (x.T @ x) / len(x) - (1 - share) * np.outer(new[0], new[0]) - share * np.outer(new[1], new[1])
        cov -= np.diag(np.minimum(np.diag(cov), 0))
        mean = np.array(new)
    assert np.allclose(got.mean, mean, atol=1e-6) and np.allclose(got.covariance, cov, atol=1e-6) and math.isclose(got.share, share, abs_tol=1e-6)
    # Voters that repeat each other share their weight.
    twice = got.weight[0] + got.weight[list(np.cumsum([0, *toxicity.PARTS.values()]))[2]]
    assert np.corrcoef(got.posterior(x), [r[0] > 0 for r in rows])[0, 1] > 0.5 and twice < 2.5 * np.median(got.weight[2:6])


def test_toxicity_scores(spark):
    """Every score against the posterior-trained classifier written out; held-out labels change nothing."""
    import zlib

    stems = [f"zorb{c}" for c in "aeiou"]
    rows = [(i, f"plain words about hills and number {i} " + ("you idiot " if i % 9 == 0 else "") + (" ".join(f"{s}{i}" for s in stems) if i % 7 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = {i: int(i % 9 == 0 or i % 7 == 0) for i in range(400)}
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    wrong = spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in truth.items()], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert {i: r["score"] for i, r in got.items()} == {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, wrong).collect()}
    assert {i for i, r in got.items() if r["held_out"]} == held
    assert sum(r["predicted"] == truth[i] for i, r in got.items()) >= 396


def test_toxicity_stage(spark):
    clean = [(i, f"the plain text number {i} about rivers and {i * 7}") for i in range(300)]
    bad = [(300 + i, f"you are an {w} and number {i}") for i, w in enumerate(["idiot", "moron", "loser", "clown"] * 15)]
    # A toxic row beside clean ones with a null id, and with a clean row's id.
    mixed = [(None, "a quiet lake"), (None, "you are an idiot and number 5"), (None, None), (7, "you are an idiot and number 7")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(clean + bad + mixed)], "doc_id long, text string, row int")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(360)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(*r, i) for i, r in enumerate(clean + bad + mixed) if "you are" not in (r[1] or "")], key=str)


def test_language(spark, docs, empty):
    words = {"en": "the and of with that this from", "fr": "le la les des une avec pour", "de": "der die das und nicht mit ein"}
    rows = [(i, " ".join(words[c].split()[(i + k) % 7] for k in range(9)), c) for i, c in enumerate(["en", "fr", "de"] * 60)] + [(900, None, "en"), (901, "123 !", None), (902, "The And Of", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert sum(got[i] == c for i, _, c in rows[:180]) >= 176 and (got[900], got[901], got[902]) == ("und", "und", "en")
    assert langid.identify(empty).count() == 0 and langid.identify(docs).count() == docs.count()


def test_language_kernel(spark):
    """Scores against kernel ridge regression written out with sets of n-gram places."""
    import numpy as np

    rows = [(i, " ".join(["the and of with", "le la les des", "der die das und"][i % 3].split()[(i + k) % 4] for k in range(3 + i % 5)) + f" {i % 11}", ["en", "fr", "de"][i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, landmarks=12)

    def places(t):
        b, out = t.lower().encode(), set()
        for n in range(1, langid.GRAMS + 1):
            for i in range(len(b) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 257 + b[i + k] + k + 1) % (1 << 32)
                out.add((h * 2654435769 % (1 << 32)) >> 19)
        return out

    marks = [set(np.flatnonzero(col)) for col in model.landmarks.T]
    kernel = lambda x, y: len(x & y) / math.sqrt(len(x) * len(y))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for i, t, lang in rows:
        s = np.array([kernel(places(t), m) for m in marks]) @ model.weights
        assert got[i]["lang_pred"] == model.langs[int(s.argmax())] == lang and math.isclose(got[i]["score"], 1 / np.exp(4 * (s - s.max())).sum(), abs_tol=1e-4)
    # The weights solve the ridge regression on the landmarks' features.
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    root = vectors[:, values > 1e-8 * values.max()] / np.sqrt(values[values > 1e-8 * values.max()])
    train = {(lang, frozenset(places(t))) for i, t, lang in rows if not got[i]["held_out"]}
    z = np.array([[kernel(x, m) for m in marks] for _, x in train]) @ root
    y = np.array([[1.0 if lang == c else -1.0 for c in model.langs] for lang, _ in train])
    share = np.array([1 / sum(lang == other for other, _ in train) for lang, _ in train])[:, None]
    w = root @ np.linalg.solve(z.T @ (share * z) + langid.RIDGE * np.eye(z.shape[1]), z.T @ (share * y))
    assert np.allclose(np.array([[kernel(x, m) for m in marks] for _, x in train]) @ w, np.array([[kernel(x, m) for m in marks] for _, x in train]) @ model.weights, atol=2e-2)


def test_many_languages(spark):
    """More languages than a plan holds, and than the sample has rows."""
    rows = [(i, f"word{i % 50} and more of lang{i % 50}", f"l{i % 50:02}") for i in range(400)] + [(1000 + i, "x y z", None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.fit(docs, in_plan=10)
    same = langid.fit(docs)
    assert whole.langs == same.langs and len(whole.langs) == 50 and (whole.weights == same.weights).all()
    few = langid.fit(docs, sample=20, in_plan=10)
    assert few is None or len(few.langs) < 50


def brute_topk(rows, k=5):
    """Every row's exact products with all other rows of its length, for rows whose id is divisible by 50."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for a, (i, q) in enumerate(whole):
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(whole) if b != a and len(v) == len(q))[:k]
            want += [(i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(best)]
    return sorted(want)


def test_topk(spark):
    vec = lambda i: [math.sin(i * k + k) for k in range(1, 9)]
    good = [(i, vec(i % 90)) for i in range(200)] + [(50, vec(3)), (50, vec(50)), (7, vec(8)), (500, [1.0]), (600, []), (601, [])]
    # Large components, also beyond 64 bits.
    good += [(1000, [2.0e6] * 8), (1001, [-2.0e6] + [0.5] * 7), (1050, [1e30, *[3.0] * 7]), (1051, [-1e30, *[2.0] * 7]), (1052, [1e30, *[2.0] * 7]), (1053, [1.7e38] * 8)]
    rows = [(i, v, 0) for i, v in good] + [(300, None, 0), (350, [None] + [1.0] * 7, 0), (400, [float("nan")] * 8, 0), (450, [float("inf")] * 8, 0), (None, vec(1), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_topk(good)
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_bounds():
    """On clustered vectors the segment bounds leave few candidates for exact products."""
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32)).cumsum(axis=1)
    v = np.floor(256 * (centres[np.arange(4000) % 40] + 0.05 * rng.normal(size=(4000, 32)))).astype(np.int32)
    block = lambda at: topk.Block(32, False, at.astype(np.int64).tobytes(), at.astype(np.int64).tobytes(), v[at].tobytes())
    multiplied = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            multiplied.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    q, c = block(np.arange(40)), block(np.arange(4000))
    c.v = c.v.view(Counted)
    floors = np.full(40, -np.inf)
    for n, ids, scores in topk.top_of_block(q, c, 5, floors):
        exact = v.astype(np.int64) @ v[n].astype(np.int64)
        exact[n] = -(1 << 60)
        assert sorted(scores, reverse=True) == sorted(exact, reverse=True)[:5] and floors[n] == min(scores)
    assert sum(multiplied) < 0.2 * 40 * 4000


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.COM/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "http://other.com/en/7": ("other.com", "/en/7", "com/en/", "block"),
        "http://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"), "https://example.net/de/81#q": ("example.net", "/de/81", "example.net/de/8", "block"), "http://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "http://a.org/es/1": ("a.org", "/es/1", "org/es/", "block"), "http://com": ("com", "", None, "allow"), "http://casino-win.example.org/en/1": ("casino-win.example.org", "/en/1", None, "block"), "http://x.com?/en/": ("x.com", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df).collect()}
    assert got == cases
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_url_rules(spark):
    """More rules than a plan holds: both ways against brute force, and only fetched rules are tried."""
    hosts = [f"site{i}.example{i % 7}.com" for i in range(400)]
    rules = tuple(urls.host_rule("block" if i % 3 else "allow", h, f"/p{i % 5}/") for i, h in enumerate(hosts)) + tuple(urls.word_rule(f"bad{i}") for i in range(50)) + urls.RULES
    pages = [f"http://a.{hosts[i * 7 % 400]}/p{i % 5}/x?q" for i in range(300)] + [f"https://x-bad{i}.org/es/" for i in range(60)] + [None, "", "http://com/en/", "HTTP://COM"] + ["http://a.com/en/1"] * 5
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(pages)], "page_id long, url string, url_parts string")
    split = {r["page_id"]: (r["host"], r["path"]) for r in urls.filter_urls(df, ()).collect()}

    def judge(where):
        fits = [r for r in rules if re.search(r.pattern, where)]
        best, other = (max(((len(r.text), r.text, r.verdict) for r in fits if r.explicit == e), default=(0, None, None)) for e in (True, False))
        return best[1], other[1], best[2] or other[2] or "allow"

    want = {i: judge("".join(split[i])) for i in range(len(pages))}
    for in_plan in (1000, 10):
        got = urls.filter_urls(df, rules, in_plan)
        assert "url_parts" in got.columns and {r["page_id"]: (r["rule"], r["method_rule"], r["verdict"]) for r in got.collect()} == want
    own = urls.parsed(df.select("page_id", "url"))
    slim = own.select(F.col("page_id").alias("_row"), "url", f"{own.columns[-1]}.*")
    tried = urls.fetched_by_join(slim, urls.rule_table(slim, rules)).count()
    fetched = urls.fetched_in_plan(F.col(own.columns[-1]), urls.rarest_tokens(slim, rules), rules)
    assert own.agg(F.sum(F.size(fetched))).first()[0] == tried < 4 * len(pages)
    assert urls.filter_urls(df.limit(0), rules, 10).count() == 0


def test_licenses(spark):
    rows = [(1, "a/b/c.py", "code\nReleased under the MIT License.\nmore code and words"), (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "a/b/d.py", "nothing here"), (4, "a/b/e/f.py", None), (5, "z/g.py", "plain"), (6, None, "All rights reserved."), (3, "a/b/d.py", "nothing here")]
    got = sorted((r["id"], r["license"], r["how"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect())
    assert [x for x in got if x[0] != 5] == [(1, "MIT", "own"), (2, "Apache-2.0", "own"), (3, "Apache-2.0", "inherited"), (3, "Apache-2.0", "inherited"), (4, "Apache-2.0", "inherited"), (6, "proprietary", "own")]
    assert (5, None, "none") in got


def test_license_edges(spark):
    """Very long texts, one path with several texts, the root directory, nulls, columns named like the operator's own, an empty table."""
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "a/LICENSE", apache), (2, "a/LICENSE", mit), (3, "a/b/c/x.py", "nothing"), (4, "LICENSE", apache), (5, "z.py", ""), (6, "q/w/z.py", None), (7, "long/x.txt", "word " * 60000 + mit), (8, "long/y.txt", "no"), (None, None, None), (9, "a/x.py", "none"), (9, "a/x.py", "none")]
    df = spark.createDataFrame([(*r, "own", "b", 1) for r in rows], "id long, path string, text string, license string, own_dir string, score int")
    got = sorted(((r["id"], r["license"], r["how"]) for r in licenses.scan_licenses(df).collect()), key=str)
    # Of two equally close licence files in a directory the later name counts; a text with a statement inside is no licence file.
    want = [(1, "Apache-2.0", "own"), (2, "MIT", "own"), (3, "MIT", "inherited"), (4, "Apache-2.0", "own"), (5, "Apache-2.0", "inherited"), (6, "Apache-2.0", "inherited"), (7, "MIT", "own"), (8, "Apache-2.0", "inherited"), (None, None, "none"), (9, "MIT", "inherited"), (9, "MIT", "inherited")]
    assert got == sorted(want, key=str)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_texts(spark):
    full = licenses.full_texts()
    mit, bsd = (next(t for n, t in full if n == name) for name in ("MIT", "BSD"))
    assert {n for n, _ in full} >= {"MIT", "Apache-2.0", "GPL", "LGPL", "BSD", "MPL-2.0", "CC0"}
    rows, want = [], {}
    for k, (name, text) in enumerate(full):
        rows += [(10 * k, f"{k}/LICENSE", text), (10 * k + 1, f"{k}/src/a.py", "nothing here")]
        want |= {10 * k: (name, "own"), 10 * k + 1: (name, "inherited")}
    prose = "Some words on rivers and lakes, and on what lives there by day "
    code = " ".join(f"name{i} = call{i}(x{i})" for i in range(300))
    header = "# Licensed under the Apache\n# License, Version 2.0 (the\n# \"License\"); you may not use this\n# file except in compliance\n# with the License.\n"
    lesser = "/* This library is free software; you can\n * redistribute it and/or modify it under the\n * terms of the GNU Lesser General\n * Public License as published by somebody */\n"
    cases = [
        ("Apache-2.0", header + code), ("LGPL", lesser + code), ("MIT", prose * 20 + "and it is released under the\nMIT license which " + prose * 20),
        ("BSD", "Copyright X. All rights reserved.\nUse of this source code is governed by a BSD-style\nlicense.\n" + code), ("proprietary", prose + "all rights\nreserved " + prose),
        ("MIT", "\n".join("# " + x for x in mit.split("\n")) + code), (None, prose * 30 + "a licence and permission to fish"),
        ("BSD", bsd.replace("The Regents of the University of California", "Some One").replace("THE REGENTS", "THE COPYRIGHT HOLDERS")),
    ]
    for k, (name, text) in enumerate(cases):
        # The last is a licence file; the others state a licence for themselves alone.
        below = (name, "inherited") if k == len(cases) - 1 else (None, "none")
        rows += [(1000 + 10 * k, f"case{k}/file", text), (1001 + 10 * k, f"case{k}/src/b.py", "nothing here")]
        want |= {1000 + 10 * k: (name, "own" if name else "none"), 1001 + 10 * k: below}
    got = licenses.scan_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect()
    assert {r["id"]: (r["license"], r["how"]) for r in got} == want


def test_license_runs():
    """The bounded search against all runs of a statement's length."""
    match = licenses.Matcher({"": 50, "license": 9, "the": 40, "under": 12})
    text = "the the license license under MIT gnu general public released rights reserved all under a cc by nc sa license 4 0 of the work is subject to version 3 permission copy all rights"
    for shift in range(0, 30, 3):
        words = (text.split()[shift:] + ["filler"] * 60 + text.split()[:shift]) * 2
        cosines = []
        for (name, t, norm), n in zip(match.templates, match.lengths):
            for i in range(len(words) - n + 1):
                run = " ".join(words[i : i + n])
                if licenses._TRIGGER.search(run) or words[i + n - 1 : i + n + 1] in (["rights", "reserved"], ["public", "domain"]):
                    v, size = match.vector(licenses.terms(run))
                    cosines.append((sum(x * v.get(w, 0.0) for w, x in t.items()) / (norm * size), name))
        best = max(cosines, key=licenses._rank)
        got = match.best_run([w.lower() for w in words], (0.0, ""))
        assert got[1] == best[1] and math.isclose(got[0], best[0], abs_tol=1e-6)


def test_decoded_lists():
    """Lists are decoded together as they are one by one: bytes of characters, bytes that are no text, white space at the front, empty lists, slices."""
    import pyarrow as pa

    m = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", " ", "  a", "plain words", "line\nbreak\t\u2603 \U0001f600!", "\u2581mark", "x\u00e9\u4e2d\n\n", " \n "]
    whole = [m.encode(pieces.escaped(t)) for t in texts]
    broken = [[m.byte[0xE2], m.byte[0x96], m.id["a"]], [m.byte[0xFF], m.byte[0x0A]], [m.byte[0xE2], m.byte[0x96], m.byte[0x81], m.byte[0x41]]]
    for rows in (whole, whole + broken, [], [[]]):
        ids = pa.array([[5], *rows, [7]], pa.list_(pa.int32())).slice(1, len(rows))
        assert m.decode_lists(ids).to_pylist() == [m.decode(r) for r in rows]
