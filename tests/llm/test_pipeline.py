"""The corpus pipeline against a chain of brute-force stages."""

import re
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from biorec.llm import mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.fixture(scope="module")
def rows():
    base = [f"river{i} bank{i * 3 % 17}" for i in range(30)]
    out = [(i, f"the plain text number {i} about rivers and {i * 7} hills of green", "en", f"s{i % 3}", None) for i in range(240)]
    out += [(300 + i, f"you are an {w} and number {i} says so too", "en", "s1", 5) for i, w in enumerate(["idiot", "moron", "loser", "clown"] * 15)]
    out += [(400 + i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :]), "en", None, 1) for i in range(6)] + [(500, " ".join(base), "en", "s2", 2), (500, "  ".join(base), "en", "s2", 2), (None, " ".join(base), None, None, None)]
    out += [(None, None, None, None, None), (None, "", None, "s0", None), (600, " \n", "en", "s0", 0), (601, "a b", "en", "s0", 0), (601, "a  b", "en", "s0", 0), (601, "a  b", "en", "s0", 0), (602, "long " * 30000 + "end", "en", "s2", 7)]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(300 <= i < 360)) for i in [*range(240), *range(300, 360)]], "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def brute_exact(rows):
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if key not in best or rank < best[key][0]:
            best[key] = rank, r
    return [r for _, r in best.values()]


def brute_near(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0)
        if not sets[i] or root(i) not in best or rank < best[root(i)][0]:
            best[root(i) if sets[i] else -1 - i] = rank, r
    return [r for _, r in best.values()]


def test_chain(spark, rows, folder):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet")
    clean = [tuple(r) for r in toxicity.drop_toxic(docs, labels).collect()]
    assert sorted(clean, key=str) == sorted((r for r in rows if "you are an" not in (r[1] or "")), key=str)
    left = brute_near(brute_exact(clean))
    plan = Counter()
    mixed = spark.createDataFrame(left, SCHEMA)
    for r in mixing.mix_plan(mixed).collect():
        plan[r["doc_id"]] += r["copies"]
    want = Counter()
    for r in mixing.mix_sources(mixed).collect():
        want[r["doc_id"], tuple(library.encode(r["text"] or ""))] += 1
    assert sum(want.values()) == sum(plan.values())
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want


def test_stages(spark, rows, folder, tmp_path):
    """Each stage on nulls, repeats, clashing columns and an empty table: its columns are those of its input."""
    names = ["row", "doc", "digest", "locator", "n", "sid", "votes", "copies", "key"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows[:40] + rows[-20:]], SCHEMA + ", " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString() and 0 < out.count(), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scans_give_memory_back(monkeypatch):
    """The scans that run before others in the same workers give free memory back after their task, and once only."""
    import pyarrow as pa

    from biorec.llm import common, jaccard

    called = []
    monkeypatch.setattr(common, "release_memory", lambda: called.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e f", None])], ["doc_id", "text"])
    for scan in (jaccard._scan_sizes, toxicity._scan(toxicity.Known({}, []))):
        called.clear()
        assert sum(len(b) for b in scan(iter([batch, batch]))) >= 4 and called == [1]
