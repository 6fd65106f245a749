"""Runs of words, repeated lines and fill-in-middle against brute force on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from biorec.llm import frames, lines, periods

SCHEMA = "doc_id long, text string, doc string, kept string, n long, runs string, form string, lost string, h1 string"
EXTRA = ("d", "k", 1, "r", "f", "l", "h")
LONG = " ".join(f"w{i * i % 997}" for i in range(9000))
TEXTS = [
    None, "", " \n\t", "one", "a a a a a", "a a a a a a", "x y x y x y x y z", "A repeated line, said twice\nown line of the first\n\n", "  a REPEATED line, said twice\t\nown line of the second", "a repeated line, said twice",
    "short\nshort\nshort", LONG, LONG + "\n" + LONG, "日本語 テキスト " * 9, "Élan vital ça\nélan vital ça", "ÉLAN vital çA\nx", "has <P> a mark", "<<S>", "ends in <", "\n".join(["the same line again"] * 50), "no space" * 300, "🙂🙃" * 5000, "a\x0bb\x0cc\rd\x85e f",
]


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(TEXTS)) + [(9, TEXTS[9]), (9, TEXTS[8]), (None, TEXTS[9]), (None, "only rows without an id hold this"), (None, "only rows without an id hold this"), (-(2**63), TEXTS[7])]
    return out + [(100 + i, TEXTS[19]) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- runs


def brute_runs(words, exponent=4, least=6):
    """(start, length, period) of all runs, by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            k = i
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            if k > i and k - i + q >= max(least, exponent * q):
                found.setdefault((i, k - i + q), q)
            i = max(k, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    out = [rng.randrange(a) for a in [rng.choice((1, 2, 3, 9))] * rng.randrange(50)]
    unit = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
    out += unit * rng.randrange(12) + [rng.randrange(3) for _ in range(rng.randrange(9))]
    return out * rng.choice((1, 1, 2, 5))


@pytest.mark.parametrize("how", [{}, {"grid": 3}, {"exponent": 2, "least_length": 2}, {"exponent": 3, "least_length": 9}])
def test_runs_of_random_words(how):
    rng = random.Random(str(how))
    for _ in range(250):
        texts = [some_words(rng) for _ in range(rng.randrange(5))]
        got = list(zip(*(x.tolist() for x in periods.find_runs([np.array(t, np.int32) for t in texts], **how))))
        assert got == [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t, how.get("exponent", 4), how.get("least_length", 6))]


def test_grammar_expands_to_its_text_and_answers_extensions():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 3, 300), np.zeros(200, int), np.tile(rng.integers(0, 9, 7), 40)]
    s = np.concatenate([[-2], texts[0], [-3], texts[1], [-4], texts[2], [-1]]).astype(np.int32)
    levels = periods.grammar(s)
    assert len(levels[-1].symbols) == 7  # a symbol for each text, and separators
    for level, above in zip(levels, levels[1:]):
        assert (level.up == np.repeat(np.arange(len(above.symbols)), np.diff(above.first))).all()
        # Equal symbols have equal children.
        kids = {}
        for k, name in enumerate(above.symbols.tolist()):
            part = tuple(level.symbols[above.first[k] : above.first[k + 1]].tolist())
            assert kids.setdefault(name, part) == part
    inside = np.flatnonzero(s >= 0)
    a, b = rng.choice(inside, (2, 4000))
    text = np.cumsum(s < 0)
    a, b = a[(a != b) & (text[a] == text[b])], b[(a != b) & (text[a] == text[b])]
    for back in (False, True):
        way = -1 if back else 1
        for i, j, n in zip(a.tolist(), b.tolist(), periods.agree(levels, a, b, back).tolist()):
            assert all(s[i + way * k] == s[j + way * k] for k in range(n)) and s[i + way * n] != s[j + way * n]


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("null" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_digests(spark, docs, rows, empty, monkeypatch):
    more = [(1000 + i, " ".join(f"t{(i * k) % 7}" for k in range(i))) for i in range(200)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = periods.run_digests(periods.periodic_runs(periods.repeat_tails(every))).collect()
    same(got, [brute_digest(*r) for r in rows + more])
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in more) > 10
    assert periods.run_digests(periods.periodic_runs(periods.repeat_tails(empty))).count() == 0
    assert periods.periodic_runs(docs).where("doc_id = 11").first()["n_words"] == 9000


def test_words_of_a_long_text(monkeypatch):
    monkeypatch.setattr(periods, "STEP", 7)
    text = "a bb  ccc\tdddddddddddddddd\n e\x0bf " * 9
    assert list(periods.words_of(text.encode())) == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    assert periods._joined([b"a", b"b"], np.array([0, 1] * 20)) == b" ".join([b"a", b"b"] * 20)


# ---------------------------------------------------------------- lines


def brute_lines(rows, least_docs=2, least=10):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= least:
                holders.setdefault(key(s), set()).add(d)
    first = {k: min(ds, key=lambda d: (d is None, d or 0)) for k, ds in holders.items() if len(ds) >= least_docs}
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [s for s in own if key(s) not in first or first[key(s)] == d]
        out.append((d, "\n".join(kept), len(own), len(own) - len(kept)))
    return out


@pytest.mark.parametrize("how", [{}, {"least_docs": 3, "least_points": 4}, {"least_docs": 1}])
def test_lines(docs, rows, empty, how):
    got = lines.drop_lines(docs, **how)
    same(got.select("doc.doc_id", "kept", "n_lines", "n_dropped").collect(), brute_lines(rows, how.get("least_docs", 2), how.get("least_points", 10)))
    assert got.select("doc.*").columns == docs.columns
    assert lines.drop_lines(empty, **how).count() == 0


def test_lines_joined_without_a_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(lines, "few", lambda df: df.hint("merge"))
    same(lines.drop_lines(docs).select("doc.doc_id", "kept", "n_lines", "n_dropped").collect(), brute_lines(rows))


# ---------------------------------------------------------------- fill in the middle


def brute_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = text[:i], text[i:j], text[j:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return (doc_id, n, form, i, j - i, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("units", [1, 3, 1000, frames.UNITS])
def test_fill_in_middle(spark, docs, rows, empty, units):
    rows = [r for r in rows if units > 3 or len(r[1] or "") < 3000]
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    outputs = frames.fill_in_middle(frames.store_frames(docs, units))
    want = [brute_middle(*r) for r in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    same(frames.digests(outputs).collect(), [(*w[:-1], sha(w[-1]), sha(t or "")) for w, (_, t) in zip(want, rows)])
    same(frames.texts(outputs).collect(), [(w[0], w[2], w[-1]) for w in want])
    same(frames.restored(outputs).collect(), [(d, t or "") for d, t in rows])
    assert frames.digests(frames.fill_in_middle(frames.store_frames(empty, units))).count() == 0


def test_only_cut_frames_are_decompressed(monkeypatch):
    text = "".join(chr(97 + k % 26) for k in range(10_000))
    whole = frames._collected((frames.packed(text[k : k + 100]), 100) for k in range(0, len(text), 100))
    read, plain = [], frames.Frames.read
    monkeypatch.setattr(frames.Frames, "read", lambda self, k: read.append(k) or plain(self, k))
    out = frames.rearranged(whole, "psm", 1234, 7000)
    assert set(read) == {12} and sum(f in whole.frames for f in out.frames) >= 99
    monkeypatch.undo()
    assert "".join(out.stream(0, out.units)) == f"<P>{text[:1234]}<S>{text[7000:]}<M>{text[1234:7000]}"
    assert "".join(frames.original(out, "psm")) == text
