"""SentencePiece encoding and decoding by a max-plus parallel scan.

For a model of merged pieces (BPE with byte fallback) a segmentation is the model's own exactly
if every two adjacent pieces, taken alone, are segmented into just these two. So the weight of a
step from one piece to the next is 0 if the pair is stable and minus infinity if not, at most one
path to any position is finite, and the best path from a start to an end is unique.

A giant document is cut into chunks of ``CHUNK`` characters. The states at a boundary are the
pieces of the vocabulary that could hold the character before it. Each chunk yields a transfer
matrix over the max-plus semiring, from the states at its left boundary to those at its right
one. The matrices are combined associatively, in a tree of runs of ``FAN``, and the weights from the
front and from the end are passed down that tree; that fixes the state at each boundary, and every
chunk is then traced back by itself, between two known piece ends.

Pieces hold white space only at their front, so every path has a piece end where white space
follows something else; likewise between characters of kinds that no piece joins (such as a
letter and a comma), and next to a character that occurs in no piece (it is spelled in bytes).
Stretches between such cuts are traced once and cached; only a chunk's first and last
stretch depend on its boundaries' states.

Texts are whole; null is empty: no pieces. Rows are encoded one by one: repeated rows, null ids
and ties need no care. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biorec.llm.common import lean, materialize, slices

CHUNK = 1 << 15
#: Adjacent matrices that a task multiplies at a time.
FAN = 16
#: Entries of each of the two generations of a cache.
CACHE = 1 << 18
SPACE = "▁"
NO = -np.inf
_WHOLE = operator.itemgetter(0)


class Recent(dict):
    """A cache of the entries used last: when it is full, it becomes the older generation, and what is asked for there comes back."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[key] = value


class Model:
    """The vocabulary of a model file, and its path scores."""

    def __init__(self, path: str):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        size = file.get_piece_size()
        self.text = [file.id_to_piece(i) for i in range(size)]
        special = [file.is_byte(i) or file.is_control(i) or file.is_unknown(i) for i in range(size)]
        self.id = {t: i for i, t in enumerate(self.text) if not special[i]}
        self.score = [file.get_score(i) for i in range(size)]
        self.byte = [file.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.of_byte = {i: b for b, i in enumerate(self.byte)}
        self.spelled = pa.array([bytes([self.of_byte[i]]) if i in self.of_byte else t.encode() for i, t in enumerate(self.text)], pa.binary())
        self.longest = max(map(len, self.id))
        self.known = {c for t in self.id for c in t}
        #: Length of the longest piece that ends with these two characters.
        self.reach: dict[str, int] = {}
        for t in self.id:
            self.reach[t[-2:]] = max(len(t), self.reach.get(t[-2:], 1))
        if any(SPACE in t.lstrip(SPACE) for t in self.id) or not all(c in self.id for c in self.known):
            raise ValueError("a piece holds white space after other characters, or a character that is no piece")
        # Characters that stand side by side in pieces, directly or through others, are one kind; no piece reaches from one kind to another.
        kind = {c: c for c in self.known if c != SPACE}

        def root(c: str) -> str:
            while kind[c] != c:
                c = kind[c]
            return c

        for t in self.id:
            inner = t.lstrip(SPACE)
            for x, y in itertools.pairwise(inner):
                kind[root(x)] = root(y)
        self.kind = {c: root(c) for c in kind} | {SPACE: SPACE}
        kinds: dict[str, str] = {}
        for c in sorted(kind):
            kinds[self.kind[c]] = kinds.get(self.kind[c], "") + c
        lone = re.escape("".join(k for k in kinds.values() if len(k) == 1))
        groups = [f"{SPACE}*[{re.escape(k)}]+" for k in sorted(kinds.values(), key=len, reverse=True) if len(k) > 1]
        if lone:
            groups.append(f"{SPACE}*([{lone}])\\1*")
        self.stretch = re.compile("|".join([*groups, SPACE + "+", "."]), re.DOTALL)
        self.stable = Recent()  # (left, piece): bool
        self.lasts = Recent()  # prefix: its last piece
        self.traced = Recent()  # stretch: its ids

    def alone(self, text: str) -> list[str]:
        """The segmentation of a short text by definition: merge the adjacent pair with the best score, leftmost first."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if (k := self.id.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if parts[i] != left or (j := after[i]) >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def step(self, left: str | None, piece: str) -> float:
        """Max-plus weight of ``piece`` after ``left`` (None: a start)."""
        key = (left or "", piece)
        ok = self.stable[key]
        if ok is None:
            ok = self.alone(key[0] + piece) == ([left, piece] if left else [piece])
            self.stable.put(key, ok)
        return 0.0 if ok else NO

    def paths(self, text: str, start: int, last: str | None, stop: int) -> dict[int, str | None]:
        """Where finite paths from ``start`` end in ``text[start:stop]``, each with its last piece."""
        ends: dict[int, str | None] = {start: last}
        for end in range(start + 1, stop + 1):
            for begin in range(max(start, end - self.longest), end):
                if begin in ends:
                    piece = text[begin:end]
                    if (piece in self.id or piece not in self.known and end - begin == 1) and self.step(ends[begin], piece) == 0.0:
                        ends[end] = piece
                        break
        return ends

    def last(self, prefix: str) -> str:
        """The last piece of the one finite path that ends where a (short) prefix of a stretch does. Prefixes are shared by many stretches."""
        got = self.lasts[prefix]
        if got is None:
            n = len(prefix)
            stable, known = self.stable, self.id
            for begin in range(max(0, n - self.reach.get(prefix[-2:], 1)), n):
                piece = prefix[begin:]
                if piece in known:
                    left = self.last(prefix[:begin]) if begin else ""
                    ok = stable.get((left, piece))
                    if ok is None:
                        ok = self.step(left or None, piece) == 0.0
                    if ok:
                        got = piece
                        break
            self.lasts.put(prefix, got)
        return got

    def best(self, stretch: str) -> list[str]:
        """The finite path through a stretch."""
        at, path = len(stretch), []
        ends = self.paths(stretch, 0, None, at) if at > 64 else None
        while at:
            path.append(piece := ends[at] if ends else self.last(stretch[:at]))
            at -= len(piece)
        path.reverse()
        return path

    def trace(self, stretch: str) -> tuple[int, ...]:
        """Ids of a stretch between two cuts or other piece ends."""
        got = self.traced[stretch]
        if got is None:
            if stretch[0] not in self.known:
                return tuple(self.byte[b] for b in stretch.encode())
            got = tuple(map(self.id.__getitem__, self.best(stretch)))
            if len(stretch) <= 64:
                self.traced.put(stretch, got)
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        traced, trace = self.traced.get, self.trace  # ``get`` looks at the younger generation alone
        for s in map(_WHOLE, self.stretch.finditer(text)):
            out += traced(s) or trace(s)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of pieces: bytes joined, marks to spaces, without the space put before the text."""
        if self.of_byte.keys().isdisjoint(ids):
            text = "".join(map(self.text.__getitem__, ids)).replace(SPACE, " ")
            return text[1:] if text.startswith(" ") else text
        out, run = [], bytearray()
        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(self.text[i])
        if run:
            out.append(run.decode(errors="replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """``decode`` of each list: by Arrow's own functions, where the pieces' bytes are UTF-8; one by one, where some list's are not."""
        ids = pa.concat_arrays([ids])  # offsets from 0
        spelled = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.spelled.take(ids.flatten())), b"")
        try:
            text = spelled.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array(map(self.decode, ids.to_pylist()), pa.string())
        text = pc.replace_substring(text, SPACE, " ")
        return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)

    # ------------------------------------------------------------ boundaries of chunks

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(begin, end) of all pieces that could hold the character before ``at``; at the start, the empty piece."""
        if at == 0:
            return [(0, 0)]
        if text[at - 1] not in self.known:
            return [(at - 1, at)]
        spans = ((b, e) for b in range(max(0, at - self.longest), at) for e in range(at, min(len(text), b + self.longest) + 1))
        return [(b, e) for b, e in spans if text[b:e] in self.id]

    def is_cut(self, text: str, at: int) -> bool:
        a, b = text[at - 1], text[at]
        if b == SPACE:
            return a != SPACE
        return a != SPACE and self.kind.get(a) != self.kind.get(b) or a not in self.known or b not in self.known

    def matrix(self, text: str, left: int, right: int) -> np.ndarray:
        """Max-plus weights from each state at ``left`` to each state at ``right``; ``text`` reaches a piece's length beyond both."""
        entries, exits = self.states(text, left), self.states(text, right)
        out = np.full((len(entries), len(exits)), NO)
        last_cut = next((p for p in range(right - 1, left, -1) if self.is_cut(text, p)), left)
        stop = min(len(text), right + self.longest)
        tail = self.paths(text, last_cut, None, stop) if last_cut > left else {}
        for i, (b, e) in enumerate(entries):
            first_cut = next((p for p in range(e, last_cut + 1) if p > left and self.is_cut(text, p)), None)
            if first_cut is None:
                ends = self.paths(text, e, text[b:e] or None, stop)
            else:
                ends = tail if first_cut in self.paths(text, e, text[b:e] or None, first_cut) else {}
            for j, (c, f) in enumerate(exits):
                if f in ends and ends[f] == text[c:f]:
                    out[i, j] = 0.0
        return out


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def escaped(text: str | None) -> str:
    """The model's own normalisation: white space at the front, and spaces as its mark."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def boundary_weights(matrices: list[np.ndarray], ahead: np.ndarray, behind: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The best weights from the document's front to the states at each boundary of a run of matrices, and from these to its end.

    ``ahead`` has them for the run's first boundary, ``behind`` for its last.
    """
    forward, back = [ahead], [behind]
    for m in matrices:
        forward.append(plus(forward[-1], m))
    for m in reversed(matrices):
        back.append(plus(m, back[-1]))
    return forward, back[::-1]


# ---------------------------------------------------------------- Spark


def _chunks(chunk: int, path: str):
    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = model(path).longest
        for batch in batches:
            for row, doc, key, text in zip(*(batch.column(c) for c in ("row", "doc_id", "mark", "text"))):
                s = escaped(text.as_py())
                many = -(-len(s) // chunk)
                for k in range(many):
                    low, high = max(0, k * chunk - margin), min(len(s), (k + 1) * chunk + margin)
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row.as_py(), "doc_id": doc.as_py(), "mark": key.as_py(), "k": k, "many": many, "left": k * chunk - low, "right": min((k + 1) * chunk, len(s)) - low, "part": s[low:high]}],
                        pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("k", pa.int32()), ("many", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("part", pa.string())]),
                    )

    return cut


def _matrices(path: str):
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            made = [m.matrix(r["part"], r["left"], r["right"]) for r in batch.select(["part", "left", "right"]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("k"), pa.array([x.shape[0] for x in made], pa.int32()), pa.array([x.tobytes() for x in made], pa.binary())], ["row", "k", "entries", "weights"]
            )

    return scan


def _run(group: pa.Table) -> tuple[list[dict], list[np.ndarray]]:
    rows = sorted(group.to_pylist(), key=lambda r: r["k"])
    return rows, [np.frombuffer(r["weights"]).reshape(r["entries"], -1) for r in rows]


def _product(group: pa.Table) -> pa.Table:
    """One matrix of a run of adjacent ones."""
    rows, matrices = _run(group)
    out = functools.reduce(plus, matrices)
    return pa.table({"row": [rows[0]["row"]], "k": pa.array([rows[0]["p"]], pa.int32()), "entries": pa.array([out.shape[0]], pa.int32()), "weights": pa.array([out.tobytes()], pa.binary())})


def _spread(group: pa.Table) -> pa.Table:
    """Of a run of adjacent matrices, each one's weights at both its boundaries, and the states chosen there."""
    rows, matrices = _run(group)
    given = lambda name, start: np.frombuffer(rows[0][name]) if rows[0][name] is not None else np.zeros(start)
    forward, back = boundary_weights(matrices, given("ahead", matrices[0].shape[0])[None, :], given("behind", matrices[-1].shape[1])[:, None])
    total = [f[0] + g[:, 0] for f, g in zip(forward, back)]
    if not all(np.isfinite(t.max()) for t in total):
        raise ValueError("no path through the document")
    state = pa.array([int(t.argmax()) for t in total], pa.int32())
    return pa.table({
        "row": [r["row"] for r in rows], "k": pa.array([r["k"] for r in rows], pa.int32()), "entry": state[:-1], "leave": state[1:],
        "ahead": pa.array([f.tobytes() for f in forward[:-1]], pa.binary()), "behind": pa.array([g.tobytes() for g in back[1:]], pa.binary()),
    })


def boundary_states(weights: DataFrame, widest: int, fan: int = FAN) -> DataFrame:
    """(row, k, entry, leave): the states at each chunk's boundaries, given the transfer matrices (row, k, entries, weights).

    Runs of ``fan`` adjacent matrices are multiplied, their products likewise, until a document has
    no more than ``fan``. Then weights at the boundaries are passed down level by level. No task
    gets more than ``fan`` matrices of a document at a time; ``widest`` is the most of any document.
    """
    parent = lambda df: df.withColumn("p", F.floor(F.col("k") / fan).cast("int"))
    levels = [weights]
    while widest > fan:
        levels[-1] = materialize(levels[-1], "matrices")
        levels.append(parent(levels[-1]).groupBy("row", "p").applyInArrow(_product, "row long, k int, entries int, weights binary"))
        widest = -(-widest // fan)
    chosen = None
    for nodes in map(parent, reversed(levels)):
        if chosen is None:
            nodes = nodes.withColumns({c: F.lit(None).cast("binary") for c in ("ahead", "behind")})
        else:
            nodes = nodes.join(chosen.select("row", F.col("k").alias("p"), "ahead", "behind"), ["row", "p"])
        chosen = nodes.groupBy("row", "p").applyInArrow(_spread, "row long, k int, entry int, leave int, ahead binary, behind binary")
    return chosen.select("row", "k", "entry", "leave")


def _traced(path: str):
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = []
            for r in batch.select(["part", "left", "right", "entry", "leave"]).to_pylist():
                start, stop = m.states(r["part"], r["left"])[r["entry"]][1], m.states(r["part"], r["right"])[r["leave"]][1]
                ids.append(m.encode(r["part"][start:stop]))
            yield pa.RecordBatch.from_arrays([*batch.select(["row", "doc_id", "mark", "k"]).columns, pa.array(ids, pa.list_(pa.int32()))], ["row", "doc_id", "mark", "k", "ids"])

    return scan


def _whole(path: str):
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 256):  # a few rows at a time: identifiers take more room than texts
                part = batch.slice(at, 256)
                ids = [m.encode(escaped(t.as_py())) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "mark", "ids"])

    return scan


def encode_pieces(docs: DataFrame, path: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, mark (a hash of the text), ids, n_chunks."""
    if chunk < 4 * model(path).longest:
        raise ValueError("chunks must be longer than pieces")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    giant = F.coalesce(F.char_length("text"), F.lit(0)) >= chunk
    small = rows.where(~giant).mapInArrow(_whole(path), "doc_id long, mark long, ids array<int>").withColumn("n_chunks", F.lit(1))

    large = rows.where(giant).withColumn("row", F.monotonically_increasing_id())
    cut = large.select("row", "doc_id", "mark", "text").mapInArrow(_chunks(chunk, path), "row long, doc_id long, mark long, k int, many int, left int, right int, part string")
    cut = materialize(cut.repartition("row", "k"), "chunks")
    weights = cut.mapInArrow(_matrices(path), "row long, k int, entries int, weights binary")
    chosen = boundary_states(weights, cut.agg(F.max("many")).first()[0] or 0, fan)
    traced = cut.join(chosen, ["row", "k"]).mapInArrow(_traced(path), "row long, doc_id long, mark long, k int, ids array<int>")
    whole = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"), F.count(F.lit(1)).cast("int").alias("n_chunks"))
    return small.unionByName(whole.drop("row"))


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``, the text that its ids stand for."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for i, j in slices(batch.column("ids").offsets.to_numpy()):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, m.decode_lists(part.column("ids"))], [*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(scan, fields + ", decoded string")
