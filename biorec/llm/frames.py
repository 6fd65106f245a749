"""Fill-in-middle transformation over seekable compressed frames.

1. ``store_frames`` cuts each text into frames of ``UNITS`` code points, compresses every frame as a
   zstandard frame of its own, and keeps them in order with the cumulative number of units at each
   frame's end. A row holds a text's frames; the store is a table like any other.
2. ``fill_in_middle`` draws a form and two cuts for each text from the SHA-256 of its id. Only the
   frames that a cut goes through are decompressed (and their parts compressed again); all others are
   taken over as they are. The output is a row of frames, too, with the marks between its parts.
3. ``digests`` streams an output's frames in order, one at a time, for its checksum; and finds the
   marks, seeks the parts and streams them in the text's own order for the checksum of the restored
   text. ``texts`` and ``restored`` give the texts themselves.

A unit is a code point. Forms: ``plain`` is the text itself, ``psm`` is prefix, suffix, middle with a
mark before each, ``spm`` is suffix, prefix, middle. A null text is empty; an empty text, and one that
holds a mark, is plain. Rows equal in id get the same draws; a null id draws as ``null``. Texts are
whole; of a long one no more than two frames are held decompressed. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biorec.llm.common import doc_key

#: Code points in a frame.
UNITS = 1 << 14
LEVEL = 3
SEED = "1:"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, so many are not plain, and of those so many are spm.
CHANGED, SUFFIX_FIRST = 90, 20
#: The order of the parts in each form.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_FRAMES = "frames array<binary>, ends array<long>"


class Frames:
    """The frames of one text, in order; ``ends`` has the units up to each frame's end."""

    def __init__(self, frames: list[bytes], ends: list[int]):
        self.frames, self.ends = frames, ends
        self.units = ends[-1] if ends else 0
        self._held: dict[int, str] = {}

    def read(self, k: int) -> str:
        if k not in self._held:
            if len(self._held) == 2:
                self._held.pop(next(iter(self._held)))
            self._held[k] = zstandard.ZstdDecompressor().decompress(self.frames[k]).decode()
        return self._held[k]

    def parts(self, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        """The frames that hold the units from ``low`` to ``high``: number, from and to within the frame, the frame's units."""
        k = bisect_right(self.ends, low)
        while low < high:
            start = self.ends[k - 1] if k else 0
            end = min(high, self.ends[k])
            yield k, low - start, end - start, self.ends[k] - start
            low, k = end, k + 1

    def cut(self, low: int, high: int) -> Iterator[tuple[bytes, int]]:
        """Frames of these units, and the units of each: whole frames as they are, parts compressed anew."""
        for k, i, j, units in self.parts(low, high):
            yield (self.frames[k] if j - i == units else packed(self.read(k)[i:j])), j - i

    def stream(self, low: int, high: int) -> Iterator[str]:
        for k, i, j, _ in self.parts(low, high):
            yield self.read(k)[i:j]

    def find(self, marks: tuple[str, ...]) -> dict[str, int]:
        """The unit at which each mark begins, wherever frames end."""
        found, tail = {}, ""
        for k in range(len(self.frames)):
            text = tail + self.read(k)
            for m in marks:
                if m not in found and (at := text.find(m)) >= 0:
                    found[m] = self.ends[k] - len(text) + at
            tail = text[-(max(map(len, marks)) - 1) :]
        return found


def packed(text: str) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(text.encode())


def _collected(parts: Iterator[tuple[bytes, int]]) -> Frames:
    frames, ends, at = [], [], 0
    for frame, units in parts:
        at += units
        frames.append(frame)
        ends.append(at)
    return Frames(frames, ends)


def rearranged(text: Frames, form: str, first: int, second: int) -> Frames:
    """The output of a text in a form, cut after ``first`` and ``second`` units."""
    if form == "plain":
        return text
    spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, text.units)}

    def parts() -> Iterator[tuple[bytes, int]]:
        for mark in ORDER[form]:
            yield packed(mark), len(mark)
            yield from text.cut(*spans[mark])

    return _collected(parts())


def original(output: Frames, form: str) -> Iterator[str]:
    """The text that an output was made of, piece by piece, from the output and its form alone."""
    if form == "plain":
        yield from output.stream(0, output.units)
        return
    at = output.find(ORDER[form])
    ends = [*[at[m] for m in ORDER[form][1:]], output.units]
    spans = {m: (at[m] + len(m), end) for m, end in zip(ORDER[form], ends)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(*spans[mark])


# ---------------------------------------------------------------- tables


def store_frames(docs: DataFrame, units: int = UNITS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n (units), marked (holds a mark), frames, ends."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                rows.append(_collected((packed(p := text[k : k + units]), len(p)) for k in range(0, len(text), units)))
            yield _with_frames(batch.select(["doc_id", "marked"]), rows, {"n": pa.array([r.units for r in rows], pa.int64())})

    marked = F.coalesce(F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE), F.lit(False))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", marked.alias("marked"), "text").mapInArrow(scan, f"doc_id {id_type}, marked boolean, n long, {_FRAMES}")


def _with_frames(kept: pa.RecordBatch, rows: list[Frames], more: dict[str, pa.Array]) -> pa.RecordBatch:
    made = more | {"frames": pa.array([r.frames for r in rows], pa.list_(pa.binary())), "ends": pa.array([r.ends for r in rows], pa.list_(pa.int64()))}
    return pa.RecordBatch.from_arrays([*kept.columns, *made.values()], [*kept.schema.names, *made])


def _frames_of(batch: pa.RecordBatch) -> Iterator[Frames]:
    for frames, ends in zip(batch.column("frames"), batch.column("ends")):
        yield Frames(frames.as_py(), ends.as_py())


def drawn(store: DataFrame) -> DataFrame:
    """``store`` with form, prefix_chars and middle_chars (null where plain)."""
    digest = F.sha2(F.concat(F.lit(SEED), doc_key()).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= CHANGED)
    form = F.when(plain, "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    first = F.least(one, two)
    out = store.withColumns({"form": form, "prefix_chars": first, "middle_chars": F.greatest(one, two) - first})
    return out.withColumns({c: F.when(F.col("form") != "plain", F.col(c)) for c in ("prefix_chars", "middle_chars")})


def fill_in_middle(store: DataFrame) -> DataFrame:
    """Outputs of a store's texts: doc_id, n, form, prefix_chars, middle_chars, frames, ends."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(["doc_id", "n", "form", "prefix_chars", "middle_chars"])
            how = zip(*(kept.column(c).to_pylist() for c in ("form", "prefix_chars", "middle_chars")))
            yield _with_frames(kept, [rearranged(text, form, p or 0, (p or 0) + (m or 0)) for text, (form, p, m) in zip(_frames_of(batch), how)], {})

    id_type = store.schema["doc_id"].dataType.simpleString()
    rows = drawn(store).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "frames", "ends")
    return rows.mapInArrow(scan, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, {_FRAMES}")


def _mapped(outputs: DataFrame, made: dict[str, Callable[[Frames, str], str]], kept: list[str]) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[f(x, form) for f in made.values()] for x, form in zip(_frames_of(batch), batch.column("form").to_pylist())]
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(made))]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *columns], [*kept, *made])

    schema = ", ".join([f"{c} {outputs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} string" for c in made])
    return outputs.select(*dict.fromkeys([*kept, "form", "frames", "ends"])).mapInArrow(scan, schema)


def _checksum(parts: Iterator[str]) -> str:
    out = hashlib.sha256()
    for p in parts:
        out.update(p.encode())
    return out.hexdigest()


def digests(outputs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = {"output_sha256": lambda x, form: _checksum(x.stream(0, x.units)), "restored_sha256": lambda x, form: _checksum(original(x, form))}
    return _mapped(outputs, made, ["doc_id", "n", "form", "prefix_chars", "middle_chars"])


def texts(outputs: DataFrame) -> DataFrame:
    """doc_id, form and the whole output."""
    return _mapped(outputs, {"output": lambda x, form: "".join(x.stream(0, x.units))}, ["doc_id", "form"])


def restored(outputs: DataFrame) -> DataFrame:
    """doc_id and the text that each output was made of."""
    return _mapped(outputs, {"text": lambda x, form: "".join(original(x, form))}, ["doc_id"])


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
d AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, substr(text, 1, least(x, y)) AS p, substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substr(text, greatest(x, y) + 1) AS s FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(x, y) - least(x, y) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""
