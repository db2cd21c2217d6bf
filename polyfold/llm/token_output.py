"""Token-ID output: documents as tokenizer ids in range-coded segments, in ascending order of their ids.

The tokenizer splits text into pieces at fixed places before it merges (ASCII white space can be found by
itself), so the ids of a piece don't depend on what is around it. Each worker asks the tokenizers library once
for each distinct piece, and the ids of documents are put together in numpy. Texts with other white space or
the text of a special token go through the library as a whole.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyfold.llm import common as C
from polyfold.llm import token_coder as K

#: Texts of about so many bytes make a segment.
SEGMENT_BYTES = 20 << 20
#: Distinct pieces that a worker remembers, beyond which it starts anew; slots to find them by.
CACHE_PIECES, SLOT_BITS = 2_500_000, 22
#: White space that \\s takes in Unicode but the kernels don't, as the lead bytes of its UTF-8.
_OTHER = np.zeros(256, bool)
_OTHER[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_OTHER_SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\v\f\r")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _strings(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[x:y].decode("utf-8", "replace") for x, y in zip(a.tolist(), b.tolist())]


class PieceEncoder:
    """Ids of whole texts, with remembered pieces for byte-level BPE tokenizers; others see every text whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        split = self.library.pre_tokenizer
        self.by_pieces = self.library.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel) and not split.add_prefix_space
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.forget()

    def forget(self) -> None:
        # What was learned, in order of learning; and for two parts of a key the piece that last had it.
        self.keys, self.first, self.count = (np.zeros(1 << 16, t) for t in (C.U64, np.int64, np.int64))
        self.n = 1  # piece 0 is none
        self.slots = [np.zeros(1 << SLOT_BITS, np.int32) for _ in range(2)]
        self.ids = np.zeros(0, np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of keys: their upper bits, and others."""
        return (keys >> C.U64(64 - SLOT_BITS)).view(np.int64), (keys & C.U64((1 << SLOT_BITS) - 1)).view(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, 0 where it is not known or has lost both slots to others (it is then learned again)."""
        one, two = self._places(keys)
        piece = self.slots[0].take(one)
        miss = np.flatnonzero(self.keys.take(piece) != keys)
        other = self.slots[1].take(two[miss])
        ok = self.keys.take(other) == keys[miss]
        piece[miss] = np.where(ok, other, 0)
        return piece

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has."""
        got = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.array([len(x) for x in got], np.int64)
        return np.fromiter((i for x in got for i in x), np.uint16, int(count.sum())), count

    def _lines(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the pieces from a to b of data, without line breaks, many in one call: breaks between them are pieces of their own."""
        if self.line is None:
            return self._each(_strings(data, a, b))
        ids, counts = [], []
        for i in range(0, len(a), 256):
            first, size = a[i : i + 256], (b - a)[i : i + 256]
            # The pieces one after another, each closed by a line break.
            end = np.cumsum(size + 1)
            text = np.full(int(end[-1]), 10, np.uint8)
            inside = np.ones(len(text), bool)
            inside[end - 1] = False
            text[inside] = data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            got = np.array(self.library.encode_batch_fast([text.tobytes().decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint16)
            at = np.flatnonzero(got == self.line)
            if len(at) != len(size):  # a piece ends in white space of another kind, which joins the break
                got, count = self._each(_strings(data, first, first + size))
            else:
                count = np.diff(at, prepend=-1) - 1
                got = got[got != self.line]
            ids.append(got)
            counts.append(count)
        return np.concatenate([*ids, np.zeros(0, np.uint16)]), np.concatenate([*counts, np.zeros(0, np.int64)])

    def _learn(self, keys: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """The pieces from a to b of data. keys: sorted, and none of them known."""
        word = ~C.IS_SEP[data[b - 1]]  # pieces are words, with what is before them, or separators
        count = np.zeros(len(keys), np.int64)
        first = np.zeros(len(keys), np.int64)
        at = len(self.ids)
        parts = [self.ids]
        for rows, how in ((np.flatnonzero(word), self._lines), (np.flatnonzero(~word), lambda *x: self._each(_strings(*x)))):
            ids, n = how(data, a[rows], b[rows])
            count[rows], first[rows] = n, at + np.cumsum(n) - n
            at += len(ids)
            parts.append(ids)
        self.ids = np.concatenate(parts)
        room = self.n + len(keys)
        if room > len(self.keys):
            self.keys, self.first, self.count = (np.concatenate([x, np.zeros(max(len(x), room), x.dtype)]) for x in (self.keys, self.first, self.count))
        new = np.arange(self.n, room)
        self.keys[new], self.first[new], self.count[new] = keys, first, count
        self.n = room
        for slot, place in zip(self.slots, self._places(keys)):
            slot[place] = new

    def _odd(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Documents that the library must see whole."""
        out = np.zeros(len(offs) - 1, bool)
        lead = np.flatnonzero(_OTHER[data])
        for d in np.unique(np.searchsorted(offs, lead, "right") - 1):
            out[d] = not _OTHER_SPACES.isdisjoint(data[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"))
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                out[np.searchsorted(offs, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents one after another, each closed by end, and how many ids each has."""
        if not self.by_pieces:
            raw = data.tobytes()
            ids, sizes = self._each([raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])
            return np.insert(ids, np.cumsum(sizes), np.uint16(end)), sizes + 1
        n_docs = len(offs) - 1
        sep = C.IS_SEP[data]
        # Pieces begin at documents, at words (with one space before them), and at the last separator before a word
        # if that is no space; what separators come before them is one piece.
        begin = np.zeros(len(data) + 1, bool)
        begin[offs] = True
        doc_start = begin[: len(data)].copy()
        word = np.flatnonzero(~sep & (np.concatenate([[True], sep[:-1]]) | doc_start)) if len(data) else np.zeros(0, np.int64)
        led = word[(word > 0) & ~doc_start[word]]
        spaced = data[led - 1] == 32
        begin[led - 1] = True
        begin[led[~spaced]] = True
        begin[word[doc_start[word]]] = True
        run = np.flatnonzero(sep & ~np.concatenate([[True], sep[:-1]]))  # separators after a word
        begin[run] = True
        begin = np.flatnonzero(begin[: len(data)])
        stop = np.append(begin[1:], len(data))
        keys = C.string_hash(data, begin, stop)
        if self.n > CACHE_PIECES:
            self.forget()
        piece = self._find(keys)
        new = np.flatnonzero(piece == 0)
        if len(new):
            u, where = np.unique(keys[new], return_index=True)
            w = new[where]
            self._learn(u, data, begin[w], stop[w])
            piece[new] = self.n - len(u) + np.searchsorted(u, keys[new])
        first, count = self.first.take(piece), self.count.take(piece)
        # Room for the end ids: a piece of one id after each document's last piece.
        piece_of = np.searchsorted(begin, offs)
        total = np.concatenate([[0], np.cumsum(count)])
        sizes = total[piece_of[1:]] - total[piece_of[:-1]] + 1
        out = np.full(int(sizes.sum()), end, np.uint16)
        to = np.ones(len(out), bool)
        ends = np.cumsum(sizes) - 1
        to[ends] = False
        source = np.repeat(first - total[:-1], count) + np.arange(total[-1])
        out[to] = self.ids[source]
        odd = np.flatnonzero(self._odd(data, offs))
        if len(odd):
            parts = np.split(out, ends[:-1] + 1) if n_docs else []
            for d in odd:
                text = data[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace")
                parts[d] = np.array([*self.library.encode(text, add_special_tokens=False).ids, end], np.uint16)
                sizes[d] = len(parts[d])
            out = np.concatenate(parts)
        return out, sizes


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_segments(docs: DataFrame, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the segments and returns them as read back: part, segment, doc_ids, sizes, ids (coded bytes), n_ids.

    Documents are range-partitioned and sorted by id (nulls first; rows that repeat an id by the hash of their
    text), so parts and, in them, segments follow each other in ascending order of ids. A segment holds
    whole documents of about SEGMENT_BYTES of text; a longer document has a segment of its own.
    """
    spark = docs.sparkSession
    at = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    at = at.repartitionByRange(*order).sortWithinPartitions(*order)

    from pyspark import TaskContext

    def run(batches):
        part, segment = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def flush():
            nonlocal held, size, segment
            ids = np.concatenate([x[1] for x in held])
            coded = K.encode_segment(ids)
            one = {"part": [part], "segment": [segment], "doc_ids": [pa.concat_arrays([x[0] for x in held]).to_pylist()], "sizes": [np.concatenate([x[2] for x in held]).tolist()], "ids": [coded], "n_ids": [len(ids)]}
            held, size, segment = [], 0, segment + 1
            return pa.RecordBatch.from_pydict(one, schema=want)

        coder = encoder(tokenizer)
        for batch in batches:
            for i, j, data, offs in C.pieces(batch.column(1)):
                held.append((batch.column(0).slice(i, j - i), *coder.encode(data, offs, end)))
                size += len(data)
                if size >= SEGMENT_BYTES:
                    yield flush()
        if held:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = "part int, segment int, doc_ids array<long>, sizes array<long>, ids binary, n_ids long"
    want = to_arrow_schema(_parse_datatype_string(schema))
    return C.written(at.mapInArrow(run, schema), spark)


def read_segments(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from segments; with_ids adds ids (uint32 bytes).

    start counts the ids of all documents before. Only the number of ids of each part goes to the driver.
    """
    sums = {(r["part"]): r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part], total = total, total + sums[part]
    from pyspark.sql import Window

    w = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offset = segments.select("part", "segment", "n_ids").withColumn("in_part", F.coalesce(F.sum("n_ids").over(w), F.lit(0))).select("part", "segment", "in_part")
    rows = segments.join(offset, ["part", "segment"]).select("part", "in_part", "doc_ids", "sizes", "ids")

    def run(batch: pa.RecordBatch):
        for r in range(batch.num_rows):
            ids = K.decode_segment(batch.column("ids")[r].as_buffer().to_pybytes())
            sizes = np.array(batch.column("sizes")[r].values, np.int64)
            end = np.cumsum(sizes)
            begin = end - sizes
            raw = ids.astype("<u4")
            crc = np.array([K.crc(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())], np.int64)
            base = before[batch.column("part")[r].as_py()] + batch.column("in_part")[r].as_py()
            out = {"doc_id": batch.column("doc_ids")[r].values, "start": base + begin, "n_tokens": sizes, "ids_crc32": crc}
            if with_ids:
                out["ids"] = pa.array([raw[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
            yield out

    return C.arrow_map(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_files(docs: DataFrame, tokenizer: str | None = None, end: int = 2, with_ids: bool = False, **columns) -> DataFrame:
    """Encodes docs, writes the segments, reads them back: doc_id, start, n_tokens, ids_crc32 of every row.

    Null and empty texts have the end id only. Very long texts are whole, in a segment of their own. Null ids come
    first; rows that repeat an id stand side by side, by a hash of their texts, and equal rows give equal rows but for start. An
    empty table gives an empty table. Other columns are not read. A damaged segment raises an error, and so does an
    id of 65,535 or more.
    """
    return read_segments(write_segments(docs, tokenizer or default_tokenizer(), end, **columns), with_ids)
