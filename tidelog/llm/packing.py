"""Packing token sequences: best-fit over the histogram of lengths, then pieces take planned slots by rank."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batched, ranged, stored

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0
#: Ids of so many tokens are kept by each worker.
CACHE = 400_000

#: Texts of these characters are cut at white space and in the simple classes below; for others the library does all.
_SIMPLE = re.compile("[\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-z0-9à-öø-ÿß]+")


class _Ids(dict):
    """Little-endian 32-bit ids of a lower-case token without white space, of two generations of tokens."""

    def __init__(self, model):
        super().__init__()
        self.model, self.old = model, {}
        printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        self.bytes = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, token: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(token)
        if ids is None:
            pieces = [token] if token.isalpha() else _PIECES.findall(token)
            if len(pieces) > 1:
                ids = b"".join([self[x] for x in pieces])
            else:
                shown = token if token.isascii() else token.encode().decode("latin-1").translate(self.bytes)
                ids = b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(shown)])
        self[token] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts under a tokenizer file of the kind NFC, lower case, pieces, byte-level BPE with word ends.

    The library's own BPE gives the ids of each piece; as a piece never spans white space, tokens
    between white space are looked up in a bounded cache. A text with other than plain characters, or
    with what may be a special token, goes to the library whole. `pieces_agree` says whether the file
    is of that kind; if not, all texts do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.ids = _Ids(self.whole.model)
        probe = "It's a naïve-ish Straße, 42.5% of 'em they'll re're   Ünder_score don't\n\t#*$ ÉÀÿ x@mail.com\r\n ''s 's'"
        self.pieces_agree = self._simple(probe) == self._whole(probe)

    def _whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)

    def _simple(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, text.lower().split()))

    def __call__(self, text: str) -> bytes:
        if self.pieces_agree and "<|" not in text and _SIMPLE.fullmatch(text):
            return self._simple(text)
        return self._whole(text)


_loaded: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each row's ids and then `end`, cut after every `capacity` ids.

    Null text: empty, so `end` alone. Repeated rows give repeated pieces. tokenizer_path must exist on all executors.
    """

    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded.get(tokenizer_path) or _loaded.setdefault(tokenizer_path, WordTokenizer(tokenizer_path))
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer(text or "") + end.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank_from, rank_to, per_bin, first_bin, offset).

    Items of a length with ranks in [rank_from, rank_to) fill bins from first_bin on, per_bin to each,
    one after another from offset. Each item goes to the fullest open bin that it fits; bins of equal
    room are alike, so runs of them are filled at once and the plan's size follows the histogram's.
    """
    rows, rooms, open_bins, bins = [], [], {}, 0

    def offer(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in open_bins:
                insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room, first = capacity, bins
                count = -(-left // (capacity // length))
                bins += count
            each = room // length
            used = min(count, left // each)
            if used:
                rows.append((length, rank, rank + used * each, each, first, capacity - room))
                offer(room - each * length, first, used)
                rank, left = rank + used * each, left - used * each
            if used < count and 0 < left < each:
                rows.append((length, rank, rank + left, left, first + used, capacity - room))
                offer(room - left * length, first + used, 1)
                used, rank, left = used + 1, rank + left, 0
            offer(room, first + used, count - used)
    return rows


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (as `pieces` gives them) with sequence_id and offset.

    Only the histogram of lengths, at most `capacity` rows, comes to the driver. A piece's rank within
    its length comes from a distributed sort; the plan's intervals join by length and rank. Sequences
    are filled without gaps from offset 0. Empty table: empty result.
    """
    spark = cut.sparkSession
    cut = stored(cut, "cut")  # the range partitioner samples its input, which would make the ids twice
    by = [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")]
    placed = stored(ranged(cut, by), "pieces")
    parts = placed.groupBy("length", "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    parts = stored(parts.withColumn("_rank", F.sum("_n").over(Window.partitionBy("length").orderBy("_pid")) - F.col("_n")), "length-parts")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = spark.createDataFrame(plan(histogram, capacity), "_length long, _from long, _to long, _each long, _bin long, _offset long")
    at = placed.join(parts, ["length", "_pid"]).withColumn("_r", F.col("_rank") + F.col("_idx") - F.col("_first"))
    inside = (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to"))
    step = F.col("_r") - F.col("_from")
    return at.join(F.broadcast(table), inside).select(  # the plan's size is bounded by that of the histogram
        *cut.columns,
        (F.col("_bin") + F.floor(step / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + step % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )
