"""Alignment of two tokenizers over the same bytes, by products of sparse incidence matrices.

A matrix has a row for each token and a column for each byte, in compressed sparse rows. The product
of one tokenizer's matrix with the other's transpose has an entry for each pair of tokens that
overlap; bytes after which tokens of both end cut the tokens into groups, and the product of the
group matrices has an entry for each pair in a shared group. Products go row by row (Gustavson):
the rows of the right matrix that a row of the left one points at are gathered and merged.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tableferry.llm.tables import kept, named, steps, utf8

#: Text bytes whose matrices are held at once; text bytes of a chunk, the unit that gets a table of
#: pair counts; scalar products of one block of rows.
STEP_BYTES, CHUNK_BYTES, BLOCK = 1 << 19, 8 << 20, 1 << 18
#: An id pair is one number; both vocabularies are smaller than this.
IDS = 1 << 16


@dataclass
class Csr:
    """A sparse 0/1 matrix: row i has the columns idx[ptr[i]:ptr[i + 1]]."""

    ptr: np.ndarray
    idx: np.ndarray
    width: int

    def transposed(self) -> Csr:
        counts = np.bincount(self.idx, minlength=self.width)
        rows = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        ordered = self.idx[:-1] <= self.idx[1:]
        if not ordered.all():
            rows = rows[np.argsort(self.idx, kind="stable")]
        return Csr(np.concatenate(([0], np.cumsum(counts))), rows, len(self.ptr) - 1)


def spans_matrix(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: a token's columns are the bytes it covers."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(ends, np.arange(ends[-1]), int(ends[-1]))


def work(left: Csr, right: Csr) -> np.ndarray:
    """Scalar products of each row of left times right, summed up to and without the row (the symbolic phase)."""
    per_entry = np.diff(right.ptr)[left.idx]
    return np.concatenate(([0], np.cumsum(per_entry)))[left.ptr]


def product(left: Csr, right: Csr) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries (row, column) of left times right, in blocks of rows; entries of a block are in order."""
    done, last, first = work(left, right), len(left.ptr) - 1, 0
    while first < last:
        stop = max(first + 1, int(np.searchsorted(done, done[first] + BLOCK, "right")) - 1)
        chosen = left.idx[left.ptr[first] : left.ptr[stop]]
        counts = right.ptr[chosen + 1] - right.ptr[chosen]
        before = np.cumsum(counts) - counts
        column = right.idx[np.repeat(right.ptr[chosen] - before, counts) + np.arange(int(counts.sum()))]
        row = np.repeat(np.arange(first, stop), done[first + 1 : stop + 1] - done[first:stop])
        key = row * right.width + column
        if len(key) > 1 and not (key[:-1] <= key[1:]).all():
            key.sort()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        yield key // right.width, key % right.width
        first = stop


# The files of the two vocabularies.
BYTE_LEVEL_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary_files(folder: str) -> tuple[str, bytes]:
    """Both vocabularies as read on the driver: a few megabytes, sent to the executors with the code."""
    with open(os.path.join(folder, BYTE_LEVEL_FILE), encoding="utf-8") as file:
        byte_level = file.read()
    with open(os.path.join(folder, PIECE_FILE), "rb") as file:
        return byte_level, file.read()


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters
    stand for themselves, all other bytes, in order, have the characters from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: how the byte-level vocabulary cuts a text before merging.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Both tokenizers with the bytes of their entries; `encode` gives the ids of a text, or none."""

    def __init__(self, byte_level: str, piece_model: bytes):
        import sentencepiece
        import tiktoken

        alphabet, self._byte_level, self._fallback = _alphabet(), byte_level, None
        content = json.loads(byte_level)
        special = {t["id"] for t in content["added_tokens"]}
        entries = {i: bytes(alphabet[c] for c in entry) for entry, i in content["model"]["vocab"].items() if i not in special}
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        # Ids follow the order of the merges, so they are the ranks by which merges are chosen.
        self._a = tiktoken.Encoding("byte_level", pat_str=CUTS, mergeable_ranks={b: i for i, b in entries.items()}, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = [(self._b.id_to_piece(i), self._b.is_byte(i)) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]

    def _ids_a(self, text: str) -> list[int]:
        try:
            return self._a.encode_ordinary(text)
        except BaseException as error:  # the pattern engine panics on runs beyond its backtracking limit
            if isinstance(error, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                raise
            if self._fallback is None:
                from tokenizers import Tokenizer

                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                self._fallback = Tokenizer.from_str(self._byte_level)
                self._fallback.encode_special_tokens = True
            return self._fallback.encode(text, add_special_tokens=False).ids

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space+text by both; none where the bytes of either don't join to space+text."""
        none = np.zeros(0, np.uint16), np.zeros(0, np.uint16)
        try:
            decoded = text.decode("utf-8")
        except UnicodeDecodeError:
            return none
        if not text:
            return none
        a, b, whole = self._ids_a(" " + decoded), self._b.encode(decoded), b" " + text
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return none
        return np.array(a, np.uint16), np.array(b, np.uint16)


def token_lengths(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every entry of both vocabularies."""
    both = Tokenizers(*vocabulary_files(folder))
    return tuple(np.array([len(x) for x in table]) for table in (both.a_bytes, both.b_bytes))


class Aligned:
    """The tokens of several documents as one block-diagonal pair of matrices."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.a, self.b = np.concatenate([np.zeros(0, np.uint16), *a]), np.concatenate([np.zeros(0, np.uint16), *b])
        self.a_stops, self.b_stops = np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])
        self.spans_a, self.spans_b = spans_matrix(a_lengths[self.a]), spans_matrix(b_lengths[self.b])
        #: Bytes after which tokens of both end; the last one of a document always is.
        self.cuts = np.intersect1d(self.spans_a.ptr[1:], self.spans_b.ptr[1:], assume_unique=True)
        self.group_a = np.searchsorted(self.cuts, self.spans_a.ptr[1:])
        self.group_b = np.searchsorted(self.cuts, self.spans_b.ptr[1:])

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (a, b) of tokens that share bytes."""
        return product(self.spans_a, self.spans_b.transposed())

    def _groups(self) -> tuple[Csr, Csr]:
        groups = len(self.cuts)
        left = Csr(np.arange(len(self.a) + 1), self.group_a, groups)
        return left, Csr(np.arange(len(self.b) + 1), self.group_b, groups).transposed()

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (a, b) of tokens in the same group."""
        return product(*self._groups())

    def n_shared(self) -> np.ndarray:
        """Entries of the group product up to each document's end, from its symbolic phase."""
        return work(*self._groups())[self.a_stops]

    def n_groups(self) -> np.ndarray:
        """Groups up to each document's end."""
        ends = self.spans_a.ptr[self.a_stops]
        return np.searchsorted(self.cuts, ends, "right")

    def codes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the a token, id pair) of each overlap."""
        for row, column in self.overlaps():
            yield row, self.a[row].astype(np.int64) * IDS + self.b[column]

    def group_texts(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` for each document: the ids of each group."""
        groups = len(self.cuts)
        in_a, in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]
        last_a = np.append(self.group_a[1:] != self.group_a[:-1], True)[: len(self.a)]
        last_b = np.append(self.group_b[1:] != self.group_b[:-1], True)[: len(self.b)]
        # Words of a small table: an id with the sign that follows it.
        words = np.empty(len(self.a) + len(self.b), np.int64)
        words[place_a] = self.a.astype(np.int64) * 3 + last_a
        words[place_b] = self.b.astype(np.int64) * 3 + 2 * last_b
        table = [f"{i}{sign}" for i in range(int(words.max(initial=0)) // 3 + 1) for sign in ",|;"]
        stops, start, texts = (self.a_stops + self.b_stops).tolist(), 0, []
        for stop in stops:
            texts.append("".join([table[w] for w in words[start:stop].tolist()])[:-1])
            start = stop
        return texts


def _deltas(stops: np.ndarray) -> np.ndarray:
    return np.diff(stops, prepend=0)


def _sorted_counts(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)


# A chunk is a bounded number of documents of one partition; its last row holds its pairs instead of a document.
CHUNK_SCHEMA = (
    "chunk string, doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint,"
    " groups string, a binary, b binary, pairs binary, pair_counts binary"
)
LENGTHS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def _id_type(docs: DataFrame, id_col: str) -> str:
    return docs.select(docs[f"`{id_col}`"]).schema[0].dataType.simpleString()


def chunks(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's tokens and groups, in chunks, and the counts of the id pairs of each chunk."""
    (byte_level, piece_model), (a_lengths, b_lengths) = vocabulary_files(folder), token_lengths(folder)
    schema = T.StructType.fromDDL(CHUNK_SCHEMA.format(id=_id_type(docs, id_col)))
    arrow = _arrow_schema(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(byte_level, piece_model)
        pack, part = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        number = held = 0
        codes, counts = [], []

        def of(columns: dict) -> pa.RecordBatch:
            arrays = [c if isinstance(c := columns.get(f.name), pa.Array) else pa.array(c, f.type) for f in arrow]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        def totals() -> pa.RecordBatch:
            pairs, times = _sorted_counts(codes, counts)
            packed = {"pairs": [pack.compress(pairs.tobytes())], "pair_counts": [pack.compress(times.tobytes())]}
            return of({f.name: [None] for f in arrow} | {"chunk": [f"{part}-{number}"]} | packed)

        for batch in steps(batches, most=STEP_BYTES):
            texts = utf8(batch)
            ids = [both.encode(t) for t in texts]
            step = Aligned([a for a, _ in ids], [b for _, b in ids], a_lengths, b_lengths)
            links = np.zeros(len(step.a), np.int64)
            for row, code in step.codes():
                links[row[0] : row[-1] + 1] += np.bincount(row - row[0])
                distinct, times = np.unique(code, return_counts=True)
                codes.append(distinct)
                counts.append(times)
            link_stops = np.concatenate(([0], np.cumsum(links)))[step.a_stops]
            rows = batch.num_rows
            columns = {
                "chunk": [f"{part}-{number}"] * rows,
                "doc_id": batch.column(0),
                "groups": step.group_texts(),
                "a": [pack.compress(a.tobytes()) for a, _ in ids],
                "b": [pack.compress(b.tobytes()) for _, b in ids],
                "pairs": [None] * rows,
                "pair_counts": [None] * rows,
            }
            for name, stops in zip(LENGTHS, (step.a_stops, step.b_stops, step.n_groups(), link_stops, step.n_shared())):
                columns[name] = _deltas(stops)
            yield of({k: pa.array(c) if isinstance(c, np.ndarray) else c for k, c in columns.items()})
            held += sum(map(len, texts))
            if held > CHUNK_BYTES - STEP_BYTES:
                yield totals()
                number, held = number + 1, 0
                codes, counts = [], []
        if held:
            yield totals()

    return named(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema)


def _arrow_schema(docs: DataFrame, id_col: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(CHUNK_SCHEMA.format(id=_id_type(docs, id_col))))


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for chunk, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "pair_counts"))):
            codes = np.frombuffer(unpack.decompress(pairs), np.int64)
            arrays = [pa.array([chunk] * len(codes), pa.string()), pa.array(codes), pa.array(np.frombuffer(unpack.decompress(counts), np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["chunk", "pair", "n"])


def align(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, n_best, count_sum) of every row.

    `n_links` counts overlapping pairs of tokens, `n_shared` pairs in a shared group. The count of an
    id pair is its number of links in all of `docs`; `count_sum` adds it up over a document's links,
    and `n_best` counts the links whose pair has the highest count of its b id. Ties count as
    highest. Texts that are null, empty, not UTF-8, or that either tokenizer doesn't keep byte for
    byte have no tokens, zeros, and an empty groups_sha256. Repeated rows count each. The order and
    partitions of the rows don't matter.

    Pair counts are added up within chunks, then over all; every chunk gets back the counts of its
    own pairs, so no task holds more than a chunk and its pairs.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    written = chunks(docs, folder, id_col, text_col).select("*", digest).drop("groups")
    written = kept(written, "aligned")
    parts = written.filter("pairs IS NOT NULL").select("chunk", "pairs", "pair_counts")
    parts = kept(parts.mapInArrow(_pair_rows, "chunk string, pair bigint, n bigint"), "pairs")
    counts = kept(parts.groupBy("pair").agg(F.sum("n").alias("links")), "pair_counts")
    b_id = F.col("pair") % IDS
    best = counts.groupBy(b_id.alias("b_id")).agg(F.max("links").alias("most"))
    weighed = counts.withColumn("b_id", b_id).join(best, "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    needed = parts.select("chunk", "pair").join(weighed, "pair")
    rows = written.filter("pairs IS NULL").drop("pairs", "pair_counts")

    a_lengths, b_lengths = token_lengths(folder)
    out = T.StructType([f for f in rows.schema if f.name not in ("chunk", "a", "b")])
    out = out.add("n_best", T.LongType()).add("count_sum", T.DecimalType(38, 0))

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        order = np.argsort(pairs := right.column("pair").to_numpy())
        pairs, links = pairs[order], right.column("links").to_numpy()[order]
        is_best = right.column("best").to_numpy(zero_copy_only=False)[order]
        best, total = np.zeros(left.num_rows, np.int64), [0] * left.num_rows
        for first, stop in _pieces(left.column("n_a").to_numpy()):
            part = left.slice(first, stop - first)
            ids = [[np.frombuffer(unpack.decompress(x), np.uint16) for x in part.column(c).to_pylist()] for c in ("a", "b")]
            step = Aligned(*ids, a_lengths, b_lengths)
            for row, code in step.codes():
                place = np.searchsorted(pairs, code)
                doc = np.searchsorted(step.a_stops, row, "right") + first
                best += np.bincount(doc[is_best[place]], minlength=left.num_rows)
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                for d, s in zip(doc[starts].tolist(), _exact_sums(links[place], starts)):
                    total[d] += s
        columns = [left.column(f.name) for f in out[:-2]] + [pa.array(best), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))]
        return pa.table(columns, names=[f.name for f in out])

    return rows.groupBy("chunk").cogroup(needed.groupBy("chunk")).applyInArrow(weigh, out)


def _pieces(tokens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about a step's tokens; a longer document is a range by itself."""
    first = held = 0
    for i, n in enumerate(tokens.tolist()):
        if held and held + n > STEP_BYTES // 2:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(tokens):
        yield first, len(tokens)


def _exact_sums(values: np.ndarray, starts: np.ndarray) -> list[int]:
    """Sums of runs of values without overflow: high and low halves are added apart."""
    if not len(starts):
        return []
    low = np.add.reduceat(values & 0xFFFFFFFF, starts).tolist()
    high = np.add.reduceat(values >> 32, starts).tolist()
    return [(h << 32) + x for h, x in zip(high, low)]


def token_links(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shared: bool = False) -> DataFrame:
    """(doc_id, a, b, a_id, b_id): every pair of tokens that overlap or, with `shared`, that share a group.

    `a` and `b` are the places of the tokens in the document. Texts without tokens give no rows;
    repeated rows give theirs each.
    """
    (byte_level, piece_model), (a_lengths, b_lengths) = vocabulary_files(folder), token_lengths(folder)
    schema = T.StructType.fromDDL(f"doc_id {_id_type(docs, id_col)}, a bigint, b bigint, a_id int, b_id int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(byte_level, piece_model)
        for batch in steps(batches, most=STEP_BYTES):
            ids = [both.encode(t) for t in utf8(batch)]
            step = Aligned([a for a, _ in ids], [b for _, b in ids], a_lengths, b_lengths)
            for row, column in step.shared() if shared else step.overlaps():
                doc = np.searchsorted(step.a_stops, row, "right")
                first_a, first_b = (np.concatenate(([0], stops))[doc] for stops in (step.a_stops, step.b_stops))
                places = [pa.array(row - first_a), pa.array(column - first_b)]
                ids_of = [pa.array(step.a[row].astype(np.int32)), pa.array(step.b[column].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *places, *ids_of], ["doc_id", "a", "b", "a_id", "b_id"])

    return named(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema)
