"""Cross-tokenizer alignment: which tokens of one tokenizer cover which of another.

Two tokenizers cut the same bytes.  Where both have a token's end the text falls
into groups; inside a group every pair of tokens whose bytes overlap is a link.
The ends of either side are kept in a dictionary from end to index, the two key
sets are intersected, and the sorted common ends slice both id lists.

Texts are cut into units first, at blanks and single line feeds where neither
tokenizer can join what stands before with what stands behind, so each unit of a
block of documents is encoded and aligned once, however often it occurs.  A
block sums its own pairs of ids before anything is shuffled; the corpus-wide
counts come back to the block as one row.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .store import bounded_batches, stored
from .tokens import slices

#: Folder of the tokenizers' files on the driver; their bytes travel to the tasks.
FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A block of documents ends with so many bytes of text or so many units.
BLOCK_BYTES, BLOCK_UNITS = 32 << 20, 300_000
#: Bytes of units that are encoded in one call.
ENCODE_BYTES = 1 << 18

#: A part between blanks before and behind which texts may be cut: it begins with
#: a character that is surely no white space (after a line feed at most) and ends
#: with none; the piece tokenizer's sign for a blank is nowhere in it.
_SAFE = re.compile("\n?[!-~¡-ᙿ、-퟿](?:[^▁]*[^\\s▁])?")
_LOW = (1 << 32) - 1


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else the next from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Alignment(NamedTuple):
    """Groups and links of two id lists over the same bytes: ``ends`` of the groups, the index of both lists behind each, and the links with the byte that each ends at."""

    ends: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    links: np.ndarray
    link_ends: np.ndarray


def align(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> Alignment:
    """Align two lists of ids that cover the same bytes; sizes give the bytes of each id.

    A link is a pair of ids, A's in the upper half of 64 bits.  Inside a group two
    tokens overlap in one piece, and either side's ends delimit the pieces.
    """
    a_ends, b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    a_index = dict(zip(a_ends.tolist(), range(1, len(a) + 1)))
    b_index = dict(zip(b_ends.tolist(), range(1, len(b) + 1)))
    common = sorted(a_index.keys() & b_index.keys())
    pieces = np.union1d(a_ends, b_ends)
    links = a[np.searchsorted(a_ends, pieces)] << 32 | b[np.searchsorted(b_ends, pieces)]
    return Alignment(np.array(common, np.int64), np.array([a_index[e] for e in common], np.int64), np.array([b_index[e] for e in common], np.int64), links, pieces)


def shown_groups(a: list[str], b: list[str], found: Alignment) -> list[str]:
    """``a1,a2|b1`` for every group."""
    x, y = found.a_at.tolist(), found.b_at.tolist()
    return [f"{a[i]}|{b[j]}" if k - i == m - j == 1 else ",".join(a[i:k]) + "|" + ",".join(b[j:m]) for i, k, j, m in zip([0, *x], x, [0, *y], y)]


class Aligner:
    """Both tokenizers, and the bytes of every id."""

    def __init__(self, a_json: str, b_proto: bytes):
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_proto)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.a_shown, self.b_shown = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # texts may be cut into units only if no token reaches from one into the next
        parts = json.loads(a_json)
        plain = parts.get("normalizer") is None and parts.get("pre_tokenizer", {}).get("type") == "ByteLevel"
        plain = plain and not parts["pre_tokenizer"]["add_prefix_space"] and parts["pre_tokenizer"].get("use_regex", True)
        self.cuttable = plain and not any(re.search("\n|[^\u2581]\u2581", p) for p in pieces)

    def encode(self, raw: str) -> tuple[list[int], list[int]]:
        """Ids of both sides for a whole text with its blank in front, or for a unit, which may begin with a line feed."""
        a = self.a.encode(raw, add_special_tokens=False).ids
        if raw[:1] == " ":
            return a, self.b.encode(raw[1:], num_threads=1)
        return a, self.b.encode(raw, num_threads=1)[1:]  # the blank that the model puts in front joins no line feed

    def checked(self, raw: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides, or None if either doesn't give the text back byte by byte."""
        a, b = self.encode(raw)
        data = raw.encode()
        return (a, b) if b"".join([self.a_bytes[i] for i in a]) == data == b"".join([self.b_bytes[i] for i in b]) else None

    def aligned(self, raws: list[str]) -> Iterator[tuple[str | None, int, int, int, np.ndarray]]:
        """(groups, tokens of A, of B, number of groups, links) of units that may be encoded in one text, in order; groups are None for a unit that doesn't survive."""
        ids = self.checked(" x" + "".join(raws)) if raws else None
        if ids is None:
            for raw in raws:
                yield self.aligned_unit(raw)
            return
        a, b = (np.array(side, np.int64) for side in ids)
        found = align(a, b, self.a_size, self.b_size)
        shown = shown_groups([self.a_shown[i] for i in ids[0]], [self.b_shown[i] for i in ids[1]], found)
        ends = np.cumsum([2, *[len(r.encode()) for r in raws]])
        groups = np.searchsorted(found.ends, ends, "right")
        if not (found.ends[groups - 1] == ends).all():  # a token reaches from a unit into the next
            for raw in raws:
                yield self.aligned_unit(raw)
            return
        links = np.searchsorted(found.link_ends, ends, "right").tolist()
        n_a, n_b = np.diff(found.a_at[groups - 1]).tolist(), np.diff(found.b_at[groups - 1]).tolist()
        groups = groups.tolist()
        for k in range(len(raws)):
            yield ";".join(shown[groups[k] : groups[k + 1]]), n_a[k], n_b[k], groups[k + 1] - groups[k], found.links[links[k] : links[k + 1]]

    def aligned_unit(self, raw: str) -> tuple[str | None, int, int, int, np.ndarray]:
        """The same of a unit that is encoded alone."""
        ids = self.checked(raw)
        if ids is None:
            return None, 0, 0, 0, np.zeros(0, np.int64)
        a, b = (np.array(side, np.int64) for side in ids)
        found = align(a, b, self.a_size, self.b_size)
        return ";".join(shown_groups([self.a_shown[i] for i in ids[0]], [self.b_shown[i] for i in ids[1]], found)), len(a), len(b), len(found.ends), found.links


@lru_cache(maxsize=2)
def _aligner(a_json: str, b_proto: bytes) -> Aligner:
    return Aligner(a_json, b_proto)


def units_of(text: str, cuttable: bool = True) -> list[str]:
    """The text's units in order: a part between blanks, or several with their blanks where no cut is sure.

    A line feed that stands alone begins a part.  A unit of several parts is told
    by its blank in front or its blanks or line feeds inside; ``raw_unit`` gives
    the bytes that any unit stands for.
    """
    if not cuttable:
        return [" " + text]
    parts = text.replace("\n", " \n").split(" ")
    good = [_SAFE.fullmatch(p) is not None for p in parts]
    if all(good):
        return parts
    out, begin = [], 0
    for i in range(1, len(parts) + 1):
        if i == len(parts) or good[i] and good[i - 1]:
            out.append(parts[begin] if i == begin + 1 and good[begin] else (" " + " ".join(parts[begin:i])).replace(" \n", "\n"))
            begin = i
    return out


def raw_unit(unit: str) -> str:
    return unit if unit[:1] in (" ", "\n") else " " + unit


class Block:
    """Documents of one block: each distinct unit's alignment once, documents as lists of unit numbers."""

    def __init__(self, aligner: Aligner, digest: bool):
        self.aligner, self.digest, self.bytes = aligner, digest, 0
        self.codes: dict[str, int] = {}
        self.texts: list[str | None] = []
        self.n = array("q")  # tokens of a, of b and groups of each unit
        self.links, self.links_at = array("q"), array("q", [0])
        self.ids: list[int | None] = []
        self.groups: list[str] = []
        self.units, self.units_at = array("i"), array("q", [0])

    def _learn(self, units: list[str]) -> None:
        """Align new units: sure ones many in a call, others alone."""
        begin = size = 0
        sure = [u for u in units if _SAFE.fullmatch(u)]
        for i, unit in enumerate(sure):
            size += len(unit)
            if size >= ENCODE_BYTES or i == len(sure) - 1:
                part = sure[begin : i + 1]
                for u, found in zip(part, self.aligner.aligned([raw_unit(u) for u in part])):
                    self._keep(u, *found)
                begin, size = i + 1, 0
        for unit in units:
            if unit not in self.codes:
                self._keep(unit, *self.aligner.aligned_unit(raw_unit(unit)))

    def _keep(self, unit: str, shown: str | None, n_a: int, n_b: int, n_groups: int, links: np.ndarray) -> None:
        self.codes[unit] = len(self.texts)
        self.texts.append(shown)
        self.n.extend((n_a, n_b, n_groups))
        self.links.frombytes(links.tobytes())
        self.links_at.append(len(self.links))

    def add(self, ids: list[int | None], raws: list[bytes | None]) -> None:
        split: list[list[str]] = []
        for raw in raws:
            self.bytes += len(raw or b"")
            try:
                text = (raw or b"").decode()
            except UnicodeDecodeError:  # neither tokenizer could give the bytes back
                text = ""
            if not text:
                split.append([])
            elif self.aligner.cuttable:
                parts = text.replace("\n", " \n").split(" ")
                new = set(parts).difference(self.codes)
                split.append(parts if all(map(_SAFE.fullmatch, new)) else units_of(text))
            else:
                split.append(units_of(text, False))
        self._learn(list(dict.fromkeys(u for units in split for u in units if u not in self.codes)))
        for doc_id, units in zip(ids, split):
            codes = [self.codes[u] for u in units]
            texts = [self.texts[c] for c in codes]
            if None in texts:
                codes, texts = [], []
            shown = ";".join(texts)
            self.ids.append(doc_id)
            self.groups.append(hashlib.sha256(shown.encode()).hexdigest() if self.digest and shown else shown)
            self.units.extend(codes)
            self.units_at.append(len(self.units))

    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or len(self.texts) >= BLOCK_UNITS

    def row(self, name: str) -> pa.RecordBatch:
        """One row: the documents and units packed, and the block's pairs of ids with how often they are linked."""
        units, at = np.frombuffer(self.units, np.int32) if self.units else np.zeros(0, np.int32), np.frombuffer(self.units_at, np.int64)
        links, links_at = np.frombuffer(self.links, np.int64) if self.links else np.zeros(0, np.int64), np.frombuffer(self.links_at, np.int64)
        n = np.frombuffer(self.n, np.int64).reshape(-1, 3) if self.n else np.zeros((0, 3), np.int64)
        per_unit = np.diff(links_at)
        often = np.bincount(units, minlength=len(per_unit))
        pairs, place = np.unique(links, return_inverse=True)
        counts = np.bincount(place, np.repeat(often, per_unit), len(pairs)).astype(np.int64)
        docs = {"doc_id": pa.array(self.ids, pa.int64()), "groups": pa.array(self.groups, pa.large_string()), "units": pa.LargeListArray.from_arrays(at, units)}
        docs |= {c: pa.array(_sums(values[units], at)) for c, values in zip(("n_a", "n_b", "n_groups", "n_links"), (n[:, 0], n[:, 1], n[:, 2], per_unit))}
        linked = {"places": pa.LargeListArray.from_arrays(links_at, place.astype(np.int32))}
        used = np.flatnonzero(counts)
        told = pa.StructArray.from_arrays([pa.array(used.astype(np.int32)), pa.array(pairs[used]), pa.array(counts[used])], names=["place", "pair", "n"])
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([_packed(docs)], pa.binary()), pa.array([_packed(linked)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), told)], names=["block", "docs", "linked", "pairs"])


def _packed(columns: dict[str, pa.Array]) -> bytes:
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()


def aligned_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, digest: bool = False) -> DataFrame:
    """(block, docs, linked, pairs), one row for each block of documents, stored: packed alignments, and the block's pairs of ids with their counts."""
    with open(f"{folder}/{BYTE_BPE}", encoding="utf-8") as a, open(f"{folder}/{PIECE_BPE}", "rb") as b:
        files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))  # two vocabularies of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        task, made, block = TaskContext.get().partitionId(), 0, Block(aligner, digest)
        for part in slices(batches, "text"):
            block.add(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist())
            if block.full():
                yield block.row(f"{task}-{made}")
                made, block = made + 1, Block(aligner, digest)
        if block.ids:
            yield block.row(f"{task}-{made}")

    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(base.mapInArrow(run, "block string, docs binary, linked binary, pairs array<struct<place int, pair long, n long>>"), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a_id, b_id, n): how many links of the whole corpus hold each pair of ids."""
    flat = blocks.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("n"))
    return flat.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(_LOW)).alias("b_id"), "n")


def _judged(blocks: DataFrame) -> DataFrame:
    """(block, counts): for each of a block's pairs its corpus-wide count and whether that is its B id's highest."""
    flat = blocks.select("block", F.explode("pairs").alias("p")).select("block", "p.place", "p.pair", "p.n")
    counts = stored(flat.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b_id", F.col("pair").bitwiseAND(F.lit(_LOW))), "pairs")
    highest = counts.groupBy("b_id").agg(F.max("total").alias("top"))  # a row for each id of a vocabulary
    judged = counts.join(highest, "b_id").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    back = flat.select("block", "place", "pair").join(judged, "pair")
    return back.groupBy("block").agg(F.collect_list(F.struct("place", "total", "best")).alias("counts"))


def aligned_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, digest: bool = False) -> DataFrame:
    """Alignment of the byte-level tokenizer's ids (A) with the piece tokenizer's (B) for every text.

    Returns one row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best
    (links whose pair of ids is the most frequent of its B id in the whole
    corpus, ties included), count_sum (corpus-wide counts of all links' pairs,
    summed) and groups: ``a1,a2|b1;a3|b2,b3``, or with ``digest`` its SHA-256 in
    hex.  A blank goes before each text.  Null and empty texts, and those that
    either side doesn't give back byte by byte, have zeros and empty groups, and
    count nowhere.  Null ids stay null, repeated rows are judged and counted
    each, other columns are ignored, empty input gives no rows.
    """
    blocks = aligned_blocks(docs, id_col, text_col, folder, digest)
    both = blocks.select("block", "docs", "linked").join(_judged(blocks), "block", "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(batch.schema.get_field_index(c))[i] for c in ("docs", "linked", "counts")}
                table, links = _unpacked(row["docs"].as_py()), _unpacked(row["linked"].as_py())
                place, links_at = _lists(links.column("places"))
                found = row["counts"].values
                units, at = _lists(table.column("units"))
                sums = []
                for field in ("best", "total"):
                    values = np.zeros(1 + (int(place.max()) if len(place) else 0), np.int64)
                    if found is not None and len(found):
                        values[found.field("place").to_numpy()] = found.field(field).to_numpy(zero_copy_only=False)
                    sums.append(_sums(_sums(values[place], links_at)[units], at))
                for begin in range(0, len(table), 2048):
                    part = table.slice(begin, 2048).combine_chunks()
                    own = [pa.array(x[begin : begin + 2048]) for x in sums]
                    arrays = [part.column(c).combine_chunks() for c in names[:5]] + [*own, part.column("groups").cast(pa.string()).combine_chunks()]
                    yield pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=names)

    return both.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums between offsets, of empty ranges too."""
    upto = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=upto[1:])
    return upto[at[1:]] - upto[at[:-1]]
