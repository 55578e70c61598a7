"""SentencePiece encoding with source offsets, and decoding.

A text is normalised by longest prefixes of the model's compiled character map while the
source byte of every normalised byte is recorded. The normalised text is cut where no piece
can reach across (before white space), pieces are found per segment, and their ends are
projected to source bytes. Segments repeat, so each worker keeps the pieces of those it has
seen in a bounded cache; the sentencepiece library merges only the new ones. Long texts are
worked through in parts that end where segments do, so memory grows with a part and the ids of
one text, not with the arrays in between.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Characters of text handled at once in a task, and segments and pieces that a worker remembers.
CHUNK, CACHED_SEGMENTS, CACHED_PIECES = 1 << 18, 1 << 18, 1 << 21


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, … (counts[0] of them), starts[1], …"""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


class CharacterMap:
    """A compiled character map: a double array of prefixes, then their replacements."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist() if compiled else []
        self.texts = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix of data[at:] (0: none) and its replacement."""
        units, node, found = self.units, 0, (0, b"")
        if not units:
            return found
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node ^= offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if (unit & ((1 << 31) | 0xFF)) != data[i]:
                break
            node ^= offset(unit)
            if (unit >> 8) & 1:
                start = units[node] & ((1 << 31) - 1)
                found = (i + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return found


class Codec:
    """One model: normalising, segmenting and decoding. Made once per Python worker."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.model, self.lib = model, sentencepiece
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        names = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.unknown = kinds.index(2)
        whole = any(SPACE in p.lstrip(SPACE) for p, k in zip(names, kinds) if k in (1, 4))
        # white space opens a segment unless some piece holds it further in
        self.segments = re.compile(r"(?s).+" if whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.simple = not self.map.units and not self.squeeze
        self.opening = re.compile(f"[^ {SPACE}] ") if self.simple and not whole else None
        surfaces = []
        for p, k in zip(names, kinds):
            surfaces.append(
                bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3
                else proto.trainer_spec.unk_surface.encode() if k == 2 else p.replace(SPACE, " ").encode()
            )
        self.lengths = np.array([1 if k == 6 else len(p.encode()) for p, k in zip(names, kinds)], np.int64)
        self.surface_ends = np.cumsum([len(s) for s in surfaces])
        self.surface_lengths = np.array([len(s) for s in surfaces], np.int64)
        self.surface_bytes = np.frombuffer(b"".join(surfaces), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.n_pieces = 0
        self.starts, self.counts = np.zeros(CACHED_SEGMENTS, np.int32), np.zeros(CACHED_SEGMENTS, np.int32)
        self.ids, self.sizes = np.zeros(CACHED_PIECES, np.int32), np.zeros(CACHED_PIECES, np.int32)

    @cached_property
    def full(self):
        return self.lib.SentencePieceProcessor(model_proto=self.model)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """A text in parts of about CHUNK characters that end where segments do; and whether it is the first."""
        at = 0
        while self.opening and len(text) - at > CHUNK and (m := self.opening.search(text, at + CHUNK)):
            yield text[at : m.start() + 1], not at
            at = m.start() + 1
        yield text[at:] if at else text, not at

    def normalize(self, text: str, first: bool = True) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its UTF-8 bytes and its end, the source byte."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.simple:
            wide = np.where(np.frombuffer(data, np.uint8) == 0x20, 3, 1)
            source = np.append(np.repeat(np.arange(len(data)), wide), len(data))
            out = text.replace(" ", SPACE)
            return (SPACE + out, np.concatenate([np.zeros(3, np.int64), source])) if self.prefix and first else (out, source)
        return self.normalize_by_map(data)

    def normalize_by_map(self, data: bytes) -> tuple[str, np.ndarray]:
        parts: list[tuple[bytes, int, int]] = []  # normalised bytes, source start and end
        at = 0
        while at < len(data):
            n, out = self.map.longest(data, at)
            if not n:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                out = data[at : at + n]
            parts.append((out, at, at + n))
            at += n
        if self.squeeze:
            while parts and parts[0][0] in (b" ", b""):
                parts.pop(0)
        out, source, spaced = bytearray(), [], self.squeeze
        mark = SPACE.encode()
        if self.prefix and parts:
            out += mark
            source += [parts[0][1]] * 3
        for piece, start, _ in parts:
            if self.squeeze and spaced:
                piece = piece.lstrip(b" ")
            for b in piece:
                if b == 0x20:
                    out += mark
                    source += [start] * 3
                else:
                    out.append(b)
                    source.append(start)
            if piece:
                spaced = piece.endswith(b" ")
        end = parts[-1][2] if parts else 0
        while self.squeeze and out.endswith(mark):
            del out[-3:]
            end = source[-3]
            del source[-3:]
        return out.decode(), np.array([*source, end], np.int64)

    def pieces(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts per segment, then ids and byte sizes of all pieces, by the library."""
        found = self.plain.encode(segments, num_threads=1)
        counts = np.fromiter(map(len, found), np.int32, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        sizes = self.lengths[ids]
        ends = np.cumsum(counts)
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(ids == self.unknown), "right")).tolist():
            texts = self.plain.encode(segments[i], out_type=str)  # the texts of unknown pieces
            run = slice(ends[i] - counts[i], ends[i])
            sizes[run] = np.where(ids[run] == self.unknown, [len(p.encode()) for p in texts], sizes[run])
        return counts, ids, sizes

    def learn(self, segments: list[str], counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the pieces of new segments."""
        n, p = len(self.cache), self.n_pieces
        self.cache.update(zip(segments, range(n, n + len(segments))))
        self.counts[n : n + len(counts)] = counts
        self.starts[n : n + len(counts)] = p + np.cumsum(counts) - counts
        self.ids[p : p + len(ids)], self.sizes[p : p + len(ids)] = ids, sizes
        self.n_pieces += len(ids)

    def segment_pieces(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, ids and sizes of the pieces of a list of segments, from the cache where they are known."""
        new = list(set(flat).difference(self.cache))
        if new:
            told = self.pieces(new)
            if len(self.cache) + len(new) > CACHED_SEGMENTS or self.n_pieces + len(told[1]) > CACHED_PIECES:
                self.forget()
                new = list(set(flat))
                told = self.pieces(new)
                if len(new) > CACHED_SEGMENTS or len(told[1]) > CACHED_PIECES:  # more than can be remembered
                    own = dict(zip(new, range(len(new))))
                    at = np.fromiter(map(own.__getitem__, flat), np.int64, len(flat))
                    places = ragged((np.cumsum(told[0]) - told[0])[at], told[0][at])
                    return told[0][at], told[1][places], told[2][places]
            self.learn(new, *told)
        at = np.fromiter(map(self.cache.__getitem__, flat), np.int64, len(flat))
        places = ragged(self.starts[at], self.counts[at])
        return self.counts[at], self.ids[places], self.sizes[places]

    def encode_parts(self, parts: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts per part, then ids, source starts and source ends of all pieces."""
        normalised = [self.normalize(*p) for p in parts]
        found = [self.segments.findall(n) for n, _ in normalised]
        ends_of_parts = np.cumsum([len(p) for p in found])
        pieces, ids, sizes = self.segment_pieces(list(chain.from_iterable(found)))
        ends = np.concatenate([[0], np.cumsum(pieces)])[ends_of_parts]
        counts = np.diff(ends, prepend=0)
        # where each piece ends in its part's normalised bytes, then in source bytes
        reach = np.cumsum(sizes)
        base = np.concatenate([[0], reach])[ends - counts]
        widths = np.array([len(s) for _, s in normalised], np.int64)
        source = np.concatenate([s for _, s in normalised])
        shift = np.repeat(np.cumsum(widths) - widths - base, counts)
        return counts, ids, source[reach - sizes + shift].astype(np.int32), source[reach + shift].astype(np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts per text, then ids, source starts and source ends of all pieces."""
        counts, out = np.zeros(len(texts), np.int64), []
        held, of, shifts, size = [], [], [], 0

        def work() -> None:
            n, *rest = self.encode_parts(held)
            np.add.at(counts, of, n)
            shift = np.repeat(np.array(shifts, np.int32), n)
            out.append((rest[0], rest[1] + shift, rest[2] + shift))

        for i, text in enumerate(texts):
            shift = 0
            for part in self.parts(text):
                held.append(part)
                of.append(i)
                shifts.append(shift)
                size += len(part[0])
                if len(text) > CHUNK:
                    shift += len(part[0].encode())
                if size >= CHUNK:
                    work()
                    held, of, shifts, size = [], [], [], 0
        if held:
            work()
        ids, begins, ends = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int32)] * 3
        return counts, ids, begins, ends

    def surfaces_of(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of a run of ids, some at a time."""
        for i in range(0, len(ids), CHUNK):
            some = ids[i : i + CHUNK]
            wide = self.surface_lengths[some]
            yield self.surface_bytes[ragged(self.surface_ends[some] - wide, wide)].tobytes()

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        data = b"".join(self.surfaces_of(ids))
        done = np.cumsum(counts)
        ends = np.concatenate([[0], np.cumsum(self.surface_lengths[ids])])[done]
        out, at = [], 0
        for n, upto, end in zip(counts.tolist(), done.tolist(), ends.tolist()):
            piece = data[at:end]
            at = end
            try:
                if self.squeeze:
                    raise ValueError("leading white space is the library's affair")
                out.append(piece[1:].decode() if self.prefix and piece[:1] == b" " else piece.decode())
            except ValueError:
                out.append(self.full.decode(ids[upto - n : upto].tolist()))
        return out

    @cached_property
    def numerals(self) -> list[bytes]:
        return [str(i).encode() for i in range(len(self.lengths))]

    def ids_digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        told = hashlib.sha256()
        for i in range(0, len(ids), CHUNK):
            told.update(b"," * (i > 0) + b",".join(map(self.numerals.__getitem__, ids[i : i + CHUNK].tolist())))
        return told.hexdigest()


@lru_cache(1)
def codec_of(model: bytes) -> Codec:
    return Codec(model)


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK bytes of text each; a longer text stands alone, whole."""
    start, total = 0, 0
    for i, text in enumerate(batch.column(column)):
        total += len(text.as_buffer())
        if total >= CHUNK or i + 1 == batch.num_rows:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0


def lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


INTEGERS = T.ArrayType(T.IntegerType(), False)
#: What can be asked of an encoded text. Digests are taken where the ids are, so that these need not travel.
OUTPUTS = {
    "ids": INTEGERS, "begins": INTEGERS, "ends": INTEGERS, "decoded": T.StringType(),
    "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "spans_sha256": T.StringType(),
}
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def spans_digest(begins: np.ndarray, ends: np.ndarray) -> str:
    """SHA-256 of the source bytes where each piece begins and ends, as little-endian 32-bit pairs."""
    told = hashlib.sha256()
    for i in range(0, len(begins), CHUNK):
        told.update(np.stack([begins[i : i + CHUNK], ends[i : i + CHUNK]], axis=1).astype("<i4").tobytes())
    return told.hexdigest()


def encoded(codec: Codec, texts: list[str], wanted: tuple[str, ...]) -> Iterator[pa.Array]:
    """The outputs asked for, in that order."""
    counts, ids, begins, ends = codec.encode(texts)
    decoded = codec.decode(counts, ids) if {"decoded", "decoded_sha256"} & set(wanted) else []
    last = np.cumsum(counts).tolist()
    columns = {
        "ids": lambda: lists(counts, ids), "begins": lambda: lists(counts, begins), "ends": lambda: lists(counts, ends),
        "decoded": lambda: pa.array(decoded, pa.string()),
        "n_tokens": lambda: pa.array(counts, pa.int64()),
        "ids_sha256": lambda: pa.array([codec.ids_digest(ids[b - n : b]) for n, b in zip(counts.tolist(), last)], pa.string()),
        "spans_sha256": lambda: pa.array([spans_digest(begins[b - n : b], ends[b - n : b]) for n, b in zip(counts.tolist(), last)], pa.string()),
        "decoded_sha256": lambda: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
    }
    return (columns[w]() for w in wanted)


def encode_documents(
    docs: DataFrame,
    model: bytes,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    outputs: tuple[str, ...] = ("ids", "begins", "ends", "decoded"),
) -> DataFrame:
    """The kept columns with what is asked of ids, begins and ends (bytes of the source text),
    decoded, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 and spans_sha256 (see :func:`spans_digest`).

    Exactly the library's pieces without begin or end ids; ``decoded`` is the library's
    decoding of the ids. The model (bounded: a vocabulary) goes to the workers by broadcast.

    Cases: a null text counts as empty, and an empty text has no pieces and decodes to "".
    A very long text is encoded whole, in parts that do not change the pieces. Rows and their
    copies are encoded each; the row order of a partition stays. An empty table gives no rows. A
    kept column may not have the name of an output (ValueError); other columns do not matter.
    """
    if clash := set(keep) & set(outputs) or set(outputs) - set(OUTPUTS):
        raise ValueError(f"not both kept and made, or not known: {sorted(clash)}")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([*rows.schema.fields[: len(keep)], *[T.StructField(o, OUTPUTS[o]) for o in outputs]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                columns = [*[part.column(n) for n in names], *encoded(codec, part.column("text").to_pylist(), outputs)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *outputs])

    return rows.mapInArrow(work, schema).toDF(*keep, *outputs)
