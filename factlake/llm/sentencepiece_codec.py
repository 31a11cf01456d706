"""SentencePiece encoding and decoding that keeps original byte offsets.

Normalisation walks the model's compiled character map (a double-array trie) and
takes the longest matching prefix at each place, recording for every normalised
byte which original byte it came from. Pieces are segmented on the normalised text
and projected through that alignment, so each id carries a byte span of the
original. A model with an identity map skips the trie: there the alignment follows
from the places of the spaces alone.

Byte-pair merges never cross from a non-space into a following space mark when no
piece of the vocabulary does, so a text is segmented in units that begin at such
places; a unit's pieces are found once by the sentencepiece library and kept in a
bounded table. A model whose vocabulary breaks that rule is segmented whole.

Defined cases: null and empty texts give no pieces (only the end id, where asked);
a literal U+2581 is the same as a space, as in the library; repeated rows give
repeated results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factlake.llm.common import map_texts

SPACE = "▁"
#: Entries of the unit table of one task; it starts anew when full.
UNIT_TABLE = 600_000


class CharacterMap:
    """Longest-prefix normalisation with alignment, from a compiled character map."""

    def __init__(self, blob: bytes, *, dummy_prefix: bool, squeeze: bool, escape: bool = True):
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape
        self.units: list[int] = []
        self.values = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{n // 4}I", blob, 4))
            self.values = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(bytes matched, place of the replacement) of the longest key at ``at``."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def steps(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(replacement, start, end) from left to right; unmatched characters stay."""
        at = 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit:
                end = at + hit[0]
                yield self.values[hit[1] : self.values.index(b"\0", hit[1])], at, end
            else:
                first = data[at]
                end = min(len(data), at + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4))
                yield data[at:end], at, end
            at = end

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, the original byte offset."""
        data = text.encode()
        mark = SPACE.encode() if self.escape else b" "
        out, origin = bytearray(), []
        steps = list(self.steps(data))
        if self.squeeze:
            while steps and steps[0][0].strip(b" ") == b"":
                steps.pop(0)
        if not steps:
            return b"", np.zeros(1, np.int64)
        start = steps[0][1]
        if self.dummy_prefix:
            out += mark
            origin += [start] * len(mark)
        after_space = self.squeeze
        for piece, a, _ in steps:
            if after_space:
                piece = piece.lstrip(b" ")
            for c in piece:
                put = mark if c == 32 else bytes([c])
                out += put
                origin += [a] * len(put)
            if piece:
                after_space = self.squeeze and piece.endswith(b" ")
        end = steps[-1][2]
        if self.squeeze:
            while out.endswith(mark):
                end = origin[len(out) - len(mark)]
                del out[-len(mark) :]
                del origin[len(out) :]
        return bytes(out), np.array([*origin, end], np.int64)


class Encoded:
    """Flat ids and original byte spans of several texts; ``rows`` delimits them."""

    def __init__(self, ids, begin, end, rows, strings, decoded):
        self.ids, self.begin, self.end, self.rows, self.strings, self.decoded = ids, begin, end, rows, strings, decoded


class Codec:
    def __init__(self, model: str | bytes):
        import sentencepiece as sp
        import sentencepiece.sentencepiece_model_pb2 as pb

        blob = model if isinstance(model, bytes) else open(model, "rb").read()  # noqa: SIM115
        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        self.sp = sp.SentencePieceProcessor(model_proto=blob)
        self.map = CharacterMap(spec.precompiled_charsmap, dummy_prefix=spec.add_dummy_prefix, squeeze=spec.remove_extra_whitespaces, escape=spec.escape_whitespaces)
        self.end_id = self.sp.eos_id()
        pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.surface: list[bytes] = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else b" \xe2\x81\x87 " if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.is_byte = [k == 6 for k in kinds]
        self.decimal = list(map(str, range(len(pieces))))
        self.high = np.array([b and x >= b"\x80" for x, b in zip(self.surface, self.is_byte, strict=True)], bool)  # no character by itself
        self.simple = ["" if h else x.decode() for x, h in zip(self.surface, self.high, strict=True)]
        #: Bytes of each piece in the normalised text.
        self.width = np.array([1 if k == 6 else 0 if k == 3 else len(p.encode()) for p, k in zip(pieces, kinds, strict=True)], np.int64)
        self.identity = not self.map.units and self.map.dummy_prefix and not self.map.squeeze and self.map.escape
        splits = all(SPACE not in p.lstrip(SPACE) for p, k in zip(pieces, kinds, strict=True) if k in (1, 4)) and not proto.trainer_spec.treat_whitespace_as_suffix
        self.by_unit = self.identity and splits and proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback and 4 not in kinds
        self._reset()

    def _reset(self) -> None:
        self.table: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 17, np.int32)
        self.used = 0

    def decode(self, ids) -> str:
        """Text of ids; the mark of the dummy prefix goes, byte pieces are joined to characters."""
        out, raw, first = [], bytearray(), True
        for i in ids:
            if self.is_byte[i]:
                raw += self.surface[i]
                first = False
                continue
            if raw:
                out.append(bytes_text(raw))
                raw = bytearray()
            piece = self.surface[i]
            if first and piece and (self.map.dummy_prefix or self.map.squeeze):
                piece = piece.lstrip(b" ") if self.map.squeeze else piece.removeprefix(b" ")
                first = False
            out.append(piece.decode())
        return "".join(out) + bytes_text(raw)

    def _learn(self, units: list[str]) -> None:
        """Adds units (without their first space mark) to the table."""
        found = self.sp.encode(units, num_threads=1)
        if "" in units:
            found[units.index("")] = [self.sp.piece_to_id(SPACE)]
        k, n = len(self.table), len(units)
        counts = np.fromiter(map(len, found), np.int64, n)
        total = int(counts.sum())
        while k + n > len(self.starts):
            self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + total))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        self.starts[k : k + n], self.counts[k : k + n] = self.used + np.cumsum(counts) - counts, counts
        self.used += total
        self.table.update(zip(units, range(k, k + n)))
    def units(self, text: str) -> list[str]:
        """Units of a text, each without its first space mark."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in re.findall(r" +[^ ]+| +$", f" {text}")]

    def encode(self, texts: list[str | None]) -> Encoded:
        """Ids without an end id, with spans in bytes of the original texts."""
        return self._by_unit(texts) if self.by_unit else self._whole(texts)

    def _by_unit(self, texts: list[str | None]) -> Encoded:
        parts = [self.units(t) if t else [] for t in texts]
        every = set().union(*parts)
        if len(self.table) + len(every) > UNIT_TABLE and self.table:
            self._reset()
        if missing := [u for u in every if u not in self.table]:
            self._learn(missing)
        flat = np.fromiter(map(self.table.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        counts = self.counts[flat]
        before = np.cumsum(counts) - counts
        ids = self.flat[np.repeat(self.starts[flat] - before, counts) + np.arange(int(counts.sum()))]
        unit_rows = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        rows = np.concatenate([before, [len(ids)]])[unit_rows]
        begin, end = self._spans(texts, ids, rows)
        text_of, back_of = self.decimal.__getitem__, self.simple.__getitem__
        odd = np.concatenate([[0], np.cumsum(self.high[ids])])[rows]
        strings, decoded, all_ids = [], [], ids.tolist()
        for a, b, plain in zip(rows.tolist(), rows[1:].tolist(), odd[1:] == odd[:-1]):
            row = all_ids[a:b]
            strings.append(" ".join(map(text_of, row)))
            decoded.append("".join(map(back_of, row))[1:] if plain else self.decode(row))
        return Encoded(ids, begin, end, rows, strings, decoded)

    def _spans(self, texts, ids, rows) -> tuple[np.ndarray, np.ndarray]:
        """Original spans for an identity map: a space or U+2581 is one mark, all else stays."""
        mark = SPACE.encode()
        raw = [t.encode() if t else b"" for t in texts]
        width = self.width[ids]
        ends = np.cumsum(width)
        begin, end = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for k, data in enumerate(raw):
            a, b = rows[k], rows[k + 1]
            if a == b:
                continue
            at = ends[a:b] - (ends[a - 1] if a else 0)
            if mark in data:
                origin = self.map.normalise(texts[k])[1]
            else:
                origin = np.repeat(np.arange(len(data) + 1), np.append(np.where(np.frombuffer(data, np.uint8) == 32, 3, 1), 1))
                origin = np.concatenate([[0, 0, 0], origin])
            end[a:b] = origin[at]
            begin[a] = 0
            begin[a + 1 : b] = end[a : b - 1]
        return begin, end

    def _whole(self, texts: list[str | None]) -> Encoded:
        """For models that are segmented whole: the library on each text, spans by the map."""
        ids, begin, end, rows, strings, decoded = [], [], [], [0], [], []
        for t in texts:
            got = self.sp.encode(t or "", num_threads=1)
            norm, origin = self.map.normalise(t or "")
            at, row = 0, []
            pieces = self.sp.encode(t or "", out_type=str)
            for i, piece in zip(got, pieces, strict=True):
                n = 1 if self.is_byte[i] else len(piece.encode())
                begin.append(int(origin[at]))
                at = min(at + n, len(norm))
                end.append(int(origin[at]))
                row.append(i)
            ids += row
            rows.append(len(ids))
            strings.append(" ".join(map(str, row)))
            decoded.append(self.decode(row))
        return Encoded(np.array(ids, np.int32), np.array(begin, np.int64), np.array(end, np.int64), np.array(rows, np.int64), strings, decoded)


def bytes_text(raw) -> str:
    """Byte pieces as text; each byte that starts no valid character is U+FFFD."""
    out, data = [], bytes(raw)
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out += [data[: e.start].decode(), "�"]
            data = data[e.start + 1 :]
    return "".join(out)


def encode(df: DataFrame, model: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), end_id: bool = True) -> DataFrame:
    """One row per row: ``ids``, and ``begins`` and ``ends`` as byte offsets of the original.

    The end id, if asked for, has an empty span at the end of the text.
    """
    import pyarrow as pa

    ints, longs = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.LongType(), False)
    schema = T.StructType([T.StructField("ids", ints), T.StructField("begins", longs), T.StructField("ends", longs)])

    def make():
        codec = Codec(model)

        def each(texts):
            e = codec.encode(texts)
            last = [len(t.encode()) if t else 0 for t in texts]
            out = {"ids": [], "begins": [], "ends": []}
            for k, n in enumerate(last):
                s = slice(e.rows[k], e.rows[k + 1])
                for name, values, extra in (("ids", e.ids, codec.end_id), ("begins", e.begin, n), ("ends", e.end, n)):
                    out[name].append(values[s].tolist() + [extra] * end_id)
            return {"ids": pa.array(out["ids"], pa.list_(pa.field("element", pa.int32(), False))), **{c: pa.array(out[c], pa.list_(pa.field("element", pa.int64(), False))) for c in ("begins", "ends")}}

        return each

    return map_texts(df, text, schema, make, keep)


def encode_digest(df: DataFrame, model: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes with an end id and decodes; returns counts and digests in place of the arrays.

    ``spans_crc32`` covers the byte spans (little-endian 64-bit begins, then ends).
    """
    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("spans_crc32", T.LongType())])

    def make():
        codec = Codec(model)
        last = str(codec.end_id)
        sha = hashlib.sha256

        def each(texts):
            e = codec.encode(texts)
            rows = e.rows.tolist()
            return {
                "n_tokens": [b - a + 1 for a, b in zip(rows, rows[1:])],
                "ids_sha256": [sha((f"{s} {last}" if s else last).encode()).hexdigest() for s in e.strings],
                "decoded_sha256": [sha(d.encode()).hexdigest() for d in e.decoded],
                "spans_crc32": [zlib.crc32(e.end[a:b].tobytes(), zlib.crc32(e.begin[a:b].tobytes())) for a, b in zip(rows, rows[1:])],
            }

        return each

    return map_texts(df, text, schema, make, keep)
