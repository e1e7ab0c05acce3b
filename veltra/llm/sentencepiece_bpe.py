"""SentencePiece encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary can span (so merges never cross), equal segments are merged once, and
all segments advance together over flat arrays: each round takes the smallest pair rank of every segment, merges its
leftmost non-overlapping occurrences at once and compacts the arrays, until no pair remains. A merge whose result could
form a better pair than itself, or whose score is shared, is done one occurrence a round, which keeps the library's order.

Defined results: a null or empty text has no ids but the end id; repeated rows and ids are rows of their own; texts are
encoded whole; an empty table gives no rows; other columns are left alone. Supported are BPE models with byte fallback
and identity normalisation that keep white space; others raise ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructType

from veltra.llm._util import arrow_rows, binary_parts, read, slices, span_hashes

META = "▁"
NONE = np.int64(1) << np.int64(40)


def _fields(raw: bytes):
    """Field number and value of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


class PieceCodec:
    """Vocabulary, merge ranks and tables of a model file."""

    def __init__(self, model: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, 1)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or trainer.get(24) or any(p[2] in (4, 5) for p in pieces):
            raise ValueError("only BPE models with byte fallback, identity normalisation and a leading space are supported")
        self.eos = trainer.get(42, 2)
        vocab = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.byte_ids = np.zeros(256, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)] = i
        order = {s: r for r, s in enumerate(sorted({-pieces[i][1] for i in vocab.values()}))}
        rank = {p: order[-pieces[i][1]] for p, i in vocab.items()}
        count = np.bincount(list(rank.values()))
        self.rank = np.full(len(pieces), NONE)
        self.single = np.zeros(len(pieces), bool)  # one occurrence a round
        keys, merged = [], []
        joins = np.zeros((128, 128), bool)
        inner = False
        for p, i in vocab.items():
            self.rank[i] = rank[p]
            self.single[i] |= count[rank[p]] > 1
            inner |= META in p.lstrip(META)
            s = p.replace(META, " ")
            for a, b in zip(s, s[1:]):
                if a < "\x80" and b < "\x80":
                    joins[ord(a), ord(b)] = True
            for cut in range(1, len(p)):
                a, b = vocab.get(p[:cut]), vocab.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * len(pieces) + b)
                    merged.append(i)
                    for part in (a, b):
                        self.single[part] |= rank[p] <= rank[pieces[part][0]]
        by = np.argsort(keys)
        self.keys, self.merged, self.size = np.asarray(keys, np.int64)[by], np.asarray(merged, np.int64)[by], len(pieces)
        self.joins, self.inner = joins, inner
        chars = sorted((ord(p), i) for p, i in vocab.items() if len(p) == 1)
        self.char_codes, self.char_ids = np.array([c for c, _ in chars]), np.array([i for _, i in chars])
        #: What decoding writes for an id: control pieces nothing, bytes themselves.
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else b" \xe2\x81\x87 " if kind == 2 else p.replace(META, " ").encode() for p, _, kind in pieces]
        self.is_byte = np.array([kind == 6 for *_, kind in pieces])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols merges into, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)

    def segments(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts with a leading space each; starts of their segments; each text's segment offsets."""
        full = offs[1:] > offs[:-1]
        data = np.insert(data, offs[:-1][full], 32)
        offs = offs + np.concatenate([[0], np.cumsum(full)])
        before, here = data[:-1], data[1:]
        ascii_ = (before < 128) & (here < 128)
        cut = ascii_ & ~self.joins[before & 127, here & 127]
        if not self.inner:
            literal = np.zeros(len(before), bool)
            literal[2:] = (before[2:] == 0x81) & (before[1:-1] == 0x96) & (before[:-2] == 0xE2)
            cut |= (here == 32) & (before != 32) & ~literal
        first = np.ones(len(data), bool)
        first[1:] = cut
        first[offs[:-1][full]] = True
        starts = np.flatnonzero(first)
        return data, starts, np.searchsorted(starts, offs)

    def merge(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, flat, and their offsets."""
        length = stops - starts
        at = np.concatenate([[0], np.cumsum(length)])
        flat = data[np.arange(at[-1]) + np.repeat(starts - at[:-1], length)].astype(np.int64)
        lead = (flat & 0xC0) != 0x80
        pos = np.flatnonzero(lead)
        wide = np.diff(np.append(pos, len(flat)))
        head = flat[pos]
        code = np.where(wide == 1, head, head & (0xFF >> (wide + 1)))
        for k in (1, 2, 3):
            more = wide > k
            code[more] = code[more] << 6 | (flat[pos[more] + k] & 63)
        code[code == 32] = ord(META)
        here = np.minimum(np.searchsorted(self.char_codes, code), len(self.char_codes) - 1)
        sym = np.where(self.char_codes[here] == code, self.char_ids[here], -1 - np.arange(len(code)))  # unknown: by its place
        seg = np.repeat(np.arange(len(starts)), np.diff(np.searchsorted(pos, at)))
        done_sym, done_seg = [], []
        pair = np.full(len(sym), -1)
        same = seg[:-1] == seg[1:]
        pair[:-1] = np.where(same, self.pairs(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            begin = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            least = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(seg)))
            ended = least == NONE
            if ended.any():
                out = np.repeat(ended, count)
                done_sym.append(sym[out])
                done_seg.append(seg[out])
                sym, seg, pair, rank = sym[~out], seg[~out], pair[~out], rank[~out]
                least, count = least[~ended], count[~ended]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, count)
            # Of adjacent hits every other one, from the left; of a piece that must go one by one, the first.
            where = np.flatnonzero(hit)
            new = np.concatenate([[True], (where[1:] != where[:-1] + 1)])
            run = np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))
            use = ((np.arange(len(where)) - run) & 1) == 0
            first = np.concatenate([[True], seg[where[1:]] != seg[where[:-1]]])
            use &= first | ~self.single[pair[where]]
            where = where[use]
            sym[where] = pair[where]
            touched = np.zeros(len(sym), bool)
            touched[where] = True
            touched[where[where > 0] - 1] = True
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            # The symbol before a merged pair may itself have been the dropped half of another merge: mark that merge.
            gone = where[where > 0] - 1
            gone = gone[~keep[gone]]
            touched[gone - 1] = True
            sym, seg, pair, touched = sym[keep], seg[keep], pair[keep], touched[keep]
            fix = np.flatnonzero(touched)
            last = fix == len(sym) - 1
            pair[fix[last]] = -1
            fix = fix[~last]
            pair[fix] = np.where(seg[fix] == seg[fix + 1], self.pairs(sym[fix], sym[fix + 1]), -1)
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        by = np.argsort(seg, kind="stable")
        sym, seg = sym[by], seg[by]
        unknown = sym < 0
        if unknown.any():
            width = np.where(unknown, wide[np.where(unknown, -1 - sym, 0)], 1)
            to = np.cumsum(width) - width
            out = np.repeat(sym, width)
            inside = np.arange(len(out)) - np.repeat(to, width)
            bad = out < 0
            out[bad] = self.byte_ids[flat[pos[-1 - out[bad]] + inside[bad]]]
            sym, seg = out, np.repeat(seg, width)
        return sym, np.searchsorted(seg, np.arange(len(starts) + 1))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text with the end id, flat, and their offsets."""
        data, starts, seg_offs = self.segments(data, offs)
        n = len(offs) - 1
        if not len(starts):
            return np.full(n, self.eos), np.arange(n + 1)
        stops = np.append(starts[1:], len(data))
        _, rep, inverse = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
        # A segment is replaced by its first equal one only if the bytes agree.
        length, like = stops - starts, rep[inverse]
        ok = length == length[like]
        at = np.cumsum(length) - length
        inside = np.arange(len(data)) - np.repeat(at, length)
        other = np.minimum(np.repeat(starts[like], length) + inside, len(data) - 1)
        ok &= np.add.reduceat((data != data[other]).astype(np.int64), at) == 0
        if not ok.all():
            odd = np.flatnonzero(~ok)
            inverse[odd] = len(rep) + np.arange(len(odd))
            rep = np.concatenate([rep, odd])
        ids, id_offs = self.merge(data, starts[rep], stops[rep])
        count = np.diff(id_offs)[inverse]
        to = np.concatenate([[0], np.cumsum(count)])
        ends = to[seg_offs[1:]]  # ids before the end of each text
        out = ids[np.arange(to[-1]) + np.repeat(id_offs[inverse] - to[:-1], count)]
        return np.insert(out, ends, self.eos), np.concatenate([[0], ends + np.arange(1, n + 1)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8, as the library's decode() gives it."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        if len(ids) and not self.is_byte[ids[0]] and raw[:1] == b" ":
            raw = raw[1:]
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


_CODECS: dict[bytes, PieceCodec] = {}


def _codec(model: bytes) -> PieceCodec:
    """One codec per worker process and model."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def _model(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _encoded(batches, model: bytes, text_col: str):
    codec = _codec(model)
    for batch in batches:
        data, offs = binary_parts(batch.column(text_col))
        for lo, hi in slices(offs):
            part = offs[lo : hi + 1] - offs[lo]
            yield batch.slice(lo, hi - lo), *codec.encode(data[offs[lo] : offs[hi]], part)


def encode(docs: DataFrame, *, text_col: str = "text", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """docs with ids_col array<int>: the ids of text_col with the end id. A column of that name is replaced."""
    arrow_rows(docs.sparkSession)
    model = _model(model_path)
    kept = docs.drop(ids_col)

    def run(batches):
        for rows, ids, offs in _encoded(batches, model, text_col):
            column = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, ids_col])

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add(ids_col, ArrayType(IntegerType())))


def decode(rows: DataFrame, *, ids_col: str = "ids", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """rows with text_col: the text of ids_col (null: empty). A column of that name is replaced."""
    arrow_rows(rows.sparkSession)
    model = _model(model_path)
    kept = rows.drop(text_col)

    def run(batches):
        codec = _codec(model)
        for batch in batches:
            texts = [codec.decode(np.asarray(x or [], np.int64)).decode() for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add(text_col, "string"))


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encode() and decode() with only digests leaving the worker."""
    arrow_rows(docs.sparkSession)
    model = _model(model_path)

    def run(batches):
        codec = _codec(model)
        decimal = [str(i).encode() for i in range(codec.size)]
        for rows, ids, offs in _encoded(batches, model, "text"):
            a, b = [], []
            for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
                own = ids[lo:hi]
                a.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, own.tolist()))).hexdigest())
                b.append(hashlib.sha256(codec.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offs), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row: its ids with the end id, and whether decoding them gives its text again."""
    arrow_rows(docs.sparkSession, 500)
    model = _model(model_path)

    def run(batches):
        codec = _codec(model)
        for rows, ids, offs in _encoded(batches, model, "text"):
            data, at = binary_parts(rows.column("text"))
            same = [codec.decode(ids[a:b]) == data[c:d].tobytes() for a, b, c, d in zip(offs[:-1], offs[1:], at[:-1], at[1:])]
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offs), pa.int64()), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
