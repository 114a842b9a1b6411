"""BPE encoding and decoding through a distinct-word table.

1. Tasks split their documents into words and number the distinct words of a
   chunk of documents (``CHUNK_WORDS`` words): a document becomes word
   numbers, the chunk's word list is dealt by word hash into buckets.
2. Each bucket gathers the words of all chunks, encodes every distinct word
   once and answers each chunk with ids.
3. The answers meet their chunk again; ids join the vocabulary's pieces (id to
   piece, bounded by the vocabulary), and both are joined back by position. A
   decoded text is its pieces joined by one blank.

What moves: one entry per distinct word of a chunk (a word that all documents
hold is one entry per chunk), and the compressed word numbers once. Buckets
grow in number with the text, so that one holds ``BUCKET_BYTES`` of text's
words whatever the input. The written tables in the shared folder cut lineage.

Defined cases: a null text is empty and has no ids; special tokens inside a
text become their ids, as in the tokenizers library; repeated rows are encoded
row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch
from .text import mix, release, utf8_buffers, words as _hash_words
from .tokenizers_io import read_tokenizer, word_encoder

CHUNK_WORDS = 2_000_000
BUCKET_BYTES = 32 << 20

_ONE_BYTE = 250  # word numbers below are written in one byte

CODED = "kind tinyint, chunk long, bucket int, n int, payload binary"
ANSWER = "chunk long, answer binary"
ENCODED = "doc_id long, ids binary, decoded string"


def _pack(*parts: bytes) -> bytes:
    z = zstandard.ZstdCompressor(level=6)
    out = [z.compress(p) for p in parts]
    return np.array([len(out), *map(len, out)], dtype="<u4").tobytes() + b"".join(out)


def _unpack(blob: bytes) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    n = int(np.frombuffer(blob[:4], dtype="<u4")[0])
    at, out = 4 * (n + 1), []
    for size in np.frombuffer(blob[4:at], dtype="<u4").tolist():
        out.append(z.decompress(blob[at : at + size]))
        at += size
    return out


def _planes(v: np.ndarray) -> list[bytes]:
    """The bytes of 32-bit numbers, place by place: they compress better."""
    return [p.tobytes() for p in np.ascontiguousarray(v.astype("<u4").view(np.uint8).reshape(-1, 4).T)]


def _from_planes(planes: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")


def _code_numbers(numbers: np.ndarray) -> list[bytes]:
    """Frequent words (small numbers) take one byte, the others four planes."""
    rare = numbers >= _ONE_BYTE
    return [np.where(rare, _ONE_BYTE, numbers).astype(np.uint8).tobytes(), *_planes(numbers[rare])]


def _decode_numbers(parts: list[bytes]) -> np.ndarray:
    out = np.frombuffer(parts[0], np.uint8).astype(np.uint32)
    out[out == _ONE_BYTE] = _from_planes(parts[1:])
    return out


def _join_words(ws: list[str]) -> bytes:
    return "\n".join(ws).encode("utf-8")  # no word holds white space but a leading blank


def _bucket_of(ws: list[str], buckets: int) -> np.ndarray:
    data, off = utf8_buffers(pa.array([w.strip(" ") for w in ws], type=pa.large_string()))
    # one word per "document": its hash does not depend on the chunk
    pos = np.full(len(ws), -1, dtype=np.int64)
    h, wo = _hash_words(data, off - off[0], lower=False)
    first, last = wo[:-1], wo[1:]
    pos[:] = 0
    has = last > first
    out = np.zeros(len(ws), dtype=np.int64)
    out[has] = (mix(h[first[has]]) % np.uint64(buckets)).astype(np.int64)
    return out


def _split_fn(spec: str, buckets: int):
    def fn(batches):
        from pyspark import TaskContext

        bpe = word_encoder(spec)
        part = TaskContext.get().partitionId()
        serial = 0

        def flush(numbers, code_of, ids, lens):
            chunk = (part << 32) | serial
            codes = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(codes, minlength=len(code_of)), kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            null = np.array([i is None for i in ids], dtype=np.uint8)
            payload = _pack(
                np.array([i or 0 for i in ids], dtype="<i8").tobytes(), null.tobytes(), np.array(lens, dtype="<u4").tobytes(), *_code_numbers(rank[codes])
            )
            rows = [(0, chunk, None, len(ids), payload)]
            ws = list(code_of)
            ws = [ws[i] for i in order.tolist()]
            if ws:
                where = _bucket_of(ws, buckets)
                by_bucket = np.argsort(where, kind="stable")
                a = 0
                for b in (np.flatnonzero(np.diff(where[by_bucket], append=-1)) + 1).tolist():
                    mine = by_bucket[a:b]
                    gaps = np.diff(mine, prepend=0).astype(np.uint32)
                    rows.append((1, chunk, int(where[mine[0]]), b - a, _pack(_join_words([ws[i] for i in mine]), *_planes(gaps))))
                    a = b
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int8()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())],
                names=["kind", "chunk", "bucket", "n", "payload"],
            )

        numbers, code_of, ids, lens, total = [], {}, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ws = bpe.split(text.as_py() or "")
                numbers.append(np.fromiter((code_of.setdefault(w, len(code_of)) for w in ws), dtype=np.uint32, count=len(ws)))
                ids.append(doc_id.as_py())
                lens.append(len(ws))
                total += len(ws)
                if total >= CHUNK_WORDS:
                    yield flush(numbers, code_of, ids, lens)
                    numbers, code_of, ids, lens, total, serial = [], {}, [], [], 0, serial + 1
                    release()
        if ids:
            yield flush(numbers, code_of, ids, lens)
        release()

    return fn


def _encode_fn(spec: str):
    """One bucket of words, chunk after chunk: every distinct word is encoded
    once."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_encoder(spec)
        table: dict[str, list[int]] = {}
        for batch in batches:
            chunks, payloads = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("chunk", "payload"))
            for chunk, payload in zip(chunks, payloads):
                blob, *gaps = _unpack(payload)
                ids, sizes = [], []
                for w in blob.decode("utf-8").split("\n"):
                    e = table.get(w)
                    if e is None:
                        e = table[w] = bpe.encode(w)
                    ids.extend(e)
                    sizes.append(len(e))
                answer = _pack(*gaps, *_planes(np.array(sizes, np.uint32)), *_planes(np.array(ids, np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([answer], pa.binary())], names=["chunk", "answer"])

    return fn


def _assemble_fn(spec: str):
    """One chunk: the ids of its words and the pieces of these ids, joined
    back by position."""

    def fn(coded: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = word_encoder(spec).pieces
        ids_of: dict[int, bytes] = {}
        piece_of: dict[int, str] = {}
        for answer in answers["answer"].to_pylist():
            parts = _unpack(answer)
            place, sizes, ids = (_from_planes(parts[i : i + 4]) for i in (0, 4, 8))
            raw, names, start = ids.tobytes(), [pieces[i] for i in ids.tolist()], 0
            for word, size in zip(np.cumsum(place).tolist(), sizes.tolist()):
                end = start + size
                ids_of[word], piece_of[word], start = raw[4 * start : 4 * end], " ".join(names[start:end]), end
        release()
        doc_ids, out_ids, out_text = [], [], []
        for payload in coded["payload"].to_pylist():
            d, null, lens, *parts = _unpack(payload)
            numbers, at = _decode_numbers(parts), 0
            for doc, is_null, n in zip(np.frombuffer(d, "<i8").tolist(), null, np.frombuffer(lens, "<u4").tolist()):
                mine = numbers[at : at + n].tolist()
                at += n
                doc_ids.append(None if is_null else doc)
                out_ids.append(b"".join([ids_of[c] for c in mine]))
                out_text.append(" ".join([piece_of[c] for c in mine]))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(out_ids, pa.binary()), "decoded": pa.array(out_text, pa.string())})

    return fn


def bpe_encode(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit, decoded string) of
    every document."""
    spec = read_tokenizer(tokenizer_path)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scratch = Scratch(spark, "bpe")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, -(-int(size) // BUCKET_BYTES))
    coded = scratch.keep(src.mapInArrow(_split_fn(spec, buckets), CODED), "coded")
    answers = coded.where("kind = 1").select("chunk", "bucket", "payload").groupBy("bucket").applyInArrow(_encode_fn(spec), ANSWER)
    texts = coded.where("kind = 0").select("chunk", "payload")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_assemble_fn(spec), ENCODED)
