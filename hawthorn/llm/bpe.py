"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Split: every text is cut into pre-tokens by the pattern. Texts are taken in blocks; a block
   keeps its pre-tokens' positions as a packed sequence of numbers into its own list of
   distinct pre-tokens, the most frequent first.
2. Words: the blocks' lists are exploded and shuffled by word, so that all uses of a distinct
   word meet, sorted, in one task; there it is encoded once. A word has one row for each
   block, so even the most frequent one is a small share of the rows.
3. Join back: the ids go to the blocks by (block, number), packed by block.
4. Reassemble: blocks (bucketed by block, not shuffled) and ids meet; ids are gathered by position.
   Decoding is a separate pass over ids alone: rows are gathered to chunks of bounded size, which are joined with
   the token-byte table of their vocabulary (one row of bounded size, so it is broadcast).

Rows are told apart by block and place, never by doc_id, so repeated ids are no trouble.
Cases: null or empty text: no tokens, digests of the empty string; repeated rows: each encoded;
null doc_id: kept as it is; very long texts: a block of their own; empty table: no rows; extra
columns: ignored by encode_documents(), which returns doc_id, ids. Special tokens' strings
are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import scratch, store_by, trim

#: Characters of text in a block, about; a longer text is a block by itself. Each block sends its distinct words once.
BLOCK_CHARS = 32_000_000
#: Ids that are decoded at a time, about.
CHUNK_IDS = 1_000_000
DEFAULT_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(2)
def vocabulary(path: str, name: str = DEFAULT_VOCABULARY) -> list[bytes]:
    """The bytes of each id. path: a file of base64 bytes and rank, or '' for the public file of that name."""
    if not path:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    table = [b""] * (1 + max(int(b) for _, b in pairs))
    for a, b in pairs:
        table[int(b)] = base64.b64decode(a)
    return table


@lru_cache(2)
def pattern(text: str):
    import regex

    if not text:
        import public_tokenizers

        text = public_tokenizers.PATTERN
    return regex.compile(text)


@lru_cache(2)
def encoder(path: str, pat: str):
    import tiktoken

    ranks = {b: i for i, b in enumerate(vocabulary(path)) if b}
    return tiktoken.Encoding("ranks", pat_str=pattern(pat).pattern, mergeable_ranks=ranks, special_tokens={})


def _blocks(texts_limit: int, pat: str):
    """Arrow batches of (doc_id, text) -> one row for each block."""
    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("seq", pa.binary()), ("words", pa.list_(pa.binary()))])

    def run(batches):
        from pyspark import TaskContext

        find, task, n = pattern(pat).findall, TaskContext.get().partitionId(), 0
        docs: list = []
        sizes: list[int] = []
        parts: deque[np.ndarray] = deque()
        number: dict[str, int] = {}
        chars = 0

        def out():
            nonlocal n, chars
            seq = np.empty(sum(sizes), np.uint32)
            at = 0
            while parts:  # each part goes as its copy is made
                part = parts.popleft()
                seq[at : at + len(part)] = part
                at += len(part)
            # frequent words get small numbers, so that the packed sequence is short
            order = np.argsort(-np.bincount(seq, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            seq = rank[seq]
            words = pa.array(list(number), pa.large_string()).take(pa.array(order)).cast(pa.large_binary()).cast(pa.binary())
            number.clear()
            one = [pa.array([0, len(words)], pa.int32()), words]
            row = pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) + n]), pa.array([docs], pa.list_(pa.int64())), pa.array([np.array(sizes, np.uint32).tobytes()]), pa.array([pack(seq)], pa.binary()), pa.ListArray.from_arrays(*one)], schema=schema
            )
            n += 1
            chars = 0
            docs.clear(), sizes.clear()
            trim()
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if docs and chars + len(text) > texts_limit:
                    yield out()
                found = find(text)
                get = number.setdefault
                parts.append(np.fromiter((get(w, len(number)) for w in found), np.uint32, len(found)))
                docs.append(doc.as_py())
                sizes.append(len(found))
                chars += len(text)
        if docs:
            yield out()

    return run


def pack(seq: np.ndarray, step: int = 1 << 17) -> bytes:
    """Numbers below 2**28 in one or more bytes each: 7 bits a byte, the last byte's top bit set; some at a time."""

    def some(seq):
        size = 1 + (seq >= 1 << 7).astype(np.int64) + (seq >= 1 << 14) + (seq >= 1 << 21)
        at = np.cumsum(size)
        out = np.zeros(int(at[-1]), np.uint8)
        for k in range(4):
            has = size > k
            out[at[has] - 1 - k] = (seq[has] >> np.uint32(7 * k)) & np.uint32(127)
        out[at - 1] |= 128
        return out.tobytes()

    seq = seq.astype(np.uint32, copy=False)
    return b"".join(some(seq[i : i + step]) for i in range(0, len(seq), step))


def unpack(raw: bytes, step: int = 1 << 18) -> np.ndarray:
    def some(data):
        ends = np.flatnonzero(data & 128)
        size = np.diff(ends, prepend=-1)
        out = np.zeros(len(ends), np.uint32)
        for k in range(4):
            has = size > k
            out[has] |= (data[ends[has] - k] & 127).astype(np.uint32) << np.uint32(7 * k)
        return out

    data, parts, at = np.frombuffer(raw, np.uint8), [np.zeros(0, np.uint32)], 0
    while at < len(data):
        end = min(len(data), at + step)
        while not data[end - 1] & 128:
            end -= 1
        parts.append(some(data[at:end]))
        at = end
    return np.concatenate(parts)


def _encode_words(path: str, pat: str, flush: int = 200_000):
    """(word, owner, number) sorted by word -> (owner, payload): each distinct word is encoded once, ids go by block."""

    def out(held):
        owners, rows = [], []
        for owner, (numbers, ids) in held.items():
            owners.append(owner)
            sizes = np.array([len(x) for x in ids], np.uint32)
            flat = np.array([i for x in ids for i in x], np.uint32)
            rows.append((pack(np.array(numbers, np.uint32)), pack(sizes), pack(flat)))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], ["owner", "numbers", "sizes", "flat"])

    def run(batches):
        enc = encoder(path, pat)
        last, ids, held, n = None, [], {}, 0
        for batch in batches:
            for word, owner, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if word != last:
                    last, ids = word, enc._encode_single_piece(word)
                mine = held.get(owner)
                if mine is None:
                    mine = held[owner] = ([], [])
                mine[0].append(number)
                mine[1].append(ids)
                n += 1
            if n >= flush:
                yield out(held)
                held, n = {}, 0
        if held:
            yield out(held)
        held.clear()
        trim()

    return run


_CHUNK = pa.schema([("named", pa.string()), ("docs", pa.list_(pa.int64())), ("ids", pa.list_(pa.binary()))])


def _gathered(limit: int, name: str):
    """A function that takes documents and their ids, and gives a chunk (named, docs, ids) when there are limit ids, or at the end (no argument)."""
    docs, ids, size = [], [], 0

    def add(doc=None, raw=None):
        nonlocal size
        if raw is not None:
            docs.append(doc), ids.append(raw)
            size += len(raw) // 4
            if size < limit:
                return []
        if not docs:
            return []
        out = pa.RecordBatch.from_pylist([{"named": name, "docs": docs, "ids": ids}], schema=_CHUNK)
        docs.clear(), ids.clear()
        size = 0
        return [out]

    return add


def _assemble(limit: int, name: str):
    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """One block: chunks of its documents' ids as packed 32-bit numbers."""
        parts = [(unpack(a), unpack(b), unpack(c)) for a, b, c in zip(*(right.column(x).to_pylist() for x in ("numbers", "sizes", "flat")))]
        numbers, sizes, flat = (np.concatenate(x) if parts else np.zeros(0, np.uint32) for x in (zip(*parts) if parts else ((), (), ())))
        ends = np.cumsum(sizes.astype(np.int64))
        starts, lengths = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        starts[numbers] = ends - sizes
        lengths[numbers] = sizes
        add, out = _gathered(limit, name), []
        for row in range(left.num_rows):
            seq, at = unpack(left.column("seq")[row].as_py()), 0
            for doc, size in zip(left.column("docs")[row].as_py(), np.frombuffer(left.column("sizes")[row].as_py(), np.uint32).tolist()):
                s = seq[at : at + size]
                at += size
                n = lengths[s]
                before = np.cumsum(n) - n
                out += add(doc, flat[np.repeat(starts[s] - before, n) + np.arange(int(n.sum()))].astype("<u4").tobytes())
        del parts, numbers, sizes, flat
        trim()
        return pa.Table.from_batches(out + add(), schema=_CHUNK)

    return one


def encode_documents(docs: DataFrame, path: str = "", pat: str = "", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids (little-endian 32-bit numbers, packed) for each row of docs (doc_id, text)."""
    return _encoded(docs, path, pat, block_chars).select(F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), "ids")))


def _encoded(docs: DataFrame, path: str, pat: str, block_chars: int) -> DataFrame:
    """Chunks of encoded documents: named, docs, ids."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _blocks(block_chars, pat), "block bigint, docs array<bigint>, sizes binary, seq binary, words array<binary>"
    )
    # bucketed by block, so that the sequences needn't be shuffled to meet their words
    blocks = store_by(found, "bpe", ["block"], "zstd")
    uses = blocks.select(F.col("block").alias("owner"), F.posexplode("words").alias("number", "word"))
    sent = uses.select("word", "owner", "number").repartition(n, "word").sortWithinPartitions("word")
    encoded = sent.mapInArrow(_encode_words(path, pat), "owner bigint, numbers binary, sizes binary, flat binary")
    return blocks.select("block", "docs", "sizes", "seq").groupBy("block").cogroup(encoded.groupBy("owner")).applyInArrow(_assemble(CHUNK_IDS, path or DEFAULT_VOCABULARY), "named string, docs array<bigint>, ids array<binary>")


def token_bytes(spark, path: str = "") -> DataFrame:
    """The token-byte table: vocabulary, id, bytes."""
    table = vocabulary(path)
    return spark.createDataFrame(pa.table({"vocabulary": pa.array([path or DEFAULT_VOCABULARY] * len(table)), "id": pa.array(range(len(table)), pa.int32()), "bytes": pa.array(table, pa.binary())}))


def _chunks(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> rows of several documents, with the name of their vocabulary: named, docs, ids."""
    name = path or DEFAULT_VOCABULARY

    def run(batches):
        add = _gathered(CHUNK_IDS, name)
        for batch in batches:
            for doc, raw in zip(batch.column(0), batch.column(1)):
                yield from add(doc.as_py(), raw.as_py())
        yield from add()

    return encoded.select("doc_id", "ids").mapInArrow(run, "named string, docs array<bigint>, ids array<binary>")


def _decoded(chunks: DataFrame, path: str, finish, schema: str) -> DataFrame:
    """What finish makes of (doc_id, ids as stored, ids, their tokens' bytes) for each document, by a join with the token-byte table."""

    def run(batches):
        for batch in batches:
            table = None
            for i in range(batch.num_rows):
                if table is None:  # all rows of a run name one vocabulary
                    table = batch.column(2)[i].as_py()
                out = [finish(doc, raw, (ids := np.frombuffer(raw, "<u4").tolist()), [table[t] for t in ids]) for doc, raw in zip(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())]
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
        trim()

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    spark = chunks.sparkSession
    tokens = token_bytes(spark, path).groupBy("vocabulary").agg(F.sort_array(F.collect_list(F.struct("id", "bytes"))).alias("t"))
    tokens = tokens.select("vocabulary", F.transform("t", lambda x: x["bytes"]).alias("tokens"))
    return chunks.join(F.broadcast(tokens), F.col("named") == F.col("vocabulary")).select("docs", "ids", "tokens").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str = "") -> DataFrame:
    """doc_id, ids, decoded (bytes) for each row of encoded (doc_id, ids)."""
    finish = lambda doc, raw, ids, parts: {"doc_id": doc, "ids": raw, "decoded": b"".join(parts)}
    return _decoded(_chunks(encoded, path), path, finish, "doc_id bigint, ids binary, decoded binary")


def digests(encoded: DataFrame, path: str = "") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of encoded (doc_id, ids); the last from decoding the ids."""
    return _digests(_chunks(encoded, path), path)


def _digests(chunks: DataFrame, path: str) -> DataFrame:
    def finish(doc, raw, ids, parts):
        text = str(ids)[1:-1].replace(" ", "")
        return {"doc_id": doc, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(text.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(b"".join(parts)).hexdigest()}

    return _decoded(chunks, path, finish, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def digest_documents(docs: DataFrame, path: str = "", pat: str = "", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The digests of each row of docs (doc_id, text), stored; nothing else is left behind."""
    with scratch(docs.sparkSession) as keep:
        return keep(_digests(_encoded(docs, path, pat, block_chars), path), "digests")


def op8_byte_bpe(spark, sf_dir):
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
SQL: dict[str, str] = {}
