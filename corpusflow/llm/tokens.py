"""Tokenisation with the ``tokenizers`` library, and token files.

``encode_texts`` memoises: this vocabulary's normaliser and pre-tokeniser
never join anything over a blank, so a text's ids are those of its
blank-separated parts in a row, and each distinct part goes through the library
once per worker.  Vocabularies that look across blanks (byte-level ones) are
encoded whole.

Token files hold documents' ids, in ascending ``doc_id`` order, as Arrow
streams of two fixed-size-list columns, ``input_ids`` and ``attention_mask``
(0 marks the padding of a file's last sequence).  All batches of a file but the
last have the same number of sequences, and its side file (an Arrow stream of
doc_id, start, n_tokens within the file) is accompanied by the places of the
batches in the file.  Nothing is compressed, so sequence ``i`` of a mapped
file is a slice of the file's own memory: see ``TokenFile``.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Bounded, _fs, durable, fresh_path, holds, release, shuffle_partitions, tokenizer_path, turn_to


_MARKS = frozenset(",.")


_MEMOS: list[Bounded] = []
#: Parts in a generation of a memo, about 300 bytes each; a memo has two generations, a worker two memos.  Fewer cost
#: time, and are for stages that share their executors with what others left.
MEMO, SMALL_MEMO = 250_000, 64_000


def _forget() -> None:
    for memo in _MEMOS:
        memo.clear()
        memo.old = {}


holds("tokens", _forget)


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: 256 + i for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _encoder(path: str):
    """text -> little-endian unsigned ids as bytes, and their numpy type."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    dtype = np.dtype("<u2") if tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    def ids(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, dtype=dtype).tobytes()

    spec = json.loads(tok.to_str())
    pre = json.dumps(spec.get("pre_tokenizer") or {})
    norm = json.dumps(spec.get("normalizer") or {})
    del spec
    release()  # the file's text and the tables it was read from
    drops_blanks = '"Removed"' in pre and "[^\\\\s" in pre and "Prepend" not in norm
    if not drops_blanks:
        return ids, dtype
    model, mapped = tok.model, _byte_letters()

    def letters(word: str) -> bytes:
        """Normalised words of letters alone are one pre-token: the model's input."""
        if not word.isalpha():
            # a comma or full stop after a letter is a pre-token of its own
            return normal[word[:-1]] + normal[word[-1]] if word[-1:] in _MARKS and word[-2:-1].isalpha() else ids(word)
        return np.array([t.id for t in model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(mapped))], dtype=dtype).tobytes()

    normal = Bounded(letters, MEMO)
    sure = all(letters(w) == ids(w) for w in ("the", "words", "schön", "été", "año", "слово", "言葉", "ꙮaa", "so,", "été."))
    lowers = '"Lowercase"' in norm and '"NFC"' in norm
    other = Bounded(ids, MEMO)
    normal = normal if sure else other
    _MEMOS.extend((normal, other))
    nfc = unicodedata.is_normalized

    def by_part(text: str) -> bytes:
        memo = other
        if lowers and "\u03a3" not in text and nfc("NFC", text) and nfc("NFC", low := text.lower()):
            text, memo = low, normal  # what the normaliser would make of it
        return b"".join(map(memo.__getitem__, text.replace("\n", " ").split(" ")))

    return by_part, dtype


def encode_texts(texts: Iterable[str | None], path: str | None = None, memo: int = MEMO) -> Iterator[np.ndarray]:
    """Ids of each whole text (None: empty).  ``memo`` bounds what is remembered, not the result."""
    turn_to("tokens")
    encode, dtype = _encoder(path or tokenizer_path())
    for held in _MEMOS:
        held.limit = memo
    for text in texts:
        yield np.frombuffer(encode(text or ""), dtype)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


#: How an Arrow stream ends.
_END = b"\xff\xff\xff\xff\x00\x00\x00\x00"
#: Bytes of text per token file, as a rule; cuts of the ids that are measured, not interpolated.
FILE_BYTES, CUTS = 64 << 20, 2000


class _Writer:
    """One shard: sequences are written as they fill up; ids wait in a buffer
    of at most one batch."""

    def __init__(self, base: str, shard: int, seq_len: int, dtype: np.dtype, batch: int):
        self.seq_len, self.dtype, self.batch = seq_len, dtype, batch
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"  # a repeated task never touches another's file
        self.uri = f"{base}/{name}.arrow"
        fs, path = _fs(base)
        fs.create_dir(path, recursive=True)
        self.out, self.index_out = fs.open_output_stream(f"{path}/{name}.arrow"), fs.open_output_stream(f"{path}/{name}.index.arrow")
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(kind, seq_len)), ("attention_mask", pa.list_(pa.uint8(), seq_len))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.base, self.name = base, name
        self.out.write(self.schema.serialize())
        self.index = ipc.new_stream(self.index_out, self.index_schema)
        self.places: list[int] = []
        self.sequences = 0
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0
        self.docs: tuple[list, list, list] = ([], [], [])
        self.n_docs = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for column, x in zip(self.docs, (doc_id, self.total, len(ids)), strict=True):
            column.append(x)
        self.n_docs += 1
        self.total += len(ids)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.batch * self.seq_len:
            self._sequences(last=False)
        if len(self.docs[0]) >= 8192:
            self._index()

    def _index(self) -> None:
        self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in self.docs], schema=self.index_schema))
        self.docs = ([], [], [])

    def _sequences(self, last: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)
        step = self.batch
        n = -(-len(ids) // self.seq_len) if last else len(ids) // self.seq_len // step * step  # whole batches, but for the last
        for at in range(0, n, step):
            k = min(step, n - at)
            part = ids[at * self.seq_len : (at + k) * self.seq_len]
            mask = np.ones(k * self.seq_len, "uint8")
            if len(part) < k * self.seq_len:
                mask[len(part) :] = 0
                part = np.concatenate([part, np.zeros(k * self.seq_len - len(part), self.dtype)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (part, mask)]
            self.places.append(self.out.tell())
            self.out.write(pa.record_batch(columns, schema=self.schema).serialize())
            self.sequences += k
        rest = ids[n * self.seq_len :]
        self.parts, self.held = [rest] if len(rest) else [], len(rest)

    def close(self) -> None:
        self._sequences(last=True)
        self._index()
        self.out.write(_END)
        for x in (self.index, self.out, self.index_out):
            x.close()
        fs, path = _fs(f"{self.base}/{self.name}.batches.arrow")
        kept = pa.record_batch([pa.array(self.places, pa.int64())], names=["place"])
        with fs.open_output_stream(path) as out, ipc.new_stream(out, kept.schema.with_metadata({"sequences": str(self.sequences), "batch": str(self.batch)})) as file:
            file.write_batch(kept)


def write_token_files(docs: DataFrame, base: str | None = None, tokenizer: str | None = None, seq_len: int = 2048, end_id: int | None = 1, batch: int = 64, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text), append ``end_id``
    and write the ids in ascending doc_id order as token files under ``base``
    (default: a fresh folder in the shared one).

    Returns one row per file, in order: shard int, uri, n_docs, n_tokens.
    Null texts give the end id alone; null ids come first; rows that share an
    id follow each other.  Other columns are not read.  An empty table gives no
    files.

    There is a file for every ``file_bytes`` of text, and one per shuffle
    partition at least.  Ranges of doc_id come from one scan
    (``percentile_approx``), so the text is encoded once and only compressed ids
    are shuffled.  An id with so many rows that several ranges end at it has
    them dealt over these files by their place in the scan, and so have rows
    without id theirs.
    """
    spark = docs.sparkSession
    base = base or fresh_path(spark, "token-files")
    path = tokenizer or tokenizer_path()
    levels = [k / CUTS for k in range(1, CUTS)]
    size = F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")
    seen = docs.agg(F.percentile_approx("doc_id", levels, 10_000).alias("cuts"), size, F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    n = max(shuffle_partitions(spark), -(-seen["bytes"] // file_bytes))
    coarse = min(n, CUTS)
    lost = -(-n * seen["none"] // max(1, seen["n"]))  # files for rows without id
    cuts = np.array(seen["cuts"] or [], "int64")
    cuts = _finer(cuts[[k * CUTS // coarse - 1 for k in range(1, coarse)]] if len(cuts) else cuts, -(-n // coarse))
    parts = len(cuts) + 1 + lost

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 512):
                own, row, texts = (b.column(c)[lo : lo + 512] for c in ("doc_id", "row", "text"))
                blobs, sizes = [], []
                for x in encode_texts(texts.to_pylist(), path):
                    raw = x.tobytes()
                    blobs.append(pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")
                    sizes.append(len(raw))
                row, none = row.to_numpy(), own.is_null().to_numpy(zero_copy_only=False)
                ids = own.fill_null(0).to_numpy()
                first, last = np.searchsorted(cuts, ids, side="left"), np.searchsorted(cuts, ids, side="right")
                part = lost + first + np.where(last > first + 1, row % np.maximum(1, last - first), 0)
                part = np.where(none, row % max(1, lost), part)
                yield pa.RecordBatch.from_arrays([own, pa.array(part.astype("int32")), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "part", "size", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dtype = _encoder(path)
        out = shard = None
        end = np.array([] if end_id is None else [end_id], dtype)
        for b in batches:
            for doc_id, part, size, blob in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "size", "ids")), strict=True):
                if part != shard:
                    if out is not None:
                        yield closed(out, shard)
                    shard, out = part, _Writer(base, part, seq_len, dtype, batch)
                raw = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
                out.add(doc_id, np.concatenate([np.frombuffer(raw, dtype), end]))
        if out is not None:
            yield closed(out, shard)

    def closed(out: _Writer, shard: int) -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([out.uri]), pa.array([out.n_docs], pa.int64()), pa.array([out.total], pa.int64())], names=["shard", "uri", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    coded = rows.mapInArrow(encode, "doc_id long, part int, size long, ids binary")
    sorted_ = coded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    shards = sorted_.mapInArrow(write, "shard int, uri string, n_docs long, n_tokens long")
    return durable(shards, "token-shards")  # the files are written once; later reads only see these names


def _finer(cuts: np.ndarray, times: int) -> np.ndarray:
    """Each range between cuts in so many of equal width."""
    if times <= 1 or len(cuts) < 2:
        return cuts
    return np.interp(np.arange((len(cuts) - 1) * times + 1) / times, np.arange(len(cuts)), cuts).astype("int64")


class TokenFile:
    """Random access to a token file.  ``get(i)`` is sequence ``i`` and its
    mask; where the file can be mapped, both are views of the mapped file, and
    nothing but the message that holds them is looked at.  Elsewhere only that
    message's bytes are read."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        with fs.open_input_stream(path.removesuffix(".arrow") + ".batches.arrow") as f:
            side = ipc.open_stream(f).read_all()
        known = side.schema.metadata
        self.sequences, self.batch = int(known[b"sequences"]), int(known[b"batch"])
        size = fs.get_file_info(path).size
        self.places = [*side.column("place").to_pylist(), size - len(_END)]
        self.file = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.schema = ipc.read_schema(pa.BufferReader(self._bytes(0, self.places[0])))
        self.seq_len = self.schema.field("input_ids").type.list_size

    def __len__(self) -> int:
        return self.sequences

    def _bytes(self, lo: int, hi: int) -> pa.Buffer:
        self.file.seek(lo)
        return self.file.read_buffer(hi - lo)

    def batch_at(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of a batch and their masks, a row each."""
        message = ipc.read_message(pa.BufferReader(self._bytes(self.places[b], self.places[b + 1])))
        columns = ipc.read_record_batch(message, self.schema).columns
        ids, mask = (c.values.to_numpy(zero_copy_only=True).reshape(-1, self.seq_len) for c in columns)
        return ids, mask

    def get(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < self.sequences:
            raise IndexError(i)
        ids, mask = self.batch_at(i // self.batch)
        return ids[i % self.batch], mask[i % self.batch]


def _read(uri: str) -> Iterator[tuple[int | None, int, int, int]]:
    """doc_id, start in the file, n_tokens and crc32 of each document, reading
    the file batch by batch."""
    fs, path = _fs(uri)
    with fs.open_input_stream(path) as f, fs.open_input_stream(path.removesuffix(".arrow") + ".index.arrow") as g:
        batches = iter(ipc.open_stream(f))
        held, at = np.empty(0, "<u4"), 0
        for index in ipc.open_stream(g):
            for doc_id, start, n in zip(*(index.column(k).to_pylist() for k in range(3)), strict=True):
                crc, left = 0, n
                while left:
                    if at == len(held):
                        b = next(batches)
                        ids, mask = (c.flatten().to_numpy() for c in (b.column(0), b.column(1)))
                        held, at = (ids if mask.all() else ids[mask > 0]).astype("<u4"), 0
                        continue
                    k = min(left, len(held) - at)
                    crc = zlib.crc32(held[at : at + k].tobytes(), crc)
                    at, left = at + k, left - k
                yield doc_id, start, n, crc


def read_token_files(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """One row per document, read back from the files: doc_id, start (ids of
    all documents before it), n_tokens, ids_crc32.  Shards are read apart, one
    task each."""
    # one row per file: the running sum is over as many rows as there are files
    before = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("base").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, start, n, crc in _read(uri):
                    rows.append((doc_id, base + start, n, crc))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return before.select("shard", "uri", "base").repartitionById(shuffle_partitions(spark), F.col("shard")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
