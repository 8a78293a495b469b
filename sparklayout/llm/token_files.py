"""Token ids in length-delimited binary files with a separate offset index.

A file is a run of records. A record is: payload length (8 bytes), masked checksum of those 8 bytes
(4 bytes), payload, masked checksum of the payload (4 bytes); all little-endian. The payload is one byte,
2 or 4, and the document's ids as unsigned integers of so many bytes. The checksum is CRC-32, rotated right by 15 bits and shifted
by a constant, so that checksums of data that hold checksums stay apart. The index has one row per record
with file, offset and length: any record can be read alone, in any order.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklayout.llm.common import Memo, held, slices
from sparklayout.sources.work import materialize, new_path

#: What a worker remembers of words, and again of pieces of words.
MEMO_BYTES = 96 << 20
#: Pieces that are encoded in one call.
CALL = 10_000
MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one framed record; raises ValueError if it is damaged."""
    if len(data) < 16:
        raise ValueError("record is cut short")
    head, payload = data[:8], data[12:-4]
    if struct.unpack("<I", data[8:12])[0] != masked(head) or struct.unpack("<Q", head)[0] != len(payload):
        raise ValueError("record length is damaged")
    if struct.unpack("<I", data[-4:])[0] != masked(payload):
        raise ValueError("record payload is damaged")
    return payload


def pack(ids: bytes) -> bytes:
    """32-bit ids as a payload: 16 bits each if they all fit."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x04" + ids if len(wide) and wide.max() > 0xFFFF else b"\x02" + wide.astype("<u2").tobytes()


def unpack(payload: bytes) -> bytes:
    """32-bit ids of a payload."""
    return payload[1:] if payload[:1] == b"\x04" else np.frombuffer(payload, "<u2", offset=1).astype("<u4").tobytes()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Whatever store the shared folder is in: a local or mounted path, file:, hdfs:, s3:, gs: ..."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


#: White space to str.split(), but not to the tokenizer's pattern.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Beyond these characters normalisation may join some, and lower case may depend on what follows.
_BEYOND = re.compile("[\u0250-\U0010ffff]")
#: A word that has such characters, or a run of others.
_RUNS = re.compile(r"\S*[\u0250-\U0010ffff]\S*|[^\u0250-\U0010ffff]+(?=\s|\Z)")
#: What the tokenizer's pre-tokeniser keeps apart (a fixed value of the tokenizer file).
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Whole texts by words: the tokenizer drops white space and never merges across it or across the
    pieces of a word. So the new words of a run of texts are cut into pieces, the new pieces are encoded in
    one call, and words and pieces are remembered, within MEMO_BYTES each."""

    def __init__(self, config: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.find = regex.compile(_PIECES).findall
        bare = json.loads(config)
        # texts that hold one of these, or an added token's string, are left to the library as they are
        self.odd = (*_SEPARATORS, *(x["content"] for x in bare.get("added_tokens") or []))
        steps = (bare.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.suffix = (bare.get("model") or {}).get("end_of_word_suffix")
        self.known = bool(self.suffix) and any(x.get("pattern", {}).get("Regex") == _PIECES for x in steps)
        if self.known:  # pieces are normalised and split already
            rest = [x for x in steps if x["type"] != "Split"]
            bare |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": rest}, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            vocab = self.bare.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for token, i in vocab.items() if token.endswith(self.suffix)]] = True
        self.pieces, self.words = Memo(MEMO_BYTES), Memo(MEMO_BYTES)

    def encode_whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn_pieces(self, pieces: list[str]) -> None:
        """One call for many: a piece ends where a token has the suffix that ends words."""
        found = self.bare.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids
        ids = np.array(found, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) == len(pieces):
            data = ids.tobytes()
            self.pieces.learn(pieces, [data[a:b] for a, b in zip([0, *ends], ends)])
        else:
            self.pieces.learn(pieces, [_packed(self.bare.encode(p, add_special_tokens=False).ids) for p in pieces])

    def _learn_words(self, words: list[str]) -> None:
        """``words`` are in lower case."""
        cut = [[w] if w.isalpha() else [w[:-1], w[-1]] if w[:-1].isalpha() else self.find(w) for w in words]
        self.pieces.make_room()
        fresh = self.pieces.unknown(set(chain.from_iterable(cut)))
        for at in range(0, len(fresh), CALL):
            self._learn_pieces(fresh[at : at + CALL])
        get = self.pieces.__getitem__
        self.words.learn(words, [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in cut])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        odd = [not self.known or any(x in t for x in self.odd) or (not t.isascii() and bool(_BEYOND.search(t))) for t in texts]
        cut = [[] if o else t.lower().split() for t, o in zip(texts, odd, strict=True)]
        self.words.make_room()
        self._learn_words(self.words.unknown(set().union(*cut)))
        get = self.words.__getitem__
        return [self._encode_odd(t) if o else b"".join(map(get, words)) for t, o, words in zip(texts, odd, cut, strict=True)]

    def _encode_odd(self, text: str) -> bytes:
        """Word by word where that is safe, in runs of plain words; else the whole text at once."""
        if not self.known or any(x in text for x in self.odd):
            return self.encode_whole(text)
        return b"".join(self.encode_whole(w) if _BEYOND.search(w) else self.encode(w) for w in _RUNS.findall(text))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_INDEX = "doc_id {id}, file_no int, file string, row_no long, offset long, length long, n_tokens long, start_in_file long"


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode, write and return the offset index: doc_id, file_no, file, row_no, offset, length, n_tokens,
    start (ids of all documents before it).

    Documents are in ascending id order (null ids first, equal ids by text) over the files and inside each
    file. Null text counts as empty: its record holds the end id only. A task writes one file under a new
    name, and only files that the index names count, so repeated tasks do no harm. The index itself is a
    table in the shared folder. Ids are those of the tokenizers library with add_special_tokens off: an added
    token's string inside a text becomes that token. An empty input gives an empty index.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        config = f.read()
    folder = new_path(spark, "tokens")
    end = struct.pack("<I", end_id)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions("doc_id", "text")
    schema = _INDEX.format(id=rows.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = held("token_files", config, Encoder).encode_all
        number = TaskContext.get().partitionId()
        store, root = file_system(folder)
        name = f"part-{number:06d}-{uuid.uuid4().hex}.bin"
        out, offset, start, row_no = None, 0, 0, 0
        try:
            for batch in batches:
                for part in slices(batch, "text", 4 << 20):
                    index: list[tuple[int, int, int, int]] = []
                    for ids in encode_all([x or "" for x in part.column("text").to_pylist()]):
                        ids += end
                        record = frame(pack(ids))
                        if out is None:
                            store.create_dir(root, recursive=True)
                            out = store.open_output_stream(f"{root}/{name}")
                        out.write(record)
                        index.append((row_no, offset, len(record), len(ids) // 4, start))
                        offset, start, row_no = offset + len(record), start + len(ids) // 4, row_no + 1
                    n = len(index)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            pa.array([number] * n, pa.int32()),
                            pa.array([f"{folder}/{name}"] * n, pa.string()),
                            *(pa.array(list(x), pa.int64()) for x in zip(*index, strict=True)),
                        ],
                        ["doc_id", "file_no", "file", "row_no", "offset", "length", "n_tokens", "start_in_file"],
                    )
        finally:
            if out is not None:
                out.close()

    index = materialize(placed.mapInArrow(run, schema), "token-index")
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))  # one row a file
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        index.join(F.broadcast(starts), "file_no")
        .withColumn("start", F.col("_start") + F.col("start_in_file"))
        .drop("_start", "start_in_file")
    )


def read_token_files(index: DataFrame) -> DataFrame:
    """Read the records that ``index`` names, check them, and return doc_id, start, n_tokens, ids (32 bits
    each) and ids_crc32. Each index row is read alone by its offset, so rows may come in any order."""
    rows = index.select("doc_id", "start", "file", "offset", "length")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids binary, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                payloads = []
                for file, offset, length in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    if file != name:
                        if source is not None:
                            source.close()
                        store, path = file_system(file)
                        name, source = file, store.open_input_file(path)
                    source.seek(offset)
                    payloads.append(unpack(unframe(source.read(length))))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("start"),
                        pa.array([len(x) // 4 for x in payloads], pa.int64()),
                        pa.array(payloads, pa.binary()),
                        pa.array([zlib.crc32(x) for x in payloads], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )
        if source is not None:
            source.close()

    return rows.mapInArrow(run, schema)
