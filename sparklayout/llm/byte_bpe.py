"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every byte is mapped to one character, every vocabulary entry becomes a piece scored by its negative rank,
and normalisation is the identity; so sentencepiece's best-score-first merges are the rank-first merges of
the rank file. Texts are cut into pre-tokens by a pattern, pre-tokens are encoded separately, and ids are
decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparklayout.llm.common import Memo, held, slices, small_batches

#: Where the 256 bytes go: one assigned character each, none of them white space.
BYTE_CHARS = [chr(0x100 + b) for b in range(256)]
#: What a worker remembers of pre-tokens and their ids.
MEMO_BYTES = 64 << 20


def read_ranks(path: str) -> bytes:
    """The rank file as it is: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> list[bytes]:
    """Tokens in order of rank; ranks must be 0, 1, 2, ..."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be consecutive from 0")
    return [token for _, token in pairs]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(BYTE_CHARS[b] for b in token), score=-float(rank), type=1)
    model.pieces.add(piece="<unk>", score=0.0, type=2)
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens = parse_ranks(ranks)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.table = {i: c for i, c in enumerate(BYTE_CHARS)}
        # a pre-token that is itself in the vocabulary is one id, even where the merges don't lead to it
        self.whole = {}
        for rank, token in enumerate(self.tokens):
            if self.model.encode(self._mapped(token), num_threads=1) != [rank]:
                self.whole[token] = rank
        self.memo = Memo(MEMO_BYTES, lambda token: ",".join(map(str, self.encode_pretoken(token))))
        self.by_text = {str(i): t for i, t in enumerate(self.tokens)}

    def _mapped(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.table)

    def encode_pretoken(self, token: str) -> list[int]:
        data = token.encode("utf-8")
        if data in self.whole:
            return [self.whole[data]]
        return self.model.encode(self._mapped(data), num_threads=1)

    def encode_joined(self, text: str) -> str:
        """The ids of a text as decimal numbers with commas between."""
        self.memo.make_room()
        return ",".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def decode_joined(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split(","))) if ids else b""


_IDS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.StringType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("exact", T.BooleanType()),
    ]
)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True
) -> DataFrame:
    """id, n_tokens, ids (decimal, commas between; left out if ``ids`` is false), ids_sha256,
    decoded_sha256 and whether decoding gave the text's bytes back.

    Null text counts as empty: no tokens, digests of nothing. Other columns are not read. The rank file is
    read once on the driver and sent along; ``pattern`` needs the ``regex`` syntax.
    """
    small_batches(docs.sparkSession)
    ranks = read_ranks(ranks_path)
    rows = docs.select(id_col, text_col)
    fields = [f for f in _IDS.fields if ids or f.name != "ids"]
    schema = T.StructType([rows.schema[id_col], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held("byte_bpe", (ranks, pattern), lambda key: Codec(*key))
        for batch in batches:
            for part in slices(batch, text_col, 4 << 20):
                out: dict[str, list] = {f.name: [] for f in fields}
                for text in part.column(text_col).to_pylist():
                    text = text or ""
                    joined = own.encode_joined(text)
                    back = own.decode_joined(joined)
                    out["n_tokens"].append(joined.count(",") + 1 if joined else 0)
                    if ids:
                        out["ids"].append(joined)
                    out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                    out["exact"].append(back == text.encode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), *map(pa.array, out.values(), map(_ARROW.get, out))], [id_col, *out]
                )

    return rows.mapInArrow(run, schema)


_ARROW = {
    "n_tokens": pa.int64(),
    "ids": pa.string(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
    "exact": pa.bool_(),
}
