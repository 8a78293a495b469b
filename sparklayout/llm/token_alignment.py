"""Alignment of the token sequences that two tokenizers give for one text.

Both sequences are lists of byte ends. Where a token of each ends at the same byte, the text is cut; what lies
between two cuts is a group, and each token of A in a group is linked to each token of B in it. The lists of many texts
are merged as one: diagonals of the merge matrix, each found by binary search, cut it into pieces of equal work however
tokens and texts are spread; all pieces take their steps side by side and give the places where both lists end
together. A group that begins in one piece and ends in another is put together when the pieces' cuts are laid end to end.

How often two ids are linked is counted over the whole corpus: a block of documents gives its distinct pairs once, with the
number of documents that hold each; the sums over all blocks are joined back to the blocks' pairs, and each block gets
just the counts that it asks for. Tokens never leave the task that made them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparklayout.llm.common import Memo, give_back, held, sized, slices, small_batches
from sparklayout.sources.work import materialize

#: Merge steps of a piece.
PIECE = 128
#: Bytes of text that are merged as one, and that share one list of distinct pairs.
RUN_BYTES, BLOCK_BYTES = 2 << 20, 16 << 20
#: Groups of more links than this are counted by distinct ids instead of being written out.
WIDE = 1024
#: Bits of a pair of ids; a text's number within its run stands above them.
CODE_BITS = 40
#: What a worker remembers of chunks of text.
MEMO_BYTES = 64 << 20
#: Chunks start at a space or a line feed that follows something else than white space (see :class:`Pair`).
_CHUNKS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: What stands before chunks that are laid end to end; how many of those make a text, and texts a call.
_FIRST, JOINED, CALL = " a", 200, 100
_JOINS = re.compile(r"[^\s▁][ \n▁]|\n|▁ ")
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
_END = np.iinfo(np.int64).max


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first ``at`` elements of the merge of ``a`` and ``b`` (of equal ones a's first) are a's."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        i, j = np.minimum(mid, len(a) - 1), np.clip(at - mid - 1, 0, len(b) - 1)
        more = a[i] <= b[j]
        low, high = np.where(open_ & more, mid + 1, low), np.where(open_ & ~more, mid, high)
    return low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """For each value in both ascending lists: how many elements of each are up to it."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    total = len(a) + len(b)
    start = np.arange(0, total, piece, dtype=np.int64)
    i = diagonals(a, b, start)
    j = start - i
    a_, b_ = np.append(a, _END), np.append(b, _END)
    cuts = np.zeros((len(start), piece), bool)
    of_a = np.zeros((len(start), piece), np.int64)
    for step in range(piece):  # one step of every piece
        now_a, now_b = a_[i], b_[j]
        take = now_a <= now_b
        # b ends where the last of a did, which may belong to the piece before
        cuts[:, step] = ~take & (now_b == a_[i - 1]) & (i > 0) & (now_b != _END)
        of_a[:, step] = i
        i += take & (now_a != _END)
        j += ~take
        np.minimum(j, len(b), out=j)
    rows, steps = np.nonzero(cuts)
    ends_a = of_a[rows, steps]
    return ends_a, start[rows] + steps - ends_a + 1


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then the same for the others."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(maxsize=1024)
def _number(n: int) -> bytes:
    return np.uint32(n).tobytes()


class Pair:
    """Two tokenizers over chunks of text.

    Neither merges across a place where a space or a line feed follows something else than white space: A's
    pattern ends a word there, and no piece of B spans it, which is looked up in B's vocabulary (if one does, texts stay whole).
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocab = self.a.get_vocab()
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
        rest = [c for c in range(256) if c not in plain]
        byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(rest)}
        assert set(byte_of) == set(ByteLevel.alphabet())
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [self._b_token(x) for x in pieces]
        self.a_length, self.b_length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.whole = any(map(_JOINS.search, (x for i, x in enumerate(pieces) if not self.b.is_control(i))))
        self.space = self.b.piece_to_id("▁")
        of_a = [f"{i}{x}" for i in range(len(self.a_bytes)) for x in ",|"]
        self.text = of_a + [f"{i}{x}" for i in range(len(pieces)) for x in (",", ";", "")]
        self.memo = Memo(MEMO_BYTES)

    @staticmethod
    def _b_token(piece: str) -> bytes:
        found = _BYTE.fullmatch(piece)
        return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()

    def chunks(self, text: str) -> list[str]:
        return [text] if self.whole else _CHUNKS.findall(text)

    def learn(self, chunks: list[str]) -> None:
        """New chunks by both tokenizers: 32-bit numbers, how many ids A has, then A's ids and B's; nothing where the tokens'
        bytes aren't the chunk's.

        Chunks are laid end to end for a call and their ids cut apart again at the chunks' ends; those that white space ends, or
        that B may not spell, are encoded alone.
        """
        new = self.memo.unknown(chunks)
        joined = [] if self.whole else [c for c in new if c[0] in " \n" and not c[-1].isspace() and "▁" not in c]
        alone = new if not joined else list(set(new).difference(joined)) if len(joined) < len(new) else []
        for at in range(0, len(joined), CALL * JOINED):
            lists = [joined[k : k + JOINED] for k in range(at, min(at + CALL * JOINED, len(joined)), JOINED)]
            texts = [_FIRST + "".join(x) for x in lists]
            found_a = self.a.encode_batch_fast(texts, add_special_tokens=False)
            found_b = self.b.encode([t[1:] for t in texts], num_threads=1)  # B puts the space there again
            for own, text, a, b in zip(lists, texts, found_a, found_b, strict=True):
                ends = np.cumsum([len(_FIRST), *(map(len, own) if text.isascii() else (len(c.encode()) for c in own))])
                cut_a, cut_b = self._cut(a.ids, self.a_bytes, text, ends), self._cut(b, self.b_bytes, text, ends)
                if cut_a and cut_b:
                    made = [_number(len(x) // 4) + x + y for x, y in zip(cut_a, cut_b, strict=True)]
                    self.memo.learn(own, made)
                else:
                    alone += own
        if not alone:
            return
        found_a = [x.ids for x in self.a.encode_batch_fast(alone, add_special_tokens=False)]
        found_b = self.b.encode([x[1:] if x[0] == " " else x for x in alone], num_threads=1)
        out, a_of, b_of = [], self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for chunk, a, b in zip(alone, found_a, found_b, strict=True):
            if chunk == " ":
                b = [self.space]  # an empty text gets no space
            elif chunk[0] != " ":
                b = b[1:] if b and b[0] == self.space else [0, *b]
            good = b"".join(map(a_of, a)) == chunk.encode() == b"".join(map(b_of, b))
            out.append(np.array([len(a), *a, *b], np.uint32).tobytes() if good else b"")
        self.memo.learn(alone, out)

    @staticmethod
    def _cut(ids: list[int], tokens: list[bytes], text: str, ends: np.ndarray) -> list[bytes] | None:
        """The ids between two ``ends`` (bytes of ``text``) as 32-bit numbers; None if no token ends at one, or the text is another."""
        parts = [tokens[i] for i in ids]
        if b"".join(parts) != text.encode():
            return None
        at = np.cumsum(list(map(len, parts)))
        place = np.searchsorted(at, ends)
        if not np.array_equal(at[place], ends):
            return None
        data, place = np.array(ids, np.uint32).tobytes(), ((place + 1) * 4).tolist()
        return [data[i:j] for i, j in zip(place, place[1:], strict=False)]

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """For each text (with a space put before it): n_a, n_b, n_groups, n_links, digest of its groups; and the
        distinct linked pairs of all: ``doc`` (which text), ``code`` (a's id times the size of B, plus b's), ``times``."""
        index = _Numbered()
        lists = [self.chunks(" " + t) for t in texts]
        per_text = np.fromiter(map(len, lists), np.int64, len(lists))
        number = np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int64, int(per_text.sum()))
        known = list(index)
        self.learn(known)
        found = list(map(self.memo.__getitem__, known))
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        good = sizes > 0
        of_a = np.zeros(len(found), np.int64)
        of_a[good] = flat[starts[good]]
        of_b = np.maximum(sizes - 1 - of_a, 0)
        text_of = np.repeat(np.arange(len(texts)), per_text)
        bad = np.zeros(len(texts), bool)
        bad[text_of[~good[number]]] = True
        keep = ~bad[text_of]
        number, text_of = number[keep], text_of[keep]
        sides = []
        for at, counts, lengths in ((starts + 1, of_a, self.a_length), (starts + 1 + of_a, of_b, self.b_length)):
            ids = flat[spread(at[number], counts[number])].astype(np.int64)
            of_text = np.repeat(text_of, counts[number])
            sides.append((ids, np.cumsum(lengths[ids]), np.bincount(of_text, minlength=len(texts))))
        (a, a_ends, n_a), (b, b_ends, n_b) = sides
        to_a, to_b = common_ends(a_ends, b_ends)
        from_a, from_b = np.append(0, to_a)[:-1], np.append(0, to_b)[:-1]
        in_a, in_b = to_a - from_a, to_b - from_b
        links = in_a * in_b
        ends = np.cumsum(n_a)
        group_text = np.searchsorted(ends, from_a, "right")
        n_groups = np.bincount(group_text, minlength=len(texts))
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, group_text, links)

        base = len(self.b_bytes)
        narrow = links <= WIDE
        each_a = np.flatnonzero(np.repeat(narrow, in_a))
        of_group = np.repeat(np.arange(len(links)), in_a)[each_a]
        left = np.repeat(each_a, in_b[of_group])
        right = spread(from_b[of_group], in_b[of_group])
        key = (np.repeat(group_text[of_group], in_b[of_group]) << CODE_BITS) | (a[left] * base + b[right])
        keys, times = [key], [np.ones(len(key), np.int64)]
        for g in np.flatnonzero(~narrow):
            ids_a, by_a = np.unique(a[from_a[g] : to_a[g]], return_counts=True)
            ids_b, by_b = np.unique(b[from_b[g] : to_b[g]], return_counts=True)
            keys.append((group_text[g] << CODE_BITS) | (ids_a[:, None] * base + ids_b).ravel())
            times.append((by_a[:, None] * by_b).ravel())
        key, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, first) if len(first) else times
        key = key[first]

        # groups as text: a group's ids of A stand before its ids of B
        written = np.zeros(len(a) + len(b), np.int64)
        code = a * 2
        code[to_a - 1] += 1
        written[np.arange(len(a)) + np.repeat(from_b, in_a)] = code
        code = 2 * len(self.a_bytes) + b * 3
        code[to_b - 1] += 1
        code[np.cumsum(n_b)[n_b > 0] - 1] += 1
        written[np.arange(len(b)) + np.repeat(to_a, in_b)] = code
        codes, get, at, digests = written.tolist(), self.text.__getitem__, 0, []
        for n in (n_a + n_b).tolist():
            digests.append(hashlib.sha256("".join(map(get, codes[at : at + n])).encode()).hexdigest() if n else "")
            at += n
        self.memo.make_room()
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "digest": digests,
            "doc": key >> CODE_BITS, "code": key & ((1 << CODE_BITS) - 1), "times": times,
        }


class _Numbered(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


#: Columns of a document in a block, and of the block's pairs.
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, ids, n_a, n_b, n_groups, n_links, digests (one element a document), codes, n_docs (one a distinct pair),
    sizes (pairs of each document), data (compressed: for each document's pairs their place in codes, and their number; ``wide``
    of these have eight bytes at the end)."""
    id_type = docs.schema[id_col].dataType
    names = ["block", "ids", *_COUNTS, "digests", "codes", "n_docs", "sizes", "wide", "data"]
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.list_(to_arrow_type(id_type)), *[longs] * 4, pa.list_(pa.string()), *[longs] * 3, pa.int64(), pa.binary()]
    many = ", ".join(f"{x} array<bigint>" for x in _COUNTS)
    schema = f"block long, ids array<{id_type.simpleString()}>, {many}, digests array<string>, codes array<bigint>, n_docs array<bigint>, sizes array<bigint>, wide long, data binary"

    def block(number: int, ids: list, parts: list[dict]) -> pa.RecordBatch:
        whole = {k: np.concatenate([p[k] for p in parts]) for k in (*_COUNTS, "code", "times")}
        codes, place = np.unique(whole["code"], return_inverse=True)
        n_docs = np.bincount(place, minlength=len(codes))
        sizes = np.concatenate([np.bincount(p["doc"], minlength=len(p["n_a"])) for p in parts])
        wide = whole["times"] > 0xFFFF
        data = b"".join((place.astype("<u4").tobytes(), np.where(wide, 0, whole["times"]).astype("<u2").tobytes(), whole["times"][wide].astype("<i8").tobytes()))
        digests = [x for p in parts for x in p["digest"]]
        data = pa.compress(data, "zstd", asbytes=True)
        values = [number, ids, *(whole[k] for k in _COUNTS), digests, codes, n_docs, sizes, int(wide.sum()), data]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held("token_alignment", (a_path, b_path), lambda key: Pair(*key))
        number = TaskContext.get().partitionId() << 32
        ids, parts, size = [], [], 0
        for batch in batches:
            for part in slices(batch, "text", RUN_BYTES):
                texts = [x or "" for x in part.column("text").to_pylist()]
                some = [t or None for t in texts]
                found = pair.align([t for t in some if t])
                parts.append(_with_empty(found, np.array([t is not None for t in some], bool)))
                ids += part.column("doc_id").to_pylist()
                size += part.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield block(number, ids, parts)
                    number, ids, parts, size = number + 1, [], [], 0
        if ids:
            yield block(number, ids, parts)
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(align, schema)


def _with_empty(found: dict, filled: np.ndarray) -> dict:
    """Results of the texts that have something, with zeros for those that don't."""
    at = np.flatnonzero(filled)
    out = {"code": found["code"], "times": found["times"], "doc": at[found["doc"]] if len(at) else found["doc"]}
    for k in _COUNTS:
        out[k] = np.zeros(len(filled), np.int64)
        out[k][at] = found[k]
    out["digest"] = [""] * len(filled)
    for i, x in zip(at.tolist(), found["digest"], strict=True):
        out["digest"][i] = x
    return out


def pair_counts(blocks: DataFrame, b_size: int) -> DataFrame:
    """code, count (documents that hold the pair), best (whether no pair of the same id of A is held by more)."""
    each = blocks.select(F.explode(F.arrays_zip("codes", "n_docs")).alias("x")).select("x.codes", "x.n_docs")
    counts = materialize(each.groupBy(F.col("codes").alias("code")).agg(F.sum("n_docs").alias("count")), "pairs")
    of_a = F.expr(f"code div {b_size}").alias("a")
    highest = counts.groupBy(of_a).agg(F.max("count").alias("highest"))
    known = counts.withColumn("a", of_a).join(sized(highest), "a")
    return known.select("code", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path``: a byte-level BPE for the tokenizers library; ``b_path``: a sentencepiece model with byte fallback that
    puts a space before a text; A gets that space too. Special tokens' strings are ordinary text. ``n_best``: links whose
    pair's count is the highest of its id of A; ``count_sum``: the sum of counts over all links. Rows count as documents
    of their own, repeated ones too. Null and empty texts, and texts whose tokens don't spell them (they hold U+2581),
    have zeros and an empty digest. An empty table gives an empty result. Other columns aren't read.
    """
    import sentencepiece

    small_batches(docs.sparkSession)
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    blocks = materialize(aligned_blocks(docs, a_path, b_path, id_col, text_col), "aligned")
    known = materialize(pair_counts(blocks, b_size), "known")
    asked = blocks.select(F.col("block").alias("of"), F.explode("codes").alias("code")).join(sized(known), "code")
    id_type = docs.schema[id_col].dataType

    def finish(key: tuple, block: pa.Table, counted: pa.Table) -> pa.Table:
        order = np.argsort(counted.column("code").to_numpy())
        counts = counted.column("count").to_numpy()[order]
        best = counted.column("best").combine_chunks().to_numpy(zero_copy_only=False)[order].astype(np.int64)
        row = {name: block.column(name)[0] for name in block.column_names}
        sizes = row["sizes"].values.to_numpy()
        n = int(sizes.sum())
        extra = row["wide"].as_py()  # numbers that two bytes can't hold
        data = pa.decompress(row["data"].as_buffer(), 6 * n + 8 * extra, "zstd")
        place = np.frombuffer(data, "<u4", n)
        times = np.frombuffer(data, "<u2", n, 4 * n).astype(np.int64)
        times[times == 0] = np.frombuffer(data, "<i8", extra, 6 * n)
        upto = lambda x: np.append(0, np.cumsum(x))
        ends = upto(sizes)
        sums = [np.diff(upto(times * x[place])[ends]) if n else np.zeros(len(sizes), np.int64) for x in (best, counts)]
        columns = [row["ids"].values, *(row[k].values for k in _COUNTS), *map(pa.array, sums), row["digests"].values]
        return pa.table(dict(zip((id_col, *_COUNTS, "n_best", "count_sum", "groups_sha256"), columns, strict=True)))

    schema = f"`{id_col}` {id_type.simpleString()}, " + ", ".join(f"{x} long" for x in (*_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"
    return blocks.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(finish, schema)
