"""Token ids in flat binary files with 64-bit document offsets.

A corpus becomes shards. Each shard is one flat file of unsigned integers
(``.bin``: all ids of its documents, one after another) and one index file
(``.idx``: document ids, their validity, and ``n + 1`` 64-bit offsets). Shards
follow each other in ascending document order; where a shard begins in the
whole corpus comes from prefix sums over the manifest, so no task needs to see
another's rows. Files are memory-mapped on reading where the store is local and
read by ranges elsewhere; there are as many shards as the bytes of text ask for.

The manifest names the very file that a successful task attempt wrote. Files
of lost or repeated attempts stay unnamed, so retries cannot mix shards.

Defined results: the literal of an added token in a text is that token, as the
library has it; a null or empty text has the end id only; an empty table gives
no shard and no row; a null id sorts first; repeated ids are ordered by text;
other columns are ignored.
"""

from __future__ import annotations

import codecs
import itertools
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmark.llm.common import fresh_path, materialize, text_or_empty, tidy, utf8

#: Words kept by one worker, and the first learned, mostly common ones, that stay when the rest goes (about 150 bytes each).
MEMO_WORDS, CORE_WORDS = 1_000_000, 500_000
#: Bytes of the longest word that is kept; longer ones (scripts without spaces) go to the library each time.
MEMO_BYTES = 48
#: UTF-8 bytes of text that one shard takes, and bytes read at once from a shard in a remote store.
SHARD_BYTES, READ_BYTES = 256 << 20, 16 << 20

#: White space that is not ASCII, and ASCII separators that only some libraries count as such.
_ODD_SPACES = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u205f", "\u3000"]
_ODD_SPACES = [x.encode() for x in _ODD_SPACES]
_QUAD_TO_HAIR_SPACE = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
#: ASCII marks without the apostrophe, and what is no letter among two-byte characters that begin with C3.
_MARKS, _NO_LETTERS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", (b"\x97", b"\xb7")
_SPACED_WORD = re.compile(rb" ?\S+|\s+(?!\S)|\s+")
#: Words of nothing but letters from A to ÿ: any byte-level tokenizer takes one, with the space before it, as one piece.
_PLAIN_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _byte_characters() -> str:
    """The character of each byte in a byte-level vocabulary: printable ones stand for themselves, others follow from 256 on."""
    rest = itertools.count(256)
    return "".join(chr(b) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else chr(next(rest)) for b in range(256))


_BYTE_CHARACTERS = _byte_characters()



def has_odd_space(text: bytes) -> bool:
    return any(x in text for x in _ODD_SPACES) or (b"\xe2\x80" in text and bool(_QUAD_TO_HAIR_SPACE.search(text)))


_ENCODERS: dict[tuple, "WordEncoder"] = {}


class WordEncoder:
    """The tokenizers library behind a memo of whole words.

    Both kinds of tokenizer cut a text at white space before they merge, so the
    ids of a text are those of its space-separated pieces, in order. A piece is
    encoded by the library and looked up afterwards. Texts with white space
    other than ASCII, or with an added token, go to the library whole. A piece
    of plain letters goes straight to the library's merge model, which is all
    that acts on it; a tokenizer that gives other ids for probes is not asked so.

    keeps_space: the space before a word belongs to its token (byte-level BPE);
    otherwise white space vanishes (BPE with word ends).
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() if keeps_space else t.content.encode().lower() for t in added]
        self.memo: dict[bytes, bytes] = {}
        self.core: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        probes = [b"a", b"The", b"hello", "Éclair".encode(), "straße".encode(), b"xqzjkvw", "ÀÖØöøÿ".encode(), b"internationalisation"]
        if keeps_space:
            probes += [b" " + p for p in probes]
        self.direct = [self._merged(p) for p in probes] == self._through_all(probes)

    @classmethod
    def of(cls, path: str, keeps_space: bool) -> "WordEncoder":
        key = (path, keeps_space)
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(path, keeps_space)
        return _ENCODERS[key]

    def _merged(self, piece: bytes) -> bytes:
        if not self.keeps_space:
            piece = piece.decode().lower().encode()
        return array("I", [t.id for t in self.model.tokenize(codecs.charmap_decode(piece, "strict", _BYTE_CHARACTERS)[0])]).tobytes()

    def _library(self, pieces: list[bytes]) -> list[bytes]:
        if not self.direct:
            return self._through_all(pieces)
        plain = [bool(_PLAIN_WORD.fullmatch(p)) for p in pieces]
        others = iter(self._through_all([p for p, own in zip(pieces, plain) if not own]))
        return [self._merged(p) if own else next(others) for p, own in zip(pieces, plain)]

    def _through_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids by way of every step of the tokenizer."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = array("I", itertools.chain.from_iterable(ids)).tobytes()
        return [flat[4 * a : 4 * b] for a, b in itertools.pairwise(itertools.accumulate(map(len, ids), initial=0))]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            out += self._encode_some(texts[at : at + 256])
        return out

    def _whole(self, text: bytes) -> bool:
        folded = text if self.keeps_space else text.lower()
        return any(x in folded for x in self.added) or has_odd_space(text)

    def _cut(self, text: bytes) -> list[bytes]:
        return _SPACED_WORD.findall(text) if self.keeps_space else text.lower().split()  # its tokens have no capitals

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the memo lacks; short ones go into the memo, of those with marks only such as end with a stop or comma.

        ASCII marks at the end of a word, after a letter or digit, are tokens of their own (an apostrophe may not be).
        """
        memo, parts, new, learned = self.memo, [], set(), {}
        for w in words:
            stem = w.rstrip(_MARKS)
            if len(stem) < len(w) and (stem[-1:].isalnum() or stem[-2:-1] == b"\xc3" and stem[-1:] not in _NO_LETTERS):
                marks = w[len(stem) :]
                parts.append((w, stem, marks))
                if stem not in memo:
                    new.add(stem)
                if marks not in memo:
                    new.add(marks)
            else:
                new.add(w)
        listed = list(new)
        for at in range(0, len(listed), 20_000):
            some = listed[at : at + 20_000]
            learned.update(zip(some, self._library(some)))
        memo.update(learned)
        for w, stem, marks in parts:
            learned[w] = ids = memo[stem] + memo[marks]
            if marks == b"." or marks == b",":
                memo[w] = ids
        for w in learned:
            if len(w) > MEMO_BYTES:
                memo.pop(w, None)
        return learned

    def _forget(self) -> None:
        if not self.core:
            self.core = dict(itertools.islice(self.memo.items(), CORE_WORDS))
        self.memo = dict(self.core)

    def _encode_some(self, texts: list[bytes]) -> list[bytes]:
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        known, new = self.memo.get, set()
        words = [None if self._whole(t) else self._cut(t) for t in texts]
        ids = [w and list(map(known, w)) for w in words]
        for w, found in zip(words, ids):
            if w and None in found:
                new.update(x for x, y in zip(w, found) if y is None)
        learned = self._learn(new) if new else {}
        out = []
        for text, w, found in zip(texts, words, ids):
            if w is None:
                out.append(self._library([text])[0])
            elif new and None in found:
                out.append(b"".join([learned[x] if y is None else y for x, y in zip(w, found)]))
            else:
                out.append(b"".join(found))
        return out


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    path: str | None = None,
    *,
    end_id: int | None = None,
    keeps_space: bool = False,
    unsigned_bits: int = 16,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode ``docs`` into shards under ``path``; return the manifest.

    Manifest: shard, file, n_docs, n_tokens, unsigned_bits, token_base and
    doc_base (tokens and documents of all shards before it).
    """
    path = path or fresh_path(docs.sparkSession, "tokens")
    dtype = {16: "<u2", 32: "<u4"}[unsigned_bits]
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer_path, keeps_space)
        fs, root = _filesystem(path)
        n, name = TaskContext.get().partitionId(), f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        ids, valid, lengths, sink = [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}.bin")
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids += part.column(0).fill_null(0).to_pylist()
                valid += part.column(0).is_valid().to_pylist()
                for one in encoder.encode(utf8(part.column(1))):
                    one += end
                    lengths.append(len(one) // 4)
                    tokens = np.frombuffer(one, dtype="<u4")
                    if unsigned_bits == 16 and len(tokens) and int(tokens.max()) > 0xFFFF:
                        raise ValueError("a token id needs more than 16 bits; pass unsigned_bits=32")
                    sink.write(tokens.astype(dtype).tobytes())
        if sink is None:
            return
        sink.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(np.array([len(ids)], dtype="<u8").tobytes())
            f.write(np.array(ids, dtype="<i8").tobytes() + np.array(valid, dtype="u1").tobytes() + offsets.tobytes())
        yield pa.RecordBatch.from_pydict(
            {"shard": [n], "file": [name], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])], "unsigned_bits": [unsigned_bits]},
            schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("unsigned_bits", pa.int32())]),
        )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    written = materialize(ordered.mapInArrow(tidy(shard), "shard long, file string, n_docs long, n_tokens long, unsigned_bits int"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return written.select(
        "*",
        F.lit(path).alias("path"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"),
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"),
    )


class Shard:
    """One shard: document ids, their validity, offsets, and ids by ranges; memory-mapped if the store is local."""

    def __init__(self, path: str, file: str, unsigned_bits: int):
        self.dtype = np.dtype({16: "<u2", 32: "<u4"}[unsigned_bits])
        fs, root = _filesystem(path)
        if fs.type_name == "local":
            index = np.memmap(f"{root}/{file}.idx", dtype="u1", mode="r")
            empty = os.path.getsize(f"{root}/{file}.bin") == 0
            self.mapped = np.zeros(0, self.dtype) if empty else np.memmap(f"{root}/{file}.bin", dtype=self.dtype, mode="r")
        else:
            with fs.open_input_file(f"{root}/{file}.idx") as f:
                index = np.frombuffer(f.read(), dtype="u1")
            self.mapped, self.remote = None, fs.open_input_file(f"{root}/{file}.bin")
        n = int(index[:8].view("<u8")[0])
        self.ids = np.frombuffer(index[8 : 8 + 8 * n].tobytes(), dtype="<i8")
        self.valid = np.asarray(index[8 + 8 * n : 8 + 9 * n])
        self.offsets = np.frombuffer(index[8 + 9 * n :].tobytes(), dtype="<u8").astype("i8")

    def tokens(self, first: int, last: int) -> np.ndarray:
        """The ids from offset first up to last."""
        if self.mapped is not None:
            return np.asarray(self.mapped[first:last])
        return np.frombuffer(self.remote.read_at((last - first) * self.dtype.itemsize, first * self.dtype.itemsize), dtype=self.dtype)

    def parts(self):
        """Ranges of documents, each of 1024 documents and about READ_BYTES at most, one document at least."""
        at, n, most = 0, len(self.ids), READ_BYTES // self.dtype.itemsize
        while at < n:
            end = int(np.searchsorted(self.offsets, self.offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), at + 1024, n)
            yield at, end
            at = end


def read_token_files(manifest: DataFrame, *, with_tokens: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it in the whole corpus.
    With ``with_tokens`` the ids themselves follow as ``tokens array<int>``.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", tokens array<int>" * with_tokens)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"], row["file"], row["unsigned_bits"])
                for at, end in shard.parts():
                    offsets = shard.offsets[at : end + 1]
                    here = shard.tokens(int(offsets[0]), int(offsets[-1]))
                    cut = [here[a:b] for a, b in itertools.pairwise((offsets - offsets[0]).tolist())]
                    out = {
                        "doc_id": pa.array(shard.ids[at:end], pa.int64(), mask=shard.valid[at:end] == 0),
                        "start": pa.array(offsets[:-1] + row["token_base"], pa.int64()),
                        "n_tokens": pa.array([len(x) for x in cut], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()),
                    }
                    if with_tokens:
                        out["tokens"] = pa.array([x.astype("i4") for x in cut], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)

    spread = manifest.select("path", "file", "unsigned_bits", "token_base").repartition(max(1, manifest.count()))
    return spread.mapInArrow(tidy(read), schema)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Query op2: documents into token files and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, tokenizer_path or public_path("word_bpe_49k.json"), end_id=2))
