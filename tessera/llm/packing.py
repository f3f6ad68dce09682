"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of 4096 and then into the powers of two of the remainder's binary form,
largest first. Each piece is a sequence of its own and needs no padding; a training batch draws from one bucket of
equal lengths, so no sequence crosses documents.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import words as W

END_ID = 2
#: Words whose ids a worker holds.
TOKEN_WORDS = 500_000
PIECES = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("bucket", T.IntegerType())])


class Subwords:
    """Token ids of words, by a tokenizer whose pieces never span white space and each end in a token with the end-of-word mark."""

    def __init__(self, path: str, cut: bool = False):
        self.cut = cut
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # the tokenizer file's own split pattern
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.spaced = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ").findall

    def one(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)

    def _bare(self, texts: list[str], ascii: bool) -> list:
        """Encodes texts whose pieces stand alone between spaces and are normal already, without the tokenizer's normalizer and split; its bytes as letters are only needed beyond ASCII."""
        from tokenizers import normalizers, pre_tokenizers

        t = self.tokenizer
        own = t.normalizer, t.pre_tokenizer
        split = pre_tokenizers.WhitespaceSplit()
        t.normalizer = normalizers.Sequence([])
        t.pre_tokenizer = split if ascii else pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        try:
            return t.encode_batch_fast(texts, add_special_tokens=False)
        finally:
            t.normalizer, t.pre_tokenizer = own

    def encode(self, words: list[bytes], run: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """All the words' ids in a row, and how many each word has. Words are encoded as joined runs, cut again after the closing token of each word's last piece; where the count of closing tokens does not fit, word by word. With `cut`, words of printable ASCII, and of letters of Latin, Greek or Cyrillic script in normal form, are cut into pieces here, which takes less time and more memory."""
        import unicodedata

        texts = [w.decode("utf-8", "replace") for w in words]
        kinds: tuple[list[int], ...] = ([], [], [] if self.cut else list(range(len(texts))))
        for k, x in enumerate(texts if self.cut else ()):
            if x.isascii():
                kinds[0 if x.isprintable() and "<|" not in x else 2].append(k)
            else:
                kinds[1 if x.isalpha() and x.islower() and max(x) < "\u0530" and unicodedata.is_normalized("NFC", x) and x.lower() == x else 2].append(k)
        counts, found = np.zeros(len(words), np.int64), []
        for kind, own in enumerate(kinds):
            runs = [[texts[k] for k in own[a : a + run]] for a in range(0, len(own), run)]
            if kind == 0:
                parts = [self.spaced(" ".join(p).lower()) for p in runs]
                ends_of = [np.append(np.flatnonzero(np.array(p, object) == " "), len(p)) for p in parts]
                pieces_of = [e - np.arange(len(e)) for e in ends_of]
                encoded = self._bare([" ".join(p) for p in parts], True)
            elif kind == 1:
                pieces_of = [np.arange(1, len(p) + 1) for p in runs]
                encoded = self._bare([" ".join(p) for p in runs], False)
            else:
                pieces_of = [np.cumsum([len(self.pieces(unicodedata.normalize("NFC", x).lower())) for x in p]) for p in runs]
                encoded = self.tokenizer.encode_batch_fast([" ".join(p) for p in runs], add_special_tokens=False)
            ids, sizes = [], []
            for part, e, pieces in zip(runs, encoded, pieces_of, strict=True):
                got = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.closes[got])
                if len(ends) == pieces[-1] and (not len(got) or (len(ends) and ends[-1] == len(got) - 1)):
                    bounds = np.concatenate(([0], np.concatenate(([-1], ends))[pieces] + 1))
                    ids.append(got)
                    sizes.append(np.diff(bounds))
                else:
                    each = [self.one(x) for x in part]
                    ids += each
                    sizes.append(np.array([len(x) for x in each]))
            if own:
                counts[own] = np.concatenate(sizes)
                found.append((own, np.concatenate(ids)))
        if len(found) == 1:
            return found[0][1], counts
        out, first = np.zeros(int(counts.sum()), np.uint32), np.cumsum(counts) - counts
        for own, ids in found:
            n = counts[own]
            out[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts


class TokenWords(W.WordTable):
    """A word table whose first two columns say where a word's ids start in its owner's list, and how many they are."""

    owner: TokenTable

    def forget(self) -> np.ndarray:
        keep = super().forget()
        first, counts = self.columns[:2]
        ends = np.concatenate(([0], np.cumsum(counts)))
        at = np.repeat(first - ends[:-1], counts) + np.arange(ends[-1])
        self.owner.ids, self.owner.used = self.owner.ids[at], int(ends[-1])
        self.columns = (ends[:-1], *self.columns[1:])
        return keep


def spelled(blob: bytes) -> bytes:
    """The text with A-Z in lower case, as the tokenizer reads it; one that may hold a special token's string, which counts as that token in this spelling only, stays as it is."""
    return blob if b"<|" in blob else blob.lower()


class TokenTable:
    """Words' token ids, kept by each worker; more(words) adds columns to the table."""

    def __init__(self, path: str, more: Callable[[list[bytes]], tuple[np.ndarray, ...]] = lambda new: (), cut: bool = False):
        self.subwords, self.more = Subwords(path, cut), more
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.table = TokenWords(self._fill, TOKEN_WORDS)
        self.table.owner = self

    @classmethod
    def of(cls, path: str) -> "TokenTable":
        return W.held(path, lambda: cls(path))

    def _fill(self, new: list[bytes]) -> tuple[np.ndarray, ...]:
        ids, counts = self.subwords.encode(new)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(len(ids), len(self.ids)), np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        return (first, counts, *self.more(new))

    def tokens(self, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in `rows`, and where each text's ids start."""
        first, counts = self.table.columns[:2]
        n = counts[rows]
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = np.repeat(first[rows] - ends[:-1], n)
        flat += np.arange(ends[-1])
        return self.ids[flat], ends[starts]


def cut(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole ones of `longest` (a power of two), then falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(documents: DataFrame, tokenizer_path: str, longest: int = 4096, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length) and, if asked for, its ids.

    Every document ends in end_id, so a null or empty text has one token. Each row is packed by itself, repeated rows
    too; a null doc_id stays null. sequence_id is unique: the input partition's number and a count within it. An empty
    table gives no rows; other columns are ignored.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest piece must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenTable.of(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        for batch, blobs in W.chunks(batches, "text"):
            rows, starts = W.split(table.table, [spelled(b) for b in blobs])
            ids, at = table.tokens(rows, starts)
            end = np.array([end_id], np.uint32)
            out: list[list] = [[] for _ in range(8)]
            doc, start, length, crc, total, seq, bucket, kept = out
            for d, doc_id in enumerate(batch.column(batch.schema.get_field_index("doc_id")).to_pylist()):
                own = np.concatenate((ids[at[d] : at[d + 1]], end)).astype("<u4", copy=False)
                a = 0
                for k in cut(len(own), longest):
                    doc.append(doc_id)
                    start.append(a)
                    length.append(k)
                    crc.append(zlib.crc32(own[a : a + k].data))
                    total.append(len(own))
                    seq.append(sequence)
                    bucket.append(k.bit_length() - 1)
                    if keep_ids:
                        kept.append(own[a : a + k].astype(np.int32))
                    sequence += 1
                    a += k
            columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total, seq)] + [pa.array(np.zeros(len(doc), np.int64)), pa.array(bucket, pa.int32())]
            names = list(PIECES.names)
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*PIECES.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if keep_ids else PIECES
    return documents.select("doc_id", "text").mapInArrow(run, schema)
