"""SentencePiece BPE encoding by a prefix table, and decoding.

In byte-pair encoding every prefix of a text has one encoding, so one last token; the encoding of the text is its
last token after the encoding of what stands before that token. Tokens follow one another in a valid encoding
exactly if each neighbouring pair does. So, for each end position, the tokens that an Aho-Corasick automaton matches
there are tried: the one that is compatible with the last token of the prefix before it is the last token of this
prefix. The ids are recovered backwards from the end of the text.

No piece has a word mark after another character, so the text is cut before each run of word marks; what a cut
encodes to is remembered within bounds, for words recur.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

MARK = "▁"
#: Remembered words of a worker, and compatible pairs.
MEMO = 400_000
#: Longer cuts are not remembered.
MEMO_CHARS = 64


class PrefixTable:
    """A BPE model as (piece, score) lists; ids are positions. Built from the model file's vocabulary."""

    def __init__(self, model: bytes):
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = vocabulary.vocab_size()
        self.pieces = [vocabulary.id_to_piece(i) for i in range(n)]
        self.bytes_of = {}
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if vocabulary.is_byte(i):
                self.bytes_of[i] = int(piece[3:5], 16)
            elif not (vocabulary.is_control(i) or vocabulary.is_unknown(i)):
                self.ids[piece] = i
        self.score = {i: vocabulary.get_score(i) for i in self.ids.values()}
        self.byte_id = {v: k for k, v in self.bytes_of.items()}
        self.begin, self.end, self.unknown = vocabulary.bos_id(), vocabulary.eos_id(), vocabulary.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with a word mark inside a word are not supported")
        self.automaton = ahocorasick.Automaton()
        self.alone: set[int] = {i for p, i in self.ids.items() if self.merged(p) == [i]}
        for p, i in self.ids.items():
            if i in self.alone:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.spelled = [bytes([self.bytes_of[i]]) if i in self.bytes_of else b"" if vocabulary.is_control(i) else " \u2047 ".encode() if i == self.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[int]:
        """Ids by merging the best pair first, leftmost among equals. For short strings: pieces and pairs of pieces."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if best is None:
                return [self.ids.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether b follows a in the encoding of their concatenation. A character outside the vocabulary (-1) merges with nothing."""
        if a < 0 or b < 0:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return known

    def last_tokens(self, text: str) -> tuple[list[int], list[int]]:
        """For each prefix: its last token (-1: a character outside the vocabulary) and that token's length."""
        n = len(text)
        last, length = [-1] * n, [1] * n
        known, compatible = self.pairs.get, self.compatible
        # matches come by end position, so what stands before each of them is settled
        for end, (size, i) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            before = end - size
            if before >= 0 and (a := last[before]) >= 0:
                fits = known((a, i))
                if not (compatible(a, i) if fits is None else fits):
                    continue
            last[end], length[end] = i, size
        return last, length

    def encode_cut(self, text: str) -> bytes:
        """The ids of a cut as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        last, length = self.last_tokens(text)
        out: list[int] = []
        at = len(text) - 1
        while at >= 0:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out.extend(self.byte_id[b] for b in reversed(text[at].encode("utf-8", "replace"))) if self.byte_id else out.append(self.unknown)
            at -= length[at]
        return np.array(out[::-1], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, with begin and end ids."""
        words, out = self.words, [np.array([self.begin], dtype="<u4").tobytes()]
        if text:
            for cut in cuts(MARK + text.replace(" ", MARK)):
                ids = words.get(cut)
                if ids is None:
                    ids = self.encode_cut(cut)
                    if len(cut) <= MEMO_CHARS:
                        if len(words) >= MEMO:
                            words.clear()
                        words[cut] = ids
                out.append(ids)
        out.append(np.array([self.end], dtype="<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids vanish, runs of byte ids are UTF-8, the first word mark is dropped."""
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def cuts(text: str) -> list[str]:
    """The text cut before each run of word marks."""
    return _CUT.findall(text)


@cache
def table(path: str) -> PrefixTable:
    """One for each Python worker and model."""
    with open(path, "rb") as f:
        return PrefixTable(f.read())


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def encode_documents(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids (little-endian unsigned 32-bit integers).

    ``model`` is the path of a SentencePiece BPE model, sent to the executors with the job. Null text counts as empty
    and encodes to the begin and end ids. Rows with equal or null doc_id each give their own row.
    """
    spark = docs.sparkSession
    ship(spark)
    spark.sparkContext.addFile(model)
    name = model.rsplit("/", 1)[-1]

    def run(batches):
        t = table(SparkFiles.get(name))
        for batch in batches:
            ids = [t.encode(x) for x in batch.column(1).to_pylist()]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            decoded = [sha(t.decode(x).encode("utf-8", "surrogatepass")) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids], pa.string()), pa.array(decoded, pa.string()), pa.array(ids if keep_ids else [None] * len(ids), pa.binary())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, ENCODED)


def op8_pieces(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of documents."""
    import public_tokenizers

    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
    return out.drop("ids")
