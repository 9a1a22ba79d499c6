"""BPE encoding and decoding of whole texts, with tree concatenation of long ones.

A text of more than LONG_CHARS characters is dealt out as pieces of fixed size, wherever that cuts it. Pieces are the leaves of a tree: each
is encoded by itself, in whatever task it lands in. Then neighbours are joined in pairs: a window of text around the join is split and encoded
anew and grown until its splits agree with those of both sides at either end, and what lies outside the window stays as it is. A run that the
splitting pattern leaves whole across the join is joined token by token in the same way: its window grows until its outer tokens are those of
both halves and fit the tokens next to them. (A token sequence is the encoding of its text exactly if each two neighbours are the encoding of
theirs.) Either way the result is exactly that of the whole text.

Shorter texts are split many at a time by array operations, and splits are looked up by their bytes (see splits.py); new ones, and stretches
with rare characters, are encoded by the tokenizers library.

Defined results: a null text is an empty one and has no tokens; an empty table gives an empty result; repeated rows and null ids are encoded
alike and kept as rows of their own; columns other than the two named are ignored. Special tokens that a text spells out are found as the
library finds them, across joins as well.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import splits as byte_splits
from .shared import KEPT, apply_groups, map_batches, shared_dir, slices, spread, table

#: A text of more characters is encoded as a tree of pieces of PIECE_CHARS characters, each a row of its own. The result is the same either way.
LONG_CHARS, PIECE_CHARS = 1 << 15, 1 << 13
#: Splits whose ids a worker remembers, by their bytes and by their text, and characters that such a text has at most. Others are encoded each time.
TABLE_SPLITS, MEMO_SPLITS, MEMO_CHARS = 300_000, 100_000, 64
#: Characters of a whole run of letters, digits, signs or space that is encoded without a tree.
LEAF_CHARS = 1 << 10
#: Texts that go to the library in one call.
BATCH_TEXTS = 64
#: Characters on either side of a join that its first window takes.
WINDOW_CHARS = 256

def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Part:
    """A stretch of text with its encoding: the splits' ends in characters, how many tokens each split has, and all tokens."""

    text: str
    ends: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


class Coder:
    """Encodes and decodes as the tokenizers library does with the same file, add_special_tokens=False, no truncation and no padding."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        split = config["pre_tokenizer"] or {}
        if config["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            raise ValueError("only byte-level BPE with its usual splitting pattern is supported")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.leaf_chars, self.window_chars = leaf_chars, window_chars
        self.table = byte_splits.Table(TABLE_SPLITS)
        self._splits: dict[str, list[int]] = {}
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self._special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.may_cut = not any(" " in content for content in self.special)
        self._marks = [content.encode() for content in self.special]
        self._margin = max(8, *(len(content) for content in self.special)) if self.special else 8
        letter = self._letter = self._byte_letters()
        back = {c: b for b, c in letter.items()}
        self.bytes_of = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = token.encode() if i in added else bytes(back[c] for c in token)

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The printable character that byte-level vocabularies write for each byte: itself if it is a visible Latin-1 character, else the next
        from U+0100.
        """
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}

    def _whole(self, run: str) -> list[int]:
        return [t.id for t in self.model.tokenize(run)]

    @staticmethod
    def _fit(model, a: str, b: str) -> bool:
        return [t.value for t in model.tokenize(a + b)] == [a, b]

    def tree(self, run: str) -> list[int]:
        """The encoding of one run that the pattern leaves whole, written in the vocabulary's characters."""
        if len(run) <= self.leaf_chars:
            return self._whole(run)
        middle = len(run) // 2
        return self._join(self.tree(run[:middle]), self.tree(run[middle:]))

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        name, width = self.tokenizer.id_to_token, 4
        while True:
            keep, skip = max(0, len(left) - width), min(len(right), width)
            inner = self._whole("".join(map(name, left[keep:] + right[:skip])))
            left_fits = keep == 0 or (inner[0] == left[keep] and self._fit(self.model, name(left[keep - 1]), name(inner[0])))
            right_fits = skip == len(right) or (inner[-1] == right[skip - 1] and self._fit(self.model, name(inner[-1]), name(right[skip])))
            if left_fits and right_fits:
                return left[:keep] + inner + right[skip:]
            width *= 2

    def splits(self, text: str) -> list[tuple[int, str | int]]:
        """(end, what) of each split of a text: what is a special token's id, or the split in the vocabulary's characters."""
        out: list[tuple[int, str | int]] = []
        at = 0
        for part in self._special_pattern.split(text) if self._special_pattern else [text]:
            if part in self.special:
                out.append((at + len(part), self.special[part]))
            elif part:
                out += [(at + end, run) for run, (_, end) in self.split.pre_tokenize_str(part)]
            at += len(part)
        return out

    def _tokens(self, text: str, begin: int, end: int, what: str | int) -> list[int]:
        """The tokens of one split, from the memo of splits or, if it is long, as a tree."""
        if isinstance(what, int):
            return [what]
        if end - begin > MEMO_CHARS:
            return self.tree(what)
        part = text[begin:end]
        ids = self._splits.get(part)
        if ids is None:
            ids = self._whole(what)
            if len(self._splits) < MEMO_SPLITS:
                self._splits[part] = ids
        return ids

    def leaf(self, text: str) -> Part:
        """A stretch of text, encoded as if it were a whole text."""
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) and self.may_cut:
            starts, whole = byte_splits.boundaries(data, np.array([0, len(data)]), self._marks)
            if not len(whole):  # all splits are known as such
                flat, where = byte_splits.encode(data, starts, whole, self.table, self._split, self._stretches)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                return Part(text, chars[np.append(starts[1:], len(data))], np.diff(where), flat)
        splits = self.splits(text)
        begins = [0, *(end for end, _ in splits)]
        tokens = [self._tokens(text, begin, end, what) for begin, (end, what) in zip(begins, splits)]
        return Part(
            text, np.array(begins[1:], np.int64), np.array([len(t) for t in tokens], np.int64), np.array([i for t in tokens for i in t], np.uint32)
        )

    def join(self, a: Part, b: Part) -> Part:
        """The encoding of two stretches as one. Only a window around the join is split and encoded anew."""
        joint, margin, width = len(a.text), self._margin, self.window_chars
        if not a.text or not b.text:
            return a if a.text else b
        while True:
            # the window begins at a split of a, and ends at one of b; how a run of space splits depends on what comes after it
            k = int(np.searchsorted(a.ends, joint - max(width, margin), "right"))
            while k and a.text[a.ends[k - 1] - 1].isspace():
                k -= 1
            begin = int(a.ends[k - 1]) if k else 0
            m = min(int(np.searchsorted(b.ends, max(width, margin))), len(b.ends) - 1)
            end = int(b.ends[m])
            text = a.text[begin:] + b.text[:end]
            splits = self.splits(text)
            ends = np.array([e for e, _ in splits], np.int64) + (begin - joint)
            if end == len(b.text):
                agree = len(splits) - 1
                break
            # a split that ends where one of b does, clear of the join and of the window's end: from there on b is as it was
            common = np.flatnonzero(np.isin(ends, b.ends[: m + 1]) & (ends >= margin) & (ends + margin <= end))
            agree = next((x for x in common.tolist() if not b.text[ends[x] - 1].isspace()), -1)
            if agree >= 0:
                break
            width *= 4
        again = [self._anew(a, b, text, begin, x, e, what) for x, (e, what) in zip([0, *(e for e, _ in splits)], splits[: agree + 1])]
        rest = int(np.searchsorted(b.ends, ends[agree], "right"))
        ids = [a.ids[: int(a.counts[:k].sum())], np.array([i for t in again for i in t], np.uint32), b.ids[int(b.counts[:rest].sum()) :]]
        return Part(
            a.text + b.text, np.concatenate([a.ends[:k], ends[: agree + 1] + joint, b.ends[rest:] + joint]),
            np.concatenate([a.counts[:k], np.array([len(t) for t in again], np.int64), b.counts[rest:]]), np.concatenate(ids),
        )

    def _anew(self, a: Part, b: Part, text: str, offset: int, begin: int, end: int, what: str | int) -> list[int]:
        """The tokens of a split of the window. A long run that crosses the join and is a split of either side up to it is joined token by token."""
        joint = len(a.text)
        if isinstance(what, str) and end - begin > self.leaf_chars and offset + begin < joint < offset + end:
            last, right = offset + begin, offset + end - joint
            starts = len(a.ends) == 1 and last == 0 or len(a.ends) > 1 and a.ends[-2] == last
            if starts and a.ends[-1] == joint and b.ends[0] == right:
                mine = a.ids[len(a.ids) - int(a.counts[-1]) :].tolist()
                return self._join(mine, b.ids[: int(b.counts[0])].tolist())
        return self._tokens(text, begin, end, what)

    def concatenate(self, parts: list[Part]) -> Part:
        """Joins neighbours in pairs, and the results again, until one is left."""
        while len(parts) > 1:
            pairs = [self.join(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[2 * len(pairs) :]
        return parts[0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        encoded = [t.encode() for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)]))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of texts that lie end to end, in UTF-8, as unsigned 32-bit integers."""
        if not self.may_cut:
            return [np.array(x, np.uint32) for x in self._stretches([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])])]
        if not len(data):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        starts, whole = byte_splits.boundaries(data, offsets, self._marks)
        flat, where = byte_splits.encode(data, starts, whole, self.table, self._split, self._stretches)
        return np.split(flat, where[np.searchsorted(starts, offsets[1:-1])]) if len(offsets) > 1 else []

    def _split(self, part: bytes) -> list[int]:
        """The ids of one split."""
        run = "".join(map(self._letter.__getitem__, part))
        return self._whole(run) if len(run) <= MEMO_CHARS else self.tree(run)

    def _stretches(self, parts: list[bytes]) -> list[list[int]]:
        texts, out = [p.decode() for p in parts], []
        for k in range(0, len(texts), BATCH_TEXTS):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + BATCH_TEXTS], add_special_tokens=False)]
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode with skip_special_tokens=False; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One per worker process and vocabulary file, kept as long as the worker does this kind of work; the file is read on the worker and so must be at
    this path on every machine.
    """
    return Coder(path)


KEPT["bpe"] = coder.cache_clear


def _pieces(docs: DataFrame, folder: str, piece_chars: int) -> DataFrame:
    """(n, id, piece, text): the long texts (id, text) as rows of pieces, written in the shared folder, where n numbers their rows once and for
    all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py()
                pieces = [text[x : x + piece_chars] for x in range(0, len(text), piece_chars)]
                same = batch.slice(row, 1).select([0, 1]).take(pa.array([0] * len(pieces)))
                yield pa.record_batch(
                    [*same.columns, pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())], ["n", "id", "piece", "text"]
                )

    numbered = docs.select(F.monotonically_increasing_id().alias("n"), "id", "text")
    kind = docs.schema["id"].dataType.simpleString()
    map_batches(numbered, run, f"n bigint, id {kind}, piece int, text string").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def encode_columns(
    docs: DataFrame, id_col: str, text_col: str, path: str, columns: Callable[[list[np.ndarray]], list[pa.Array]], schema: str,
    long_chars: int = LONG_CHARS, piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """(id, and what ``columns`` makes of the token ids of some texts) of every whole text: short ones where they are, long ones as trees."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(x.split()[0] for x in schema.split(", "))]
    rows = spread(docs).select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    is_long = F.char_length("text") > long_chars

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(i, j - i), *columns(coder(path).encode_bytes(data, offsets))], names)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [coder(path).leaf(t) for t in batch.column(3).to_pylist()]
            arrays = [pa.array([getattr(p, f).tobytes() for p in parts], pa.binary()) for f in ("ends", "counts", "ids")]
            yield pa.record_batch([*batch.columns, *arrays], [*batch.schema.names, "ends", "counts", "ids"])

    def whole(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("piece")
        parts = [
            Part(r["text"], np.frombuffer(r["ends"], np.int64), np.frombuffer(r["counts"], np.int64), np.frombuffer(r["ids"], np.uint32))
            for r in pieces.select(["text", "ends", "counts", "ids"]).to_pylist()
        ]
        return pa.table([pieces.column("id").slice(0, 1), *columns([coder(path).concatenate(parts).ids])], names=names)

    out = map_batches(rows.where(~is_long), short, f"id {kind}, {schema}", keeps="bpe")
    pieces = _pieces(rows.where(is_long), shared_dir(docs.sparkSession), piece_chars).repartition("n", "piece")
    schema_of_leaves = f"n bigint, id {kind}, piece int, text string, ends binary, counts binary, ids binary"
    encoded = map_batches(pieces, leaves, schema_of_leaves, keeps="bpe")
    return out.unionByName(apply_groups(encoded, "n", whole, f"id {kind}, {schema}", keeps="bpe"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **sizes: int) -> DataFrame:
    """(id, ids array<bigint>) of each whole text."""

    def columns(ids: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))]

    return encode_columns(docs, id_col, text_col, path or vocabulary_path(), columns, "ids array<bigint>", **sizes)


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) from token ids; null ids give an empty text."""
    path = path or vocabulary_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [coder(path).decode(np.array(ids or [], np.uint32)) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return map_batches(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text string")


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False, **sizes: int
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids): encodes each whole text, decodes the ids again, and keeps the
    digests of both.
    """
    path = path or vocabulary_path()

    def columns(ids: list[np.ndarray]) -> list[pa.Array]:
        digests = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
        decoded = [hashlib.sha256(coder(path).decode(x).encode()).hexdigest() for x in ids]
        kept = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] if keep_ids else []
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), *kept]

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return encode_columns(docs, id_col, text_col, path, columns, schema, **sizes)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_bpe": op5_bpe}
