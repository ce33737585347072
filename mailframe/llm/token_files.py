"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

A folder holds, for each shard k, three flat little-endian files and, for all shards, one manifest:

* ``shard-k.tok``: token ids one after the other, 2 bytes each if every id fits, else 4;
* ``shard-k.off``: a 64-bit offset for each document and one for the end, counted in ids from the shard's start;
* ``shard-k.doc``: the 64-bit document ids (0 where null; nulls come first and the manifest counts them);
* ``manifest.json``: width, end id and, for each shard, documents, null ids, tokens and its base.

A shard's base is the sum of the tokens of all shards before it, so that base + offset is a place in the
whole output. Shards follow each other in ascending document id. A reader maps the files into memory.

Documents that share an id are ordered by their text's hash, then text; rows that are the same are
interchangeable. A null or empty text is the end id alone. An empty table gives a manifest without shards.
Other columns of the input are not read.

Lost executors: a task writes under a name of its own and moves its files into place when it ends; a
repeated task has the same rows and so writes the same files.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces of text whose ids are remembered, at most, and their greatest length.
REMEMBERED, LONGEST = 1 << 20, 48

# The normalizer and pre-tokenizer that pieces are known for, and its pieces within Latin-1 in lower case.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Encoder:
    """Ids of whole texts as bytes, equal to those that the tokenizer gives the whole text.

    White space is dropped and no piece crosses it, and no character composes with a space, so a text's ids are
    those of its chunks between spaces. Within Latin-1, which NFC leaves as it is and which lower-cases character by
    character, chunks are cut into the pre-tokenizer's pieces here: a piece's ids depend on the piece alone and end
    in a token of a word's end, so that all pieces not seen before are encoded in one call. Chunks of other characters,
    or that may hold a special token, go to the tokenizer as they are. Where the file has another normalizer or
    pre-tokenizer, or a model without word ends, so do whole texts.
    """

    def __init__(self, path: str, width: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        self.known: dict[str, bytes] = {}
        self.pieces = re.compile(LATIN).findall
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        split = (own["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        self.by_piece = (
            own["normalizer"] == NORMALIZER and len(split) == 2
            and (split[0].get("pattern"), split[0].get("behavior"), split[0].get("invert")) == ({"Regex": PIECES}, "Removed", True)
            and (split[1].get("type"), split[1].get("use_regex"), split[1].get("add_prefix_space")) == ("ByteLevel", False, False)
            and own["model"]["type"] == "BPE" and own["model"].get("end_of_word_suffix") == "</w>" and not own["model"].get("dropout")
            and all(x["special"] and x["content"].startswith("<|") for x in own["added_tokens"])
        )
        if self.by_piece:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if (ids := self.known.get(chunk)) is None:
            ids = self._ids(chunk)
            if len(chunk) <= LONGEST:
                self.known[chunk] = ids
        return ids

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces, by one call."""
        ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces) or (len(ends) and ends[-1] != len(ids)):
            return {x: self._ids(x) for x in pieces}
        raw, w = ids.astype(self.kind).tobytes(), self.kind.itemsize
        ends = (ends * w).tolist()
        return {x: raw[a:b] for x, a, b in zip(pieces, [0, *ends[:-1]], ends, strict=True)}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_piece:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        cut = [self._cut(x) if x else b"" for x in texts]
        new = {x for own in cut if own.__class__ is list for x in own if x not in self.known}
        learnt = self._learn(sorted(new)) if new else {}
        self.known.update(learnt)
        out = [b"".join(map(self.known.__getitem__, own)) if own.__class__ is list else own for own in cut]
        for x in learnt:
            if len(x) > LONGEST:
                del self.known[x]
        return out

    def _cut(self, text: str) -> list[str] | bytes:
        """The pieces of a text, or its ids if it isn't all Latin-1."""
        if "<|" not in text:
            with contextlib.suppress(UnicodeEncodeError):
                text.encode("latin-1")
                return self.pieces(text.lower())
        out = []
        for chunk in text.replace("\n", " ").split(" "):
            if not chunk.isascii() or "<|" in chunk:
                out.append(self._chunk(chunk))
            else:
                out += map(self._chunk, self.pieces(chunk.lower()))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(1)
def encoder(path: str, width: int) -> Encoder:
    """The worker process's encoder: later tasks find the pieces of earlier ones."""
    return Encoder(path, width)


def id_width(tokenizer_path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    return 2 if max(t.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4


def write_token_files(df: DataFrame, out: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Writes df's documents to the folder ``out`` (a path or URI that all executors share); returns the manifest.

    The driver gets one row a shard. Which shard a document goes to is settled by ranges of
    (id, hash of the text, place in the input), so that an id of very many rows is spread as well.
    """
    width = id_width(tokenizer_path, end_id)
    fs, root = _fs(out)
    fs.create_dir(root, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = _fs(out)
        encode, end = encoder(tokenizer_path, width).encode_all, np.array([end_id], f"<u{width}").tobytes()
        name, temporary = f"{root}/shard-{k:06d}", f"{root}/.{own}-{k:06d}"
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        nulls = 0
        with fs.open_output_stream(f"{temporary}.tok") as tok:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    got = encode(part.column(1).to_pylist())
                    tok.write(b"".join(x + end for x in got))
                    sizes.append(np.array([len(x) // width + 1 for x in got], "<u8"))
                    nulls += part.column(0).null_count
                    ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        n = np.concatenate(sizes) if sizes else np.zeros(0, "<u8")
        for suffix, data in (("off", np.concatenate([np.zeros(1, "<u8"), np.cumsum(n, dtype="<u8")])), ("doc", np.concatenate(ids) if ids else np.zeros(0, "<i8"))):
            with fs.open_output_stream(f"{temporary}.{suffix}") as f:
                f.write(data.tobytes())
        for suffix in ("tok", "off", "doc"):
            fs.move(f"{temporary}.{suffix}", f"{name}.{suffix}")
        yield pa.RecordBatch.from_pydict({"shard": [k], "docs": [len(n)], "nulls": [nulls], "tokens": [int(n.sum())]}, pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("nulls", pa.int64()), ("tokens", pa.int64())]))

    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    rows = rows.withColumns({"h": F.xxhash64("t"), "at": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(F.asc_nulls_first("i"), "h", "at").sortWithinPartitions(F.asc_nulls_first("i"), "h", "t").select("i", "t")
    done = sorted(tuple(r) for r in rows.mapInArrow(shard, "shard int, docs long, nulls long, tokens long").collect())
    bases = accumulate((x[3] for x in done), initial=0)
    manifest = {"width": width, "end_id": end_id, "shards": [dict(zip(("shard", "docs", "nulls", "tokens"), x, strict=True), base=b) for x, b in zip(done, bases, strict=False)]}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class TokenShard:
    """One shard, mapped into memory where the store has local paths and read whole elsewhere."""

    def __init__(self, out: str, shard: int, width: int) -> None:
        fs, root = _fs(out)
        name = f"{root}/shard-{shard:06d}"

        def flat(suffix: str, kind: str) -> np.ndarray:
            if isinstance(fs, pafs.LocalFileSystem):
                return np.memmap(f"{name}.{suffix}", kind, "r") if fs.get_file_info(f"{name}.{suffix}").size else np.zeros(0, kind)
            with fs.open_input_file(f"{name}.{suffix}") as f:
                return np.frombuffer(f.read(), kind)

        self.tokens, self.offsets, self.docs = flat("tok", f"<u{width}"), flat("off", "<u8"), flat("doc", "<i8")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.tokens[int(self.offsets[i]) : int(self.offsets[i + 1])]


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32."""
    fs, root = _fs(out)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    width = manifest["width"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    shards = [(x["shard"], x["nulls"], x["base"]) for x in manifest["shards"] if x["docs"]]
    if not shards:
        return spark.createDataFrame([], schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, nulls, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = TokenShard(out, k, width)
                for at in range(0, len(s), 8192):
                    to = min(at + 8192, len(s))
                    off = s.offsets[at : to + 1].astype("<i8")
                    crc = [zlib.crc32(s[i].astype("<u4").tobytes()) for i in range(at, to)]
                    yield pa.RecordBatch.from_arrays([pa.array(s.docs[at:to], mask=np.arange(at, to) < nulls), pa.array(off[:-1] + base), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(shards, "shard int, nulls long, base long").repartition(len(shards))
    return listed.mapInArrow(documents, schema)
