import random
import zlib

import numpy as np
import public_tokenizers
from mailframe.llm import queries, token_files
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip_equals_whole_text_encoding(spark, sf):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = [tuple(r) for r in queries.op1_token_files(spark, sf).orderBy("start").collect()]
    assert got == expected(rows)


def test_odd_rows(spark, odd, tmp_path):
    m = token_files.write_token_files(odd, str(tmp_path / "o"), PATH)
    got = [tuple(r) for r in token_files.read_token_files(spark, str(tmp_path / "o")).orderBy("start").collect()]
    assert [r[0] for r in got] == [None, None, None, 1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [r[1] for r in got] == list(np.cumsum([0, *(r[2] for r in got)])[:-1])
    text = {(i, zlib.crc32((x or "").encode())): x for i, x in odd.select("doc_id", "text").collect()}
    want = sorted((str(i), n, c) for i, _, n, c in expected([(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]))
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == want
    assert text and m["width"] == 2 and m["shards"][-1]["base"] + m["shards"][-1]["tokens"] == sum(r[2] for r in got)
    first = token_files.TokenShard(str(tmp_path / "o"), m["shards"][0]["shard"], 2)
    assert isinstance(first.tokens, np.memmap) and first[0][-1] == 1


def test_empty_table(spark, none, tmp_path):
    assert not [x for x in token_files.write_token_files(none, str(tmp_path / "o"), PATH)["shards"] if x["docs"]]
    assert token_files.read_token_files(spark, str(tmp_path / "o")).collect() == []


def test_chunks_encode_as_whole_texts():
    rng = random.Random(5)
    alphabet = "aB é́ \n\t\x1c 'sll're7½ΣςΑ<|endoftext|>.,ſŉ한가"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    t = Tokenizer.from_file(PATH)
    same(t, PATH, texts)
    # characters that change under normalization, before and after marks
    for shape in ("{}.", "a{}", "a {}.", "é{}!", "'{}s"):
        same(t, PATH, [shape.format(chr(c)) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000])


def same(tokenizer, path, texts):
    e = token_files.Encoder(path, token_files.id_width(path, 1) if path == PATH else 4)
    got = [np.frombuffer(x, e.kind).tolist() for at in range(0, len(texts), 256) for x in e.encode_all(texts[at : at + 256])]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_another_tokenizer_encodes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_files.Encoder(path, 4).by_piece
    same(Tokenizer.from_file(path), path, ["It's  a\ntest.", "", "\u0130. \u0958.", "Straße 12"])
