"""Coded token ids: round trips, file sets against the library, damaged files."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filltape.llm import queries, token_file
from filltape.llm.common import shared_path

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.TOKENIZER)
SCHEMA = "doc_id long, text string, ids string, part int, start string"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def table_of(ids: np.ndarray) -> token_file.Table:
    found, counts = np.unique(ids, return_counts=True)
    return token_file.Table(*token_file.scaled(dict(zip(found.tolist(), counts.tolist(), strict=True))))


@pytest.mark.parametrize("count", [1, 2, 63, 64, 65, 5_000, 131_072, 200_001])
@pytest.mark.parametrize("kinds", [1, 2, 50_000])
def test_blocks_round_trip(count, kinds):
    rng = np.random.default_rng(count)
    ids = (rng.zipf(1.3, count) % kinds * 3).astype(np.uint32)
    table = table_of(ids)
    assert int(table.share.sum()) == 1 << token_file.SCALE and (table.share > 0).all()
    block = table.encode_block(ids)
    assert (table.decode_block(memoryview(block + b"what follows")) == ids).all()
    if kinds == 50_000 and count > 100_000:
        share = table.share[np.searchsorted(table.ids, ids)] / (1 << token_file.SCALE)
        least = -np.log2(share).sum() / 8
        assert least < len(block) < 1.01 * least + 8 * token_file.LANES


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab '1.é你\t\n \x0b\x1c\x85\xa0 　​-<|>", max_size=30)))
def test_pieces_give_the_ids_of_whole_texts(texts):
    encoder, tokenizer = test_pieces_give_the_ids_of_whole_texts.both
    for text, coded in zip(texts, encoder.encode(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(coded.as_py(), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


with open(PATH, encoding="utf-8") as file:
    test_pieces_give_the_ids_of_whole_texts.both = (
        token_file._Encoder(file.read(), "<u4"),
        Tokenizer.from_file(PATH),
    )


def rows() -> list[tuple]:
    rng = random.Random(5)
    words = ["word", "'s", "Ünder", "1234", "<|endoftext|>", "你好", "\n\n", "  ", "x" * 3000, "\x00"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)]
    long = [" ".join(rng.choice(words[:6]) for _ in range(400_000)), " " * 5000 + "end", "!" * 9]
    some = list(enumerate([*texts, *long, "", None], start=-3))
    return [*some, (7, "again"), (7, "again"), (7, "other"), (None, "no id"), (None, None)]


def expected(library, found: list[tuple]) -> list[tuple]:
    coded = []
    for doc_id, text in found:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        coded.append((doc_id, np.array(ids, "<u4").tobytes()))
    return coded


def check(got, want):
    """Starts follow one another in the order of the ids, and the ids are the library's."""
    key = lambda row: (row[0] is not None, row[0])
    got = sorted(((r["doc_id"], r["start"], bytes(r["ids"])) for r in got), key=lambda r: r[1])
    at = 0
    for row in got:
        assert row[1] == at
        at += len(row[2]) // 4
    assert [key(row) for row in got] == sorted(key(row) for row in want)
    assert sorted((str(r[0]), r[2]) for r in got) == sorted((str(r[0]), r[1]) for r in want)


def test_file_set_against_the_library(spark, library, monkeypatch):
    docs = spark.createDataFrame([(*r, "i", 1, "s") for r in rows()], SCHEMA).repartition(4)
    tokenizer = token_file.load_tokenizer(spark, PATH)
    path = shared_path(spark, "test-tokens")
    token_file.write(docs, path, tokenizer, end=0)
    check(token_file.read(spark, path).collect(), expected(library, rows()))
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.filter(F.size("checkpoints") > 1).count() >= 1

    empty = shared_path(spark, "test-tokens")
    token_file.write(docs.filter("false"), empty, tokenizer, end=0)
    assert token_file.read(spark, empty).collect() == []
    monkeypatch.setattr(token_file, "MAX_TOKENIZER_BYTES", 10)
    with pytest.raises(ValueError, match="above 10 bytes"):
        token_file.load_tokenizer(spark, PATH)


def test_damage_is_found(spark):
    docs = spark.createDataFrame([(1, "some words " * 500, "", 0, "")], SCHEMA)
    path, damaged = shared_path(spark, "test-tokens"), shared_path(spark, "test-tokens")
    token_file.write(docs, path, token_file.load_tokenizer(spark, PATH), end=0)
    spark.read.parquet(f"{path}/table").write.parquet(f"{damaged}/table")
    blocks = spark.read.parquet(f"{path}/blocks")
    one = F.expr("struct(checkpoints[0].offset AS offset, checkpoints[0].ids AS ids, 1L AS crc32)")
    blocks.withColumn("checkpoints", F.array(one)).write.parquet(f"{damaged}/blocks")
    with pytest.raises(PythonException, match="does not match its checksum"):
        token_file.read(spark, damaged).collect()
    other = shared_path(spark, "test-tokens")
    blocks.withColumn("table_crc32", F.lit(5).cast("long")).write.parquet(f"{other}/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{other}/table")
    with pytest.raises(PythonException, match="do not belong together"):
        token_file.read(spark, other).collect()


def test_query_against_brute_force(spark, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, start = [], 0
    for doc_id, ids in sorted(expected(library, docs)):
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, queries.op12_token_file(spark, SF).collect())) == want
