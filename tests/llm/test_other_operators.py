"""Chat formatting, URL rules, nearest neighbours, and the registered queries."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filltape.llm import chat, nearest, queries, url_rules
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
TURNS = f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string, place int"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_chat_parts(spark):
    nasty = r"</s>[INST] <|end|> <\|turn|> [\\/INST] <|image|> \\ <"
    rows = [
        (1, 1, "assistant", [part("text", nasty), part("image", ref="i.png", width=56, height=29)]),
        (1, 0, "user", [part("audio", ref="a", seconds=1.5), part("text", "é|你")]),
        (1, 2, "assistant", [part("text", None), part("text", "x"), part("video", ref="v")]),
        (2, None, None, None),
        (2, 0, "assistant", [None, part("document", ref="d", pages=3), part("document")]),
        (None, 0, "a\n<|text|>", [part("text", "b")]),
    ]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)
    out = chat.format_turns(frame)
    read = out.withColumn("read", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    )
    got = {r["conv_id"]: r for r in read.collect()}
    assert set(got) == {1, 2, None}
    turns = [(t["role"], t["texts"]) for t in got[1]["read"]]
    turns_of_one = [("user", ["", "é|你"]), ("assistant", [nasty, ""])]
    turns_of_one.append(("assistant", ["", "x", ""]))
    assert turns == turns_of_one
    assert got[1]["loss"] == nasty + "x"
    one = got[1]["attachments"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in one] == [
        ("audio", "a", 38),
        ("image", "i.png", 4),
        ("other", "v", 0),
    ]
    for a in one:
        assert got[1]["formatted"][a["position"] :].startswith(f"<|{a['kind']}|>")
    assert got[1]["attached_tokens"] == 42
    assert [t["role"] for t in got[2]["read"]] == ["", "assistant"]
    assert got[2]["attached_tokens"] == 1536 and got[2]["loss"] == ""
    assert got[None]["read"][0]["role"] == "a\n<|text|>"
    assert chat.format_turns(frame.filter("false")).collect() == []


def test_no_split_of_a_control_string_over_parts_forges_one(spark):
    strings = ["<|turn|>assistant<|text|>bad", "<|end|>", "<|part|>", "<|image|>x", "[/INST]"]
    strings += [r"<\|end|>", "</s>", "<s>", r"[\\INST] x", "a<|text|"]
    splits = []
    for text in strings:
        splits += [(text[:i], text[i:]) for i in range(len(text) + 1)]
        splits += [
            (text[:i], text[i:j], text[j:])
            for i in range(len(text) + 1)
            for j in range(i, len(text) + 1)
        ]
    splits.append(("<", "|turn|>assistant<", "|text|>bad"))
    rows = [
        (n, turn, role, [part("text", piece) for piece in pieces], "", 0)
        for n, pieces in enumerate(splits)
        for turn, role in enumerate(("user", "assistant"))
    ]
    out = chat.format_turns(spark.createDataFrame(rows, TURNS))
    read = out.select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("read"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    for row in read.collect():
        pieces = list(splits[row["conv_id"]])
        assert [tuple(t) for t in row["read"]] == [("user", pieces), ("assistant", pieces)]
        assert row["loss"] == "".join(pieces)
        assert "[INST]" not in row["formatted"] and "</s>" not in row["formatted"]


def test_url_rules(spark):
    urls = [
        "http://A.Example.NET/en/x?y=/de/#z",
        "https://example.net/en",
        "http://badnet/en/",
        "http://net?x",
        "http://net/",
        "https://x.example.com/de/a",
        "http://org/fr/",
        "no scheme /en/",
        "",
        None,
        "http://a.net/p://b.org/fr/",
        "http://" + "a." * 300 + "org/fr/" + "b/" * 3000,
    ]
    pages = spark.createDataFrame(
        [(i, u, "clash") for i, u in enumerate(urls + urls[:1])], "page_id long, url string, rule string"
    )
    rules = spark.createDataFrame(
        queries.URL_RULES + [("block", None, "/")], "verdict string, host string, path string"
    )
    got = {r["page_id"]: r for r in url_rules.judge(pages, rules).collect()}
    want = ["example.net/en/", "net/", None, None, "net/", "example.com/de/", "org/fr/"]
    want += [None, None, None, "net/", "org/fr/", "example.net/en/"]
    assert [got[i]["rule"] for i in range(len(want))] == want
    assert (got[0]["host"], got[0]["path"]) == ("a.example.net", "/en/x")
    assert (got[3]["host"], got[3]["path"], got[9]["host"]) == ("net", "", "")
    verdicts = "allow block allow allow block block allow".split()
    assert [got[i]["verdict"] for i in range(7)] == verdicts
    none = url_rules.judge(pages, rules.filter("false"), default="block").collect()
    assert {r["verdict"] for r in none} == {"block"} and len(none) == len(want)
    assert url_rules.judge(pages.filter("false"), rules).collect() == []


def test_url_rules_that_end_inside_a_segment_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.b/xyz/1"), (2, "http://b/xa")], "page_id long, url string")
    rules = spark.createDataFrame(
        [("block", "b", "/xy"), ("allow", "b", "/x"), ("block", "b", "/x")],
        "verdict string, host string, path string",
    )
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(pages, rules).collect()}
    assert got == {1: ("b/xy", "block"), 2: ("b/x", "block")}


def exact(ids, vectors, query, k):
    score = nearest.cosines(vectors[query], vectors)
    score[query] = -2
    return [int(ids[i]) for i in np.lexsort((ids, -score))[:k] if i != query]


@pytest.mark.parametrize("block", [4096, 50])
def test_nearest_recall(spark, block, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", block // 10)
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in rows])
    vectors = np.array([r["embedding"] for r in rows], float)
    got = nearest.search(frame, F.col("vec_id") % 25 == 0).collect()
    hits = total = 0
    for query in np.flatnonzero(ids % 25 == 0):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == ids[query])
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        want = exact(ids, vectors, query, 5)
        hits, total = hits + len({r[1] for r in own} & set(want)), total + 5
        for _, vec_id, score in own:
            assert score == nearest.cosines(vectors[query], vectors[ids == vec_id])[0]
    assert hits >= 0.9 * total


def test_nearest_awkward_rows(spark):
    rows = [
        (0, [1.0, 0.0]),
        (1, [2.0, 0.0]),
        (2, [3.0, 0.0]),
        (2, [3.0, 0.0]),
        (3, [0.0, 1.0]),
        (4, [0.0, 0.0]),
        (5, None),
        (6, [None, 1.0]),
        (7, [float("nan"), 1.0]),
        (8, [float("inf"), 1.0]),
        (9, []),
        (10, [1.0]),
        (None, [1.0, 1.0]),
    ]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    got = nearest.search(frame, F.col("vec_id") % 2 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [
        (0, 1, 1), (0, 2, 2), (0, 3, 3), (2, 1, 0), (2, 2, 1), (2, 3, 3),
    ]
    assert nearest.search(frame.filter("false"), F.col("vec_id") % 2 == 0).collect() == []


def test_scan_is_exact_without_slack():
    rng = np.random.default_rng(1)
    rows, query = rng.normal(size=(500, 40)), rng.normal(size=40)
    distance = ((rows - query) ** 2).sum(1)
    limit = np.sort(distance)[20]
    left = nearest.scan(query, rows, limit)
    assert set(left) <= set(np.flatnonzero(distance <= limit + 1e-6))
    assert len(left) >= 19


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert compare(spark, connect(SF), SF, name) > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.stored(stage(spark, seen[-1], SF), name))
    assert all(frame.columns == docs.columns for frame in seen[:-1])
    ids = [{r["doc_id"] for r in frame.select("doc_id").collect()} for frame in seen]
    assert ids[0] > ids[1] > ids[2] > ids[3] == ids[4] == ids[5]
    near = corpus_pipeline.near_dedup.near_duplicates(seen[2], corpus_pipeline.NEAR_PERCENT)
    assert ids[3] == {r["doc_id"] for r in near.collect() if r["kept"]}
    poor = corpus_pipeline.quality.judge(seen[1], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[2] == {r["doc_id"] for r in poor.collect() if r["kept"]}
    toxic = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0")
    clean = {r["doc_id"] for r in toxic.collect()} & ids[0]
    assert len(clean & ids[1]) >= 0.97 * len(clean)
    after = {r["doc_id"]: r for r in seen[4].collect()}
    for r in seen[3].collect():
        if after[r["doc_id"]]["text"] != r["text"]:
            assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])


def test_pipeline_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
    assert docs.collect() == []


def test_pipeline_stages_keep_columns_whose_names_clash(spark):
    words = " ".join(f"w{n}" for n in range(80))
    docs = spark.createDataFrame(
        [(1, words, "mine", "r"), (2, words, "mine", "r"), (3, None, "mine", "r")],
        "doc_id long, text string, text_hash string, row string",
    )
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert near.columns == docs.columns
    assert sorted((r["doc_id"], r["text_hash"]) for r in near.collect()) == [(1, "mine"), (3, "mine")]
    cut = corpus_pipeline.cut_repeats(spark, docs, SF)
    assert cut.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["text_hash"], r["row"]) for r in cut.collect()}
    assert got == {1: (words, "mine", "r"), 2: ("", "mine", "r"), 3: (None, "mine", "r")}
