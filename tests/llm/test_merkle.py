"""The manifest of a table against a tree built by hand."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from filltape.llm import merkle

SCHEMA = "doc_id long, lang string, text string, leaf string, path string, idx long, left int"


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def grown(hashes: list[str], fanout: int) -> list[list[str]]:
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        runs = [last[i : i + fanout] for i in range(0, len(last), fanout)]
        levels.append([hashed("".join(run)) for run in runs])
    return levels


def siblings(levels: list[list[str]], place: int, fanout: int) -> list[tuple[str, str]]:
    found = []
    for level in levels[:-1]:
        first = place - place % fanout
        found.append(
            ("".join(level[first:place]), "".join(level[place + 1 : first + fanout]))
        )
        place //= fanout
    return found


def rows() -> list[tuple]:
    some = [(n, "en", f"text {n}") for n in range(70)]
    some += [(n, "é", "same") for n in range(100, 103)]
    some += [(7, "de", None), (7, "de", None), (7, "de", ""), (None, "de", "x" * 200_000)]
    return [*some, (1, None, "no group"), (None, None, None), (5, "", "empty group"), (2, "ab", "1")]


@pytest.mark.parametrize("fanout", [2, 3, 20])
def test_manifest_against_a_tree_by_hand(spark, fanout):
    docs = spark.createDataFrame([(*r, "l", "p", 3, 4) for r in rows()], SCHEMA).repartition(5)
    leaf = merkle.digest(F.col("doc_id"), F.col("text"))
    changed = F.when(F.col("doc_id") == 69, F.sha2(F.lit("other"), 256)).otherwise(leaf)
    got = merkle.manifest(docs, leaf, changed, fanout=fanout)
    got = got.withColumn("proof", merkle.proof_digest(F.col("path"))).collect()

    def own(row: tuple) -> str:
        fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[2])]
        return hashed("".join(fields))

    groups = sorted({r[1] for r in rows()}, key=lambda g: (g is not None, (g or "").encode()))
    members, trees = {}, {}
    for group in groups:
        inside = [(r[0], own(r)) for r in rows() if r[1] == group]
        members[group] = sorted(inside, key=lambda m: (m[0] is not None, m[0], m[1]))
        trees[group] = grown([m[1] for m in members[group]], fanout)
    top = grown([trees[group][-1][0] for group in groups], fanout)
    root = top[-1][0]
    want = []
    for number, group in enumerate(groups):
        for place, (doc_id, hash_) in enumerate(members[group]):
            path = siblings(trees[group], place, fanout) + siblings(top, number, fanout)
            folded = hashed("other") if doc_id == 69 else hash_
            for before, after in path:
                folded = hashed(before + folded + after)
            proof = hashed("".join(before + after for before, after in path))
            want.append(
                (doc_id, hash_, trees[group][-1][0], root, path, folded, doc_id != 69, proof)
            )
    fields = "doc_id leaf subroot root path folded_root verified proof".split()
    mine = [
        tuple([tuple(s) for s in r[f]] if f == "path" else r[f] for f in fields) for r in got
    ]
    assert sorted(mine, key=str) == sorted(want, key=str)


def test_one_row_is_its_own_root_and_no_rows_are_none(spark):
    docs = spark.createDataFrame([(1, "en", "a", "", "", 0, 0)], SCHEMA)
    (only,) = merkle.manifest(docs, merkle.digest(F.col("text"))).collect()
    assert only["leaf"] == only["subroot"] == only["root"] == only["folded_root"] == hashed("1:a")
    assert only["path"] == [] and only["verified"]
    assert merkle.manifest(docs.filter("false"), merkle.digest(F.col("text"))).collect() == []
